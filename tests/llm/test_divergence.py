"""Divergence of sources against a plain count over all terms and pairs."""

import re
from collections import Counter

import numpy as np
import pytest

from duebook.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, top):
    """Rows of (text, lang, source)."""
    rows = [(t or "", la or "", so or "") for t, la, so in rows]
    out = []
    for lang in {r[1] for r in rows}:
        terms = [(so, TERM.findall(t.translate(LOWER))) for t, la, so in rows if la == lang]
        docs = Counter(w for _, ws in terms for w in set(ws))
        kept = sorted(w for w, n in docs.items() if n >= min_docs)
        counts = {so: Counter() for so, _ in terms}
        for so, ws in terms:
            counts[so].update(w for w in ws if docs[w] >= min_docs)

        def probabilities(c):
            return {w: 1 + 10 ** 9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        p = {so: probabilities(c) for so, c in counts.items()}
        whole = probabilities(sum(counts.values(), Counter()))
        for so in p:
            pair = [(sum((p[so][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in p if o != so]
            term = [((p[so][w] - whole[w]) ** 2 // whole[w], w) for w in kept if counts[so][w] and p[so][w] > whole[w]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, so, part, item, v, i + 1) for i, (v, item) in enumerate(items) if part == "pair" or i < top]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.source_divergence(df, **options).collect())


@pytest.mark.parametrize("min_docs, top", [(1, 200), (2, 3), (3, 200)])
def test_odd_rows(odd, min_docs, top):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd.collect()]
    assert got(odd, min_docs=min_docs, top=top) == brute(rows, min_docs, top)


def test_blocks_and_hot_sources(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqré"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 40))) + ("-The the THE" if i % 4 else ""), ["x", "y", None][i % 3],
             "hot" if i % 3 == 1 or rng.random() < 0.4 else f"s{rng.integers(0, 6)}") for i in range(400)]
    rows += [(None, "z", "empty"), ("", "z", "also"), ("once only", "w", "alone")]
    monkeypatch.setattr(divergence, "POSTINGS", 50)
    documents = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    assert got(documents) == brute(rows, 3, 200)


def test_empty_and_single(spark, none):
    assert got(none) == []
    alone = spark.createDataFrame([("a b", "l", "s")] * 4, "text string, lang string, source string")
    assert got(alone) == []  # no other source, and nothing is likelier than in the language


def test_long_texts_are_cut_between_terms():
    text = ("Ab cD-é " * 5000 + "x" * 30000 + " end").encode()
    whole = TERM.findall(text.decode().translate(LOWER))
    assert [t.decode() for part in divergence._parts(text, 700) for t in part] == whole
    assert [t for part in divergence._parts(b"", 700) for t in part] == []


def test_many_flushes_give_the_same(spark, folder):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"lang": ["l"] * 9, "source": ["s"] * 9, "text": [b"a b", b"b c c", b"a"] * 3})

    def sums():
        n, d = Counter(), Counter()
        for out in divergence._count(iter([batch] * 3)):
            for r in out.to_pylist():
                n[r["term"]] += r["n"]
                d[r["term"]] += r["d"]
        return n, d
    before, read = sums(), divergence.READ
    try:
        divergence.READ = 4
        assert sums() == before
        assert before == ({b"": 0, b"a": 18, b"b": 18, b"c": 18}, {b"": 0, b"a": 18, b"b": 18, b"c": 9})
    finally:
        divergence.READ = read


def test_shares_are_exact():
    count, total = np.array([0, 5, 10 ** 12]), np.array([7, 11, 3 * 10 ** 15])
    assert divergence.shares(count, total).tolist() == [1 + 10 ** 9 * (c + 1) // t for c, t in zip(count.tolist(), total.tolist())]
