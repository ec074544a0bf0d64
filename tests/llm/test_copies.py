"""Fingerprints, repeated passages, similarity join, components."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duebook.llm import graph, jaccard, queries, suffixes, winnowing
from pyspark.sql import functions as F


def naive_winnow(text, gram, window):
    hashes = winnowing.gram_hashes(text, gram).tolist()
    chosen = set()
    for i in range(max(1, len(hashes) - window + 1) if hashes else 0):
        part = [h >> 24 for h in hashes[i:i + window]]
        chosen.add(i + max(k for k, h in enumerate(part) if h == min(part)))
    return sorted((p, hashes[p] >> 24) for p in chosen)


@settings(max_examples=150, deadline=None)
@given(text=st.text("abé日", max_size=120), gram=st.integers(1, 6), window=st.integers(1, 9))
def test_winnowing_takes_the_rightmost_least(text, gram, window):
    hashes, places = winnowing.winnow(text, gram, window)
    assert list(zip(places.tolist(), hashes.tolist(), strict=True)) == naive_winnow(text, gram, window)
    size = min(gram, len(text))
    same = winnowing.gram_hashes(text, gram)
    seen = {}
    for i, h in enumerate(same.tolist()):  # equal grams, equal hashes
        assert seen.setdefault(text[i:i + size], h) == h


def test_a_shared_run_shares_a_gram():
    draw = random.Random(1)
    run = "".join(draw.choice("abcdef ") for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
    a, b = ("".join(draw.choice("uvwxyz ") for _ in range(300)) + run + "".join(draw.choice("klmnop ") for _ in range(200)) for _ in range(2))
    assert set(winnowing.winnow(a)[0].tolist()) & set(winnowing.winnow(b)[0].tolist())


def test_fingerprints(spark, odd, none, monkeypatch):
    monkeypatch.setattr(winnowing, "RANGE_ROWS", 4)
    wide = odd.withColumnsRenamed({"key": "bucket", "row": "copy", "size": "id"})
    rows = wide.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in winnowing.fingerprints(wide.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    texts = [r["text"] or "" for r in rows]
    for i, r in enumerate(rows):
        text, after = texts[i], texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        row = got[r["doc_id"]]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert row["fingerprint"] == winnowing.written(*winnowing.winnow(text))
        a, b, c = (set(winnowing.winnow(x)[0].tolist()) for x in (text, edited, after))
        assert row["near_edited"] == (len(a & b) / len(a | b) if a | b else 1.0)
        assert row["near_next"] == (len(a & c) / len(a | c) if a | c else 1.0)
    assert winnowing.fingerprints(odd).count() == odd.count()  # repeated rows and null ids
    assert winnowing.fingerprints(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.lists(st.integers(0, 2), max_size=20), min_size=1, max_size=6), least=st.integers(1, 6))
def test_interval_expansion(texts, least):
    symbols = np.array([x for i, t in enumerate(texts) for x in [*t, 100 + i]], dtype=np.int64)
    order, shared = suffixes.bounded_prefixes(symbols, least)
    suffix = [symbols[i:].tolist() for i in order]
    assert suffix == sorted(suffix)
    for i in range(1, len(suffix)):
        common = 0
        while suffix[i - 1][common:common + 1] == suffix[i][common:common + 1]:
            common += 1
        assert shared[i] == (common if common < least else -1)


def naive_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p:p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for p in range(len(d) - length + 1):
            if seen[d[p:p + length]] > 1:
                gone[p:p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, np.frombuffer(d, np.uint8)[~gone].tobytes()))
    return out


def removed(documents, length, most=None):
    rows = suffixes.remove_repeats(documents, length, most=most).select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"), "kept", "removed").collect()
    return sorted((r["doc_id"] or -1, (r["n"], r["n"] - len(r["kept"]), len(r["removed"]), bytes(r["kept"]))) for r in rows)


def test_repeated_passages(spark, odd, none):
    draw = random.Random(2)
    passages = ["".join(draw.choice("abcdefé ") for _ in range(draw.randint(30, 90))) for _ in range(6)]
    texts = ["", None, "abc", "ab" * 300, "ab" * 200 + "x" + "ab" * 200]
    texts += ["".join(draw.choice("abé") for _ in range(draw.randint(0, 40))) + "".join(draw.choice(passages) for _ in range(draw.randint(0, 3)))
              + "".join(draw.choice("abé") for _ in range(draw.randint(0, 40))) for _ in range(80)]
    texts += texts[5:12]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length, most in ((40, None), (40, 3), (13, 2)):  # a small bound sends cores through the finer ranges
        assert [x for _, x in removed(documents, length, most)] == naive_removal(texts, length)
    rows = odd.collect()
    expected = sorted((r["doc_id"] or -1, x) for r, x in zip(rows, naive_removal([r["text"] for r in rows], 12), strict=True))
    assert removed(odd, 12) == expected
    assert suffixes.remove_repeats(none, 12).count() == 0


def test_text_that_is_left_has_whole_characters(spark):
    rows = [(1, "ab\u00e9" + "x" * 10 + "\u20acend"), (2, "\u00a9" + "x" * 10 + "\u20ac?"), (3, None), (4, "short")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in suffixes.remove_repeats(documents, 8).collect()}
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = {i for s in found[doc_id]["removed"] for i in range(s["start"], s["stop"])}
        assert bytes(b for i, b in enumerate(data) if i not in gone) == found[doc_id]["kept"]
        at, whole = 0, []
        for c in text or "":
            size = len(c.encode())
            whole.append("" if gone & set(range(at, at + size)) else c)
            at += size
        assert found[doc_id]["left"] == "".join(whole)
    clashing = documents.selectExpr("doc_id", "text", "doc_id AS kept", "doc_id AS removed", "doc_id AS left", "doc_id AS spans", "doc_id AS row")
    again = {r["doc_id"]: r for r in suffixes.remove_repeats(clashing, 8).collect()}
    assert all(again[i][c] == found[i][c] for i in found for c in ("kept", "removed", "left")) and all(again[i]["spans"] == again[i]["row"] == i for i in found)


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g", 7), (2, "a b c d e f g", 8), (3, "x y z", 9)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, _text_key long").selectExpr("*", "doc_id AS row", "doc_id AS own", "doc_id AS text_key")
    got = jaccard.one_of_each(documents)
    assert got.columns == documents.columns and sorted((r["doc_id"], r["_text_key"], r["row"], r["own"]) for r in got.collect()) == [(1, 7, 1, 1), (3, 9, 3, 3)]


def test_bitmaps_never_miss(spark):
    from duebook.llm.common import bitmap, marked
    rng = np.random.default_rng(1)
    held, others = (rng.integers(-2 ** 63, 2 ** 63 - 1, 5000) for _ in range(2))
    table = bitmap(spark.createDataFrame([(int(x),) for x in held], "k long"), "k").value
    assert marked(table, held).all() and marked(table, others).mean() < 0.01
    assert not marked(bitmap(spark.createDataFrame([], "k long"), "k").value, held).any()


def test_passages_are_counted_in_words(spark, folder):
    import corpus_pipeline
    draw = random.Random(8)

    def prose(n, letters, size):
        return " ".join("".join(draw.choice(letters) for _ in range(size)) for _ in range(n))
    short, fifty, wide = prose(51, "abcdefgh", 2), prose(50, "ijklmnop", 12), prose(60, "éüабв", 5)
    halves = [prose(30, "qrstuv", 6), prose(30, "qrstuv", 6)]
    texts = [f"{prose(20, 'wxyz', 6)} {x} {prose(20, 'wxyz', 6)}" for x in (short, short, fifty, fifty, wide, "é" + wide, *halves, " ".join(halves))]
    documents = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["text"] for r in corpus_pipeline.remove_passages(spark, documents, folder).orderBy("doc_id").collect()]
    first = wide.split(" ")[0]
    rest = wide.removeprefix(first + " ")  # the first word differs
    assert got == [t.replace(short, "").replace(rest, "") for t in texts]


def test_whole_characters_stay():
    data = "aé日".encode()
    assert suffixes.whole_characters(data, [(2, 4)]) == []
    assert suffixes.whole_characters(data, [(1, 5)]) == [(1, 3)]
    assert suffixes.whole_characters(data, [(0, 6)]) == [(0, 6)]


def naive_links(ids, texts):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, label = [0] * len(ids), list(range(len(ids)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                label[b] = a
    least = defaultdict(list)
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)].append(x)
    return sorted(((ids[i] if ids[i] is not None else -1), links[i], min(least[root(i)], default=-1)) for i in range(len(ids)))


def links_of(documents):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_links"], -1 if r["class_id"] is None else r["class_id"])
                  for r in jaccard.similarity_join(documents).collect())


def test_similarity_join(spark, odd, none, monkeypatch):
    draw = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    texts = ["", None, " \n", "a b", "a b", "a  b c d", "a b c d"]
    for _ in range(90):
        words = list(base)
        for _ in range(draw.randint(0, 9)):
            words[draw.randrange(300)] = f"x{draw.random()}"
        texts.append(" ".join(words))
    texts += texts[10:14]
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert links_of(documents) == naive_links(list(range(len(texts))), texts)
    rows = odd.collect()
    assert links_of(odd) == naive_links([r["doc_id"] for r in rows], [r["text"] for r in rows])
    assert links_of(none) == []
    kept = jaccard.one_of_each(documents)
    classes = {c for _, _, c in naive_links(list(range(len(texts))), texts)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(classes)


def test_one_of_each_of_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a), (5, a), (7, a + " end"), (5, b), (9, b), (5, ""), (5, None), (3, c), (None, c + " end"), (None, d), (5, " \n")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = [(5, a), (5, b), (5, ""), (5, None), (3, c), (None, d), (5, " \n")]
    assert sorted(map(str, (tuple(r) for r in kept))) == sorted(map(str, expected))


def test_pruning_bound():
    least = jaccard.least_matches(0.8, 1e-6, 160)
    assert least[0] == 0 and least[160] > 90
    assert all(a <= b for a, b in zip(least, least[1:], strict=False))


def test_components(spark):
    draw = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    pairs = chain + [(draw.randrange(40), draw.randrange(40)) for _ in range(25)]
    label = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["id"]: r["label"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == label
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_chains_close(spark):
    ids = list(range(1000))
    random.Random(6).shuffle(ids)
    falling = [5000, *range(5999, 5000, -1)]
    chains = [(a, b) for chain in (ids, falling) for a, b in zip(chain, chain[1:], strict=False)]
    got = {r["id"]: r["label"] for r in graph.components(spark.createDataFrame(chains, "a long, b long")).collect()}
    assert got == {i: 0 for i in ids} | {i: 5000 for i in falling}


def test_queries_on_the_small_tables(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op6_repeated_passages(spark, folder).collect())
    expected = naive_removal([r["text"] for r in documents], 400)
    assert got == [(d["doc_id"], n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, (n, gone, spans, kept) in zip(documents, expected, strict=True)]
    links = sorted((r["doc_id"], r["n_links"], r["class_id"]) for r in queries.op10_ngram_jaccard_join(spark, folder).collect())
    assert links == naive_links([r["doc_id"] for r in documents], [r["text"] for r in documents])
    assert queries.op4_fingerprints(spark, folder).count() == len(documents)
