"""Token counts, encoding and decoding, id files: all against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from duebook.llm import bpe, idfiles, queries, tokens
from duebook.llm.pieces import Halves, pieces
from duebook.session import run_folder

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
HARD = st.text(st.sampled_from("ab'strevmld 12.,!\n\t   ́é½İΣς日<|endoftxs>\x1c\x85\0ŉ"), max_size=80)


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def libraries():
    return {path: Tokenizer.from_file(path) for path in (WORD, BYTE)}


@settings(max_examples=400, deadline=None)
@given(text=HARD)
def test_pieces_are_the_librarys(text):
    for path in (WORD, BYTE):
        own = pieces(path)
        expected = own.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<i4").tolist() == expected
        assert sum(own.count(p) for run in own.runs(text) for p in own.pretokens(run)) == len(expected)


@settings(max_examples=150, deadline=None)
@given(text=HARD, seed=st.integers(0, 99), size=st.sampled_from([16, 50, 200]))
def test_joined_parts_are_the_whole(text, seed, size):
    draw = random.Random(seed)
    long = (text + "".join(draw.choice("abcdethinonger") for _ in range(draw.randint(0, 600)))) * 2
    for path in (WORD, BYTE):
        own = pieces(path)
        ends = bpe.leaves(long, size)
        parts = [bpe.encode_part(own, long[a:b], a) for a, b in zip(ends, ends[1:], strict=False)]
        assert bpe.join_tree(own, long, ends, parts).tolist() == own.tokenizer.encode(long, add_special_tokens=False).ids


def test_decoder_is_the_librarys():
    for path in (WORD, BYTE):
        own, library = bpe.Decoder(path), Tokenizer.from_file(path)
        for text in ("", "Hello <|endoftext|> wörld 日本", "x" * 300):
            ids = ids_of(path, text)
            assert own.decode(np.array(ids, "<i4").tobytes()) == library.decode(ids, skip_special_tokens=False)
        cut = ids_of(path, "日本語")[1:]
        assert own.decode(np.array(cut, "<i4").tobytes()) == library.decode(cut, skip_special_tokens=False)


def test_bounded_table_keeps_what_is_used():
    table = Halves(2)
    for key in "abcab":
        if table.get(key) is None and table.revive(key) is None:
            table.keep(key, key.encode())
    assert len(table) <= 3 and table.get("a") == b"a"


def test_token_counts(odd, none, monkeypatch, libraries):
    monkeypatch.setattr(tokens, "FREQUENT", 2)  # nearly all pre-tokens take the join
    for path in (WORD, BYTE):
        got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(odd, path, 1000).collect())
        expected = []
        for r in odd.collect():
            n = len(libraries[path].encode(r["text"] or "", add_special_tokens=False).ids)
            expected.append((r["doc_id"] or -1, len((r["text"] or "").encode()), n, n > 1000))
        assert got == sorted(expected)
    assert tokens.count_tokens(none, WORD).count() == 0


def test_encode_and_decode(odd, none, libraries):
    for path in (WORD, BYTE):
        rows = bpe.decode(bpe.encode(odd, path, leaf=700), path).collect()
        got = sorted((r["doc_id"] or -1, np.frombuffer(r["ids"], "<i4").tolist(), r["text"]) for r in rows)
        library = libraries[path]
        ids = [(r["doc_id"] or -1, library.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.collect()]
        assert got == sorted((i, x, library.decode(x, skip_special_tokens=False)) for i, x in ids)
    assert bpe.encode(none, WORD).count() == 0


@settings(max_examples=60, deadline=None)
@given(values=st.lists(st.integers(0, 2 ** 32 - 1), max_size=200), top=st.integers(0, 32))
def test_bit_planes_round_trip(values, top):
    ids = np.array(values, dtype=np.uint32) >> np.uint32(32 - top) if top else np.zeros(len(values), np.uint32)
    planes = idfiles.shuffle_bits(ids)
    assert len(planes) <= top
    assert idfiles.join_bits(planes, len(ids)).tolist() == ids.tolist()


def test_id_files(spark, odd, none, monkeypatch, libraries):
    monkeypatch.setattr(idfiles, "FILE_ROWS", 5)
    files = idfiles.write_ids(odd, BYTE, run_folder(spark, "ids"), end=2, block=64)
    assert files.count() > 1
    rows = sorted(idfiles.read_ids(files).collect(), key=lambda r: r["start"])
    source = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    at = 0
    for got, r in zip(rows, source, strict=True):
        ids = [*libraries[BYTE].encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert (got["doc_id"], got["start"], np.frombuffer(got["ids"], "<u4").tolist()) == (r["doc_id"], at, ids)
        at += len(ids)
    assert idfiles.round_trip(none, BYTE).count() == 0


def test_queries_on_the_small_tables(spark, folder, libraries):
    documents = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.op2_bpe_round_trip(spark, folder).collect():
        ids = libraries[WORD].encode(documents[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(libraries[WORD].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in queries.op5_token_id_files(spark, folder).collect():
        ids = [*libraries[BYTE].encode(documents[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_frequent_pieces_hold_to_their_bound(spark):
    rows = [(f"w{i}", 1 + 1000 // (i + 1), 1) for i in range(400)] + [("x" * 100, 10 ** 6, 9)]
    counted = spark.createDataFrame(rows, "pretoken string, n long, pieces int")
    for most in (0, 1, 7, 60, 399, 400, 10 ** 6):
        got = {r["pretoken"] for r in tokens.frequent_pieces(counted, most).collect()}
        others = [n for p, n, _ in rows if p not in got and len(p) <= 48]
        assert len(got) <= most and (not got or not others or min(n for p, n, _ in rows if p in got) > max(others))
        assert len(got) == 400 or most < 400
    assert tokens.frequent_pieces(counted.where("false"), 5).count() == 0


def test_long_and_short_pretokens_as_the_library():
    """Ids are packed by prepared forms up to the longest pre-token that is kept; longer ones and all kinds of ends agree with the library."""
    from tokenizers import Tokenizer

    from duebook.llm import pieces as P
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = P.Pieces(path, 50), Tokenizer.from_file(path)
    assert len(P._PACK) > P.KEPT
    words = [w for n in (1, 2, P.KEPT - 1, P.KEPT, P.KEPT + 1, 300) for w in ("q" * n, "é" * n, "Q" * n + ".", "!" * n, "ő" * n + ",")]
    for text in (" ".join(words), " " + "  ".join(words), "".join(words), " .", ".", "a.", " a", "İ a", "x. İ. ſ ƀ. "):
        assert own.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<i4").tobytes()
