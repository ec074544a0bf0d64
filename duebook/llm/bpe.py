"""BPE encoding and decoding; long texts are encoded in parts that a tree of joins puts together exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import numbered, ship, slices, whole_text
from duebook.llm.pieces import _BYTES, Pieces, pieces

#: Characters of a part of a long text; texts of up to so many are encoded whole.
LEAF = 32_768
#: Characters on either side of a join that are encoded anew at first, and tokens in a row that both encodings must have in common.
WINDOW, AGREE = 64, 4

Part = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, first character, character behind the last


def encode_part(own: Pieces, text: str, at: int = 0) -> Part:
    """Ids of a part of a text with the characters that each stands for; ``at`` is the place of the part."""
    found = own.tokenizer.encode(text, add_special_tokens=False)
    ends = np.array(found.offsets, dtype=np.int64).reshape(-1, 2) + at
    return np.array(found.ids, dtype=np.int32), ends[:, 0], ends[:, 1]


def _runs(a: Part, b: Part) -> tuple[np.ndarray, np.ndarray]:
    """Places in two encodings from which on ``AGREE`` tokens and their characters are the same."""
    if len(a[0]) < AGREE or len(b[0]) < AGREE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known: dict = {}
    keys = [list(zip(*(x.tolist() for x in part), strict=True)) for part in (a, b)]
    for i in range(len(keys[0]) - AGREE + 1):
        known.setdefault(tuple(keys[0][i:i + AGREE]), i)
    pairs = [(known[key], k) for k in range(len(keys[1]) - AGREE + 1) if (key := tuple(keys[1][k:k + AGREE])) in known]
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


def join_parts(own: Pieces, text: str, start: int, cut: int, stop: int, left: Part, right: Part) -> Part:
    """The encoding of ``text[start:stop]`` from those of its two sides.

    The characters around the cut are encoded anew. Where this encoding and a side have ``AGREE`` tokens in a row in common, one can go over into the
    other: every neighbouring pair of tokens then stands in a valid encoding, and a sequence of which that holds is the encoding of
    its text. The window doubles until both sides agree, and at last is the whole.
    """
    width = WINDOW
    while True:
        low, high = max(start, cut - width), min(stop, cut + width)
        middle = encode_part(own, text[low:high], low)
        if low == start:
            i = k = 0
            found_left = True
        else:
            first = int(np.searchsorted(left[1], low))
            a, b = _runs(tuple(x[first:] for x in left), middle)
            inside = np.flatnonzero(middle[2][np.minimum(b + AGREE - 1, len(middle[2]) - 1)] <= cut) if len(b) else b
            found_left = len(inside) > 0
            if found_left:
                i, k = first + int(a[inside[-1]]) + AGREE // 2, int(b[inside[-1]]) + AGREE // 2
        if high == stop:
            j, m = len(right[0]), len(middle[0])
            found_right = True
        else:
            last = int(np.searchsorted(right[2], high, side="right"))
            a, b = _runs(tuple(x[:last] for x in right), middle)
            inside = np.flatnonzero(middle[1][b] >= cut) if len(b) else b
            found_right = len(inside) > 0
            if found_right:
                j, m = int(a[inside[0]]) + AGREE // 2, int(b[inside[0]]) + AGREE // 2
        if found_left and found_right:
            return tuple(np.concatenate([x[:i], y[k:m], z[j:]]) for x, y, z in zip(left, middle, right, strict=True))
        width *= 2


def leaves(text: str, size: int) -> list[int]:
    """Ends of the parts of a text: as many halvings as bring all parts to ``size`` characters at most."""
    parts = 1
    while -(-len(text) // parts) > size:
        parts *= 2
    return [i * len(text) // parts for i in range(parts + 1)]


def join_tree(own: Pieces, text: str, ends: list[int], parts: list[Part]) -> np.ndarray:
    """Ids of a text from those of its parts, joined two by two."""
    while len(parts) > 1:
        parts = [join_parts(own, text, ends[i], ends[i + 1], ends[i + 2], parts[i], parts[i + 1]) for i in range(0, len(parts), 2)]
        ends = ends[::2]
    return parts[0][0]


def encode(documents: DataFrame, tokenizer: str, leaf: int = LEAF, text: str = "text", decoded: bool = False,
           digest: Callable[[bytes], str] | None = None) -> DataFrame:
    """``doc_id, ids`` for every row; ``ids`` are little-endian 32-bit integers, as the tokenizers library gives them without added tokens.

    With ``decoded`` also ``text``, what the ids decode to; with ``digest``, a function of the ids, its result as ``digest``, in the same pass.

    Null text is empty and has no ids; special strings inside a text count as the library takes them; repeated rows come out one by one. Texts of over
    ``leaf`` characters are cut into halves of halves, whose parts any task may encode; the task that puts a text together holds
    that one text and its ids.
    """
    ship(documents.sparkSession)
    schema = "doc_id long, ids binary" + ", text string" * decoded + ", digest string" * (digest is not None)

    def out(doc_ids: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
        columns = {"doc_id": doc_ids, "ids": pa.array(ids, pa.binary())}
        if decoded:
            columns["text"] = pa.array(map(decoder(tokenizer).decode, ids), pa.string())
        if digest is not None:
            columns["digest"] = pa.array(map(digest, ids), pa.string())
        return pa.RecordBatch.from_pydict(columns)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(tokenizer)
        for part in slices(batches):
            yield out(part.column("doc_id"), list(map(own.encode, part.column("text").to_pylist())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 8):
            out = [{"row": row, "doc_id": doc_id, "leaf": i, "text": value[ends[i]:ends[i + 1]]}
                   for row, doc_id, value in zip(*(part.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True)
                   for ends in [leaves(value, leaf)] for i in range(len(ends) - 1)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("leaf", pa.int32()), ("text", pa.string())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(tokenizer)
        for part in slices(batches, 8):
            found = [encode_part(own, value) for value in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *[pa.array([x[i].astype("<i4").tobytes() for x in found], pa.binary()) for i in range(3)]],
                names=[*part.schema.names, "ids", "starts", "stops"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = pieces(tokenizer), []

        def whole() -> pa.RecordBatch:
            value = "".join(r["text"] for r in held)
            ends = np.concatenate([[0], np.cumsum([len(r["text"]) for r in held])]).tolist()
            parts = [(np.frombuffer(r["ids"], "<i4"), *[np.frombuffer(r[c], "<i4").astype(np.int64) + at for c in ("starts", "stops")])
                     for r, at in zip(held, ends, strict=False)]
            ids = join_tree(own, value, ends, parts)
            return out(pa.array([held[0]["doc_id"]], pa.int64()), [ids.tobytes()])
        for batch in slices(batches, 8):
            for row in batch.to_pylist():
                if held and row["row"] != held[-1]["row"]:
                    yield whole()
                    held = []
                held.append(row)
        if held:
            yield whole()

    rows = numbered(documents, "doc_id", text).select("row", F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    small = rows.where(F.length("text") <= leaf).select("doc_id", "text").mapInArrow(short, schema)
    parts = rows.where(F.length("text") > leaf).mapInArrow(cut, "row long, doc_id long, leaf int, text string").repartition("row", "leaf")
    encoded = parts.mapInArrow(each, "row long, doc_id long, leaf int, text string, ids binary, starts binary, stops binary")
    return small.unionByName(encoded.repartition("row").sortWithinPartitions("row", "leaf").mapInArrow(joined, schema))


class Decoder:
    """Ids to text as the library's decode with all special tokens kept."""

    def __init__(self, path: str):
        import json
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        decoder = json.loads(tokenizer.to_str())["decoder"]
        self.kind = "blank" if decoder is None else "bytes" if decoder["type"] == "ByteLevel" else "other"
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        names = [tokenizer.id_to_token(i) for i in range(size)]
        if self.kind == "bytes":
            back = {c: bytes([b]) for b, c in _BYTES.items()}
            if not all(n is not None and all(c in back for c in n) for n in names):
                self.kind = "other"
            else:
                names = [b"".join(back[c] for c in n) for n in names]
        self.names = names
        self.tokenizer = tokenizer if self.kind == "other" else None  # a worker keeps the names alone

    def decode(self, ids: bytes) -> str:
        found = np.frombuffer(ids, dtype="<i4").tolist()
        if self.kind == "blank":
            return " ".join(map(self.names.__getitem__, found))
        if self.kind == "bytes":
            return b"".join(map(self.names.__getitem__, found)).decode("utf-8", "replace")
        return self.tokenizer.decode(found, skip_special_tokens=False)


@lru_cache(maxsize=1)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids, text``: the text that the library makes of the ids, special tokens kept."""
    ship(encoded.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(tokenizer)
        for part in slices(batches):
            text = pa.array(map(own.decode, part.column("ids").to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), text], names=["doc_id", "ids", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
