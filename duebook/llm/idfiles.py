"""Token-id files: ids in blocks of fixed size, cut into bit planes, each plane compressed, with an index of the blocks."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duebook.llm.common import file_system, ship, slices, whole_text
from duebook.llm.pieces import pieces
from duebook.session import materialise, run_folder

#: Ids of a block. The last block of a file may be shorter.
BLOCK = 1 << 16
#: Rows of a range of documents: one file each.
FILE_ROWS = 4096
#: Parts of texts whose ids a worker keeps, some 200 bytes each.
TABLE = 500_000
MAGIC, LEVEL = b"DBPL0001", 1


def _turned(square: np.ndarray) -> np.ndarray:
    """Each 64-bit integer as an 8 by 8 square of bits, mirrored at its diagonal: squares of 1, 2 and 4 bits change places."""
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        moved = (square ^ (square >> np.uint64(shift))) & np.uint64(mask)
        square = square ^ moved ^ (moved << np.uint64(shift))
    return square


def shuffle_bits(ids: np.ndarray) -> list[bytes]:
    """The bit planes of unsigned 32-bit ids, lowest first, up to the highest that is in use; 8 ids to a byte, the first lowest."""
    top, size = int(ids.max(initial=0)).bit_length(), -(-len(ids) // 8)
    padded = np.zeros(8 * size, dtype="<u4")
    padded[:len(ids)] = ids
    as_bytes = padded.view(np.uint8).reshape(-1, 4)
    planes = []
    for byte in range(-(-top // 8)):
        squares = _turned(np.ascontiguousarray(as_bytes[:, byte]).view("<u8"))
        rows = np.ascontiguousarray(squares.view(np.uint8).reshape(-1, 8).T)
        planes += [rows[bit].tobytes() for bit in range(min(8, top - 8 * byte))]
    return planes


def join_bits(planes: list[bytes], size: int) -> np.ndarray:
    """The ids whose bit planes these are."""
    out = np.zeros((-(-size // 8) * 8, 4), dtype=np.uint8)
    for byte in range(-(-len(planes) // 8)):
        rows = np.zeros((8, len(out) // 8), dtype=np.uint8)
        for bit, plane in enumerate(planes[8 * byte:8 * byte + 8]):
            rows[bit] = np.frombuffer(plane, dtype=np.uint8)
        out[:, byte] = _turned(np.ascontiguousarray(rows.T).view("<u8").reshape(-1)).view(np.uint8)
    return out.reshape(-1).view("<u4")[:size]


class Writer:
    """Writes one file: magic, blocks, document table, block index, tail with the places of both."""

    def __init__(self, out, block: int = BLOCK):
        import zstandard
        self.out, self.block, self.pack = out, block, zstandard.ZstdCompressor(level=LEVEL).compress
        self.place = self.out.write(MAGIC)
        self.index, self.documents, self.held, self.count, self.total = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((0 if doc_id is None else doc_id, doc_id is None, len(ids)))
        self.held.append(ids)
        self.count += len(ids)
        self.total += len(ids)
        if self.count >= self.block:
            ids = np.concatenate(self.held)
            whole = len(ids) - len(ids) % self.block
            for at in range(0, whole, self.block):
                self._block(ids[at:at + self.block])
            self.held, self.count = [ids[whole:]], len(ids) - whole

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.place += len(data)
        return len(data)

    def _block(self, ids: np.ndarray) -> None:
        planes, start = [self.pack(p) for p in shuffle_bits(ids)], self.place
        self._put(struct.pack(f"<B{len(planes)}I", len(planes), *map(len, planes)) + b"".join(planes))
        self.index.append((start, len(ids)))

    def close(self) -> None:
        if self.count:
            self._block(np.concatenate(self.held))
        documents = self.pack(np.array(self.documents, dtype="<i8").tobytes())
        at = self.place
        self._put(documents)
        index = struct.pack(f"<{2 * len(self.index)}Q", *[x for pair in self.index for x in pair])
        self._put(index)
        self._put(struct.pack("<QQQQ", at, len(documents), len(self.index), len(self.documents)) + MAGIC)


class Reader:
    """Reads one file block by block; ``ids(start, stop)`` opens only the blocks that it needs."""

    def __init__(self, source, size: int):
        import zstandard
        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        tail = self._at(size - 40, 40)
        if tail[32:] != MAGIC:
            raise ValueError("not a token-id file")
        at, packed, blocks, documents = struct.unpack("<QQQQ", tail[:32])
        self.documents = np.frombuffer(self.unpack(self._at(at, packed)), dtype="<i8").reshape(-1, 3) if documents else np.zeros((0, 3), np.int64)
        self.index = np.frombuffer(self._at(at + packed, 16 * blocks), dtype="<u8").reshape(-1, 2).astype(np.int64)
        self.ends, self.limit, self.last = np.cumsum(self.index[:, 1]), at, (-1, None)

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def block(self, number: int) -> np.ndarray:
        if self.last[0] != number:
            start, size = self.index[number]
            end = self.index[number + 1][0] if number + 1 < len(self.index) else self.limit
            data = self._at(int(start), int(end - start))
            sizes = struct.unpack_from(f"<{data[0]}I", data, 1)
            ends = np.cumsum([1 + 4 * data[0], *sizes])
            self.last = number, join_bits([self.unpack(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], int(size))
        return self.last[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        parts, at = [], start
        while at < stop:
            number = int(np.searchsorted(self.ends, at, side="right"))
            first = int(self.ends[number] - self.index[number][1])
            parts.append(self.block(number)[at - first:stop - first])
            at = int(self.ends[number])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_ids(documents: DataFrame, tokenizer: str, folder: str, end: int | None = None, text: str = "text", block: int = BLOCK) -> DataFrame:
    """Encode all texts and write their ids, in ascending order of ``doc_id``, one file for each range of ids.

    Returns ``file, bytes, documents, first_id, n_ids, start``; ``start`` is the number of ids in the files before. Null text is empty, ``end`` is
    appended to every document, null ids come first, rows of equal id are in order of text. A file gets a new name in every attempt; the
    table names those of the attempts that succeeded. Only the table of files, a row for ``FILE_ROWS`` documents, is summed in order.
    """
    ship(documents.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out, stop = pieces(tokenizer, TABLE), None, np.array([] if end is None else [end], dtype=np.uint32)
        for batch in slices(batches):
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    fs, path = file_system(folder)
                    fs.create_dir(path, recursive=True)
                    name, first = f"ids-{uuid.uuid4().hex}.bpl", doc_id
                    sink = fs.open_output_stream(f"{path}/{name}", compression=None)
                    out = Writer(sink, block)
                out.add(doc_id, np.concatenate([np.frombuffer(own.encode(value), dtype="<u4"), stop]))
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({
                "file": [f"{folder}/{name}"], "bytes": pa.array([out.place], pa.int64()), "documents": pa.array([len(out.documents)], pa.int64()),
                "first_id": pa.array([first], pa.int64()), "n_ids": pa.array([out.total], pa.int64())})
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    files = max(1, -(-rows.count() // FILE_ROWS))
    ordered = rows.repartitionByRange(files, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    written = materialise(ordered.mapInArrow(run, "file string, bytes long, documents long, first_id long, n_ids long"), "id-files")
    before = Window.orderBy(F.asc_nulls_first("first_id")).rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(files: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every document in the files; ``ids`` holds little-endian unsigned 32-bit integers."""
    ship(files.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = file_system(row["file"])
                with fs.open_input_file(path) as source:
                    reader, at, out = Reader(source, row["bytes"]), 0, []
                    for doc_id, null, n in reader.documents.tolist():
                        out.append({"doc_id": None if null else doc_id, "start": row["start"] + at, "ids": reader.ids(at, at + n).tobytes()})
                        at += n
                        if len(out) == 256:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
    spread = files.select("file", "bytes", "start").repartition(max(1, files.count()), "file")
    return spread.mapInArrow(run, "doc_id long, start long, ids binary")


def round_trip(documents: DataFrame, tokenizer: str, end: int | None = None) -> DataFrame:
    """Write all ids to files of the shared folder and read them back."""
    return read_ids(materialise(write_ids(documents, tokenizer, run_folder(documents.sparkSession, "ids"), end), "id-index"))
