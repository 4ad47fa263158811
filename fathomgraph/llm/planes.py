"""Operator 5: token ids in files of bit or byte planes.

File: ``MAGIC``; per block of at most ``block`` ids the zstandard frames of its planes, one after the other; then the
footer, a zstandard frame of JSON with the chunk index (offset, ids, frame sizes of each block), the plane kind, the
number width and the table of documents (ids and lengths); then the footer's offset and size and ``MAGIC`` again.
A byte plane k holds byte k of every id of the block, a bit plane k bit k of every id, packed eight to a byte.

Documents go in ascending id (null first), equal ids by hash of the text, then text; a null text is empty and still has
its end id. Each task writes one file under a name of its own; the table of files lists those of successful tasks only.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, shared_path
from .common import open_input, open_output, public_columns, text_slices, tidy
from .tokens import encoded, word_encoder

MAGIC = b"TOKPLAN1"
BLOCK = 1 << 16
FILES = "file_no bigint, path string, n_docs bigint, n_tokens bigint"


def to_planes(ids: np.ndarray, kind: str, width: int) -> list[bytes]:
    """Transpose ids of ``width`` bytes into planes."""
    raw = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(width)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(8 * width)]


def from_planes(planes: list[bytes], n: int, kind: str, width: int) -> np.ndarray:
    if kind == "byte":
        raw = np.empty((n, width), dtype=np.uint8)
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, dtype=np.uint8)
    else:
        bits = np.empty((n, 8 * width), dtype=np.uint8)
        for k, plane in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return raw.reshape(-1).view(f"<u{width}")

#: The number of files follows the input: characters of a file, and what an entry of its index counts as.
FILE_CHARS, DOC_CHARS = 24_000_000, 32


class PlaneWriter:
    def __init__(self, stream, kind: str = "byte", width: int = 2, block: int = BLOCK, level: int = 3):
        import zstandard

        self.stream, self.kind, self.width, self.block = stream, kind, width, block
        self.pack = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_tokens = 0
        self.chunks: list[list] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        stream.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_tokens += len(ids)
        if self.n_waiting >= self.block:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, dtype=np.uint16)
        end = len(ids) if all_ else len(ids) // self.block * self.block
        for k in range(0, end, self.block):
            some = ids[k : min(k + self.block, end)]
            frames = [self.pack.compress(p) for p in to_planes(some, self.kind, self.width)]
            self.chunks.append([self.at, len(some), [len(f) for f in frames]])
            self.stream.write(b"".join(frames))
            self.at += sum(map(len, frames))
        self.waiting, self.n_waiting = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        footer = {"kind": self.kind, "width": self.width, "chunks": self.chunks, "docs": self.docs, "lengths": self.lengths}
        frame = self.pack.compress(json.dumps(footer, separators=(",", ":")).encode())
        self.stream.write(frame + struct.pack("<QQ", self.at, len(frame)) + MAGIC)
        self.stream.close()


def read_documents(file) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document of a plane file with its ids, in the order of the file; one block is held at a time."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    size = file.size()
    file.seek(size - 24)
    tail = file.read(24)
    if tail[16:] != MAGIC:
        raise ValueError("not a plane file, or cut short")
    at, length = struct.unpack("<QQ", tail[:16])
    file.seek(at)
    footer = json.loads(unpack.decompress(file.read(length)))
    kind, width = footer["kind"], footer["width"]

    def blocks() -> Iterator[np.ndarray]:
        for offset, n, sizes in footer["chunks"]:
            file.seek(offset)
            data = file.read(sum(sizes))
            ends = np.cumsum(sizes).tolist()
            yield from_planes([unpack.decompress(data[e - s : e]) for e, s in zip(ends, sizes)], n, kind, width)

    stream, held, used = blocks(), np.zeros(0, dtype=f"<u{width}"), 0
    for doc, n in zip(footer["docs"], footer["lengths"]):
        parts, need = [], n
        while need:
            if used == len(held):
                held, used = next(stream), 0
            take = min(need, len(held) - used)
            parts.append(held[used : used + take])
            used += take
            need -= take
        yield doc, parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else held[:0]


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, kind: str = "byte", block: int = BLOCK, folder: str | None = None,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Encode whole texts and write them in ascending id order; returns the table of files."""
    folder = folder or shared_path(docs.sparkSession, "planes")
    rows = public_columns(docs, doc_id=doc_id, text=text).withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)) + DOC_CHARS * F.count(F.lit(1))).first()[0]
    ordered = rows.repartitionByRange(max(1, -(-size // FILE_CHARS)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        path, writer = "", None
        for batch in text_slices(batches, "text", 2_000_000):
            if writer is None:
                path, stream = open_output(folder, ".planes")
                writer = PlaneWriter(stream, kind, encoder.dtype.itemsize, block)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded(batch, "text", encoder, end_id)):
                writer.add(doc, ids)
        if writer is not None:
            writer.close()
            row = {"file_no": [TaskContext.get().partitionId()], "path": [path], "n_docs": [len(writer.docs)], "n_tokens": [writer.n_tokens]}
            yield pa.RecordBatch.from_pydict(row)

    return durable(ordered.mapInArrow(tidy(run), FILES), "plane-files")


def _read(files: DataFrame, schema: str, columns: Callable[[list, list, list, list], list[pa.Array]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = files.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))).select("path", "before")
    n_files = files.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                with open_input(path) as file:
                    rows, size = [], 0
                    for doc, ids in read_documents(file):
                        rows.append((doc, start, ids))
                        start += len(ids)
                        size += len(ids)
                        if size > 1_000_000:
                            yield pa.RecordBatch.from_arrays(columns(rows), names=names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays(columns(rows), names=names)

    return placed.repartition(max(1, n_files)).mapInArrow(run, schema)


def read_token_files(files: DataFrame) -> DataFrame:
    """Documents of all files: id, place among all ids, and the ids themselves."""

    def columns(rows: list) -> list[pa.Array]:
        return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32()))]

    return _read(files, "doc_id bigint, start bigint, ids array<int>", columns)


def read_token_digests(files: DataFrame) -> DataFrame:
    """As ``read_token_files``, with length and checksum in place of the ids."""

    def columns(rows: list) -> list[pa.Array]:
        sums = [zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows]
        return [pa.array(c, pa.int64()) for c in ([r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], sums)]

    return _read(files, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", columns)
