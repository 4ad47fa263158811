"""The positions of texts where a gram of a dictionary can begin, found in numpy within the tasks that hold the texts.

A bit map of fixed size holds a hash of every gram. Each task hashes all positions of a text at once, one gram length after the
other, and gives a row only for those whose bit is set; the rows are then joined and compared as usual. No position is lost,
as a gram of the dictionary always has its bit set; a position with a bit of another gram finds nothing in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the map (512 kB), as a power of two.
MAP_POWER = 22
#: Rows of a batch that a task gives back.
BATCH_ROWS = 20_000
_FACTOR, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _bits(points: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length, rising, the bit of the gram of that length at every position that has all of it."""
    hashes = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, lengths[-1] + 1):
        if len(points) < n:
            return
        hashes = hashes[: len(points) - n + 1] * np.uint64(_FACTOR) + points[n - 1 :] + np.uint64(n)
        if n in lengths:
            mixed = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(_SPREAD)
            yield n, (mixed >> np.uint64(64 - MAP_POWER)).astype(np.int64)


def _strings(column: pa.Array) -> Iterator[str | None]:
    for value in column.cast(pa.binary()):
        value = value.as_py()
        yield None if value is None else value.decode("utf-8", "replace")


def gram_map(grams: DataFrame) -> np.ndarray:
    """The map of the column ``_gram``, a byte for eight bits; the driver reads its words, of which there are a fixed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [int(b[0]) for gram in _strings(batch.column(0)) if gram for _, b in _bits(_points(gram), [len(gram)])]
            yield pa.RecordBatch.from_arrays([pa.array([b >> 3 for b in bits], pa.int64()), pa.array([1 << (b & 7) for b in bits], pa.int32())], ["word", "bits"])

    words = grams.select("_gram").mapInArrow(run, "word long, bits int").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = words.toArrow()
    out = np.zeros((1 << MAP_POWER) // 8, dtype=np.uint8)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().astype(np.uint8)
    return out


def held_places(texts: DataFrame, doc: str, body: Column, lengths: list[int], bits: np.ndarray, piece: int, width: int, lead: int = 0) -> DataFrame:
    """(doc, _no, _piece, _at, _gram): the positions of ``body`` that begin a gram of the map.

    Position ``_no * piece + _at`` has its gram ``lead`` characters later; ``_piece`` is the ``width`` characters from
    ``_no * piece`` on. ``lengths`` are those of the grams. Null texts have no positions.
    """
    rows = texts.select(F.col(doc), body.alias("_body"))
    schema = T.StructType([
        rows.schema[doc], T.StructField("_no", T.IntegerType()), T.StructField("_piece", T.StringType()),
        T.StructField("_at", T.IntegerType()), T.StructField("_gram", T.StringType()),
    ])
    lengths = sorted(lengths)

    def given(column: pa.Array, owners: list, places: list, pieces: list, grams: list) -> pa.RecordBatch:
        at = np.concatenate(places)
        return pa.RecordBatch.from_arrays([
            column.take(pa.array(np.repeat(owners, [len(p) for p in places]), pa.int64())), pa.array(at // piece, pa.int32()), pa.array(pieces, pa.string()),
            pa.array(at % piece, pa.int32()), pa.array(grams, pa.string()),
        ], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: tuple[list, list, list, list] = ([], [], [], [])
            for k, text in enumerate(_strings(batch.column(1))):
                if not text or len(text) <= lead:
                    continue
                for q, bit in _bits(_points(text)[lead:], lengths):
                    found = np.flatnonzero((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                    for some in (found[a : a + BATCH_ROWS] for a in range(0, len(found), BATCH_ROWS)):
                        begins = some.tolist()
                        held[0].append(k)
                        held[1].append(some)
                        held[2].extend([text[p - p % piece : p - p % piece + width] for p in begins])
                        held[3].extend([text[p + lead : p + lead + q] for p in begins])
                        if len(held[3]) >= BATCH_ROWS:
                            yield given(batch.column(0), *held)
                            held = ([], [], [], [])
            if held[3]:
                yield given(batch.column(0), *held)

    return rows.mapInArrow(run, schema)
