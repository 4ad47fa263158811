"""Operator 3: cost-balanced packing of documents into training sequences.

A document costs ``linear * n + quadratic * n**2``. Documents are dealt into shards of a bounded number of tokens; in a
shard, documents go in descending length to the sequence of lowest cost that still has room. The sequences of a shard
hold exactly its tokens (documents are dealt by a hash of id and text, rows that repeat both by their place too): full ones, and for the rest one for each power of two in its binary form, which needs no
padding. What no sequence has room for is cut where the roomiest sequence ends.

Cases: a null text is empty and still has its end id (without an end id, a document without tokens gives no piece); a
null id is kept; repeated rows are packed each; a document longer than a sequence is cut into whole sequences first;
equal lengths go by id, then start; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, durable
from .common import public_columns, text_slices, tidy
from .tokens import encoded, word_encoder

#: Characters of a shard: about 300,000 tokens, 150 sequences. Bounds the memory of a task, whatever the input.
SHARD_CHARS = 1_000_000

PIECES = "shard int, doc_id bigint, start bigint, doc_tokens bigint, ids binary"
PLACED = "doc_id bigint, start bigint, doc_tokens bigint, sequence_id bigint, offset bigint, capacity bigint, ids binary"


def place(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[int], list[list[tuple[int, int, int]]]]:
    """Pack descending ``lengths``; returns the size of each sequence and its (document, start, length) pieces."""
    whole, rest = divmod(sum(lengths), capacity)
    sizes = [capacity] * whole + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
    pieces: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    room = list(sizes)
    cheap = [(0.0, s) for s in range(len(sizes))]  # by cost; only sequences that the present document fits
    heapq.heapify(cheap)
    costs = [0.0] * len(sizes)
    narrow: list[tuple[int, int]] = []  # by room, roomiest first; too narrow for the documents so far
    todo = [(-n, k, 0) for k, n in enumerate(lengths)]
    heapq.heapify(todo)
    while todo:
        n, k, start = heapq.heappop(todo)
        n = -n
        while narrow and -narrow[0][0] >= n:
            s = heapq.heappop(narrow)[1]
            heapq.heappush(cheap, (costs[s], s))
        while cheap and room[cheap[0][1]] < n:
            s = heapq.heappop(cheap)[1]
            heapq.heappush(narrow, (-room[s], s))
        put = n
        if cheap:
            s = heapq.heappop(cheap)[1]
        else:
            s = heapq.heappop(narrow)[1]
            put = room[s]
            heapq.heappush(todo, (put - n, k, start + put))
        pieces[s].append((k, start, put))
        room[s] -= put
        costs[s] += linear * put + quadratic * put * put
        if room[s] and put == n:
            heapq.heappush(cheap, (costs[s], s))
    return sizes, pieces


def _scatter(x: int) -> int:
    """A scrambling of 64-bit numbers."""
    x %= 1 << 64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
    return x ^ x >> 31


def _marked(rows: DataFrame) -> DataFrame:
    """With the hash of the text, and whether further rows have this id and text."""
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    counted = keyed.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = broadcast_if_small(durable(counted.select(F.col("doc_id").alias("again_id"), F.col("text_key").alias("again_key")), "repeated"))
    same = keyed["doc_id"].eqNullSafe(again["again_id"]) & (keyed["text_key"] == again["again_key"])
    return keyed.join(again, same, "left").select("doc_id", "text_key", F.col("again_key").isNotNull().alias("repeated"), "text")


def _cut(path: str, end_id: int | None, capacity: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        context = TaskContext.get()
        place = context.partitionId() if context else 0
        seen: dict[tuple[int | None, int], int] = {}
        for batch in text_slices(batches, "text", 2_000_000):
            rows: list[tuple] = []
            docs, keys, repeated = (batch.column(c).to_pylist() for c in ("doc_id", "text_key", "repeated"))
            for doc, key, again, ids in zip(docs, keys, repeated, encoded(batch, "text", encoder, end_id)):
                spread = _scatter((doc or 0) + _scatter(key))
                if again:
                    nth = seen[doc, key] = seen.get((doc, key), 0) + 1
                    spread = _scatter(spread + _scatter((place << 40) + nth))
                spread >>= 20
                for part, start in enumerate(range(0, len(ids), capacity)):
                    rows.append(((spread + part) % shards, doc, start, len(ids), ids[start : start + capacity].tobytes()))
            shard, doc, start, total, ids = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
                names=["shard", "doc_id", "start", "doc_tokens", "ids"],
            )

    return run


def _pack(capacity: int, linear: float, quadratic: float, dtype: str):
    def run(group: pa.Table) -> pa.Table:
        docs, starts, totals = (group.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        ids = [np.frombuffer(x, dtype=dtype) for x in group.column("ids").to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (-len(ids[k]), docs[k] is None, docs[k] or 0, starts[k], ids[k].tobytes()))
        sizes, pieces = place([len(ids[k]) for k in order], capacity, linear, quadratic)
        shard = group.column("shard")[0].as_py()
        out: list[tuple] = []
        for s, held in enumerate(pieces):
            offset = 0
            for k, start, n in held:
                row = order[k]
                out.append((docs[row], starts[row] + start, totals[row], (shard << 32) + s, offset, sizes[s], ids[row][start : start + n].astype("<u4").tobytes()))
                offset += n
        columns = list(zip(*out))
        kinds = [pa.int64()] * 6 + [pa.binary()]
        names = ["doc_id", "start", "doc_tokens", "sequence_id", "offset", "capacity", "ids"]
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int | None = 1, linear: float = 1.0,
    quadratic: float = 1 / 2048, shard_chars: int = SHARD_CHARS, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece with its ids (unsigned 32-bit, little-endian); ``capacity`` is the length of its sequence.

    ``sequence_id`` holds the shard in its upper half. Each shard is packed alone, so tasks never grow with the input;
    the only figure taken from the whole table is the number of shards.
    """
    rows = public_columns(docs, doc_id=doc_id, text=text)
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)) + F.count(F.lit(1))).first()[0]
    shards = max(1, -(-chars // shard_chars))
    dtype = word_encoder(tokenizer_path).dtype.str
    pieces = _marked(rows).mapInArrow(tidy(_cut(tokenizer_path, end_id, capacity, shards)), PIECES)
    return pieces.groupBy("shard").applyInArrow(_pack(capacity, linear, quadratic, dtype), PLACED)
