"""Phrase collocations per language: SON partitioning, then exact counts, scores, and containment.

Documents are dealt into ``SHARDS`` shards. A phrase found at least ``MIN_COUNT`` times has in some shard at least its
proportional share, ``ceil(MIN_COUNT / SHARDS)`` occurrences, however the shards are filled. Each shard is mined completely
at that lowered support: tasks combine hashed keys of n-grams in numpy, Spark sums them per shard and key. The union of the
locally frequent keys is the candidates; a key goes on only if its counts, with the most that shards below their support
can hide, reach ``MIN_COUNT``. Words are mined first, then pairs of frequent words, then runs of 3 and 4 words whose pairs
are all candidates. In the last pass over the texts the candidates are counted by their words, so that a key shared by
two phrases adds a candidate but never changes a count.

Tasks know the candidates by a bit map of fixed size (``MAP_BITS``); it lets through every candidate, and at sizes where it
fills up it lets through more, which the last count drops again. No text is shuffled, no table of grams is collected.

Defined results: null texts are empty, a null language is ``und``; texts without a word add nothing; repeated rows count
each time; an empty table gives no rows; of the input only ``text`` and ``lang`` are read, whatever else it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import discard, durable
from .common import lower_ascii, mix, public_columns, text_slices, tidy, window_hashes, word_hashes

MIN_COUNT = 30
MAX_WORDS = 4
TOP = 2000
#: A shorter phrase goes if a longer one that holds it has this many percent of its count.
CONTAINED_PERCENT = 80
SCALE = 2_000_000
SHARDS = 10
#: Size of the map of candidates: 16 MB, whatever the size of the corpus.
MAP_BITS = 1 << 27
#: Bits of a key that are sent; keys that fall together add a candidate.
KEY_BITS = 48
#: Words whose keys a task holds before it combines and sends them.
HELD_WORDS = 2_000_000
#: Bytes of text that a task reads at once; one longer text is read whole.
SLICE = 2_000_000

_SEPARATOR = np.zeros(256, dtype=np.uint8)  # 1 between words, 2 between pieces
_SEPARATOR[[0x20, 0x09]] = 1
_SEPARATOR[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "replace"), digest_size=8).digest(), "little")


class _Words:
    """The words of some texts: lower-cased bytes with one space after each word, places, hashes, language, piece breaks."""

    def __init__(self, batch: pa.RecordBatch):
        import pyarrow.compute as pc

        langs = batch.column("lang").dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        joined = pc.binary_join_element_wise(batch.column("text"), "", "\n")  # a piece ends with its text
        if isinstance(joined, pa.ChunkedArray):
            joined = joined.combine_chunks()
        wide = pa.types.is_large_string(joined.type)
        offsets = np.frombuffer(joined.buffers()[1], dtype=np.int64 if wide else np.int32)[joined.offset : joined.offset + len(joined) + 1].astype(np.int64)
        data = np.frombuffer(joined.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        data = lower_ascii(data)
        kind = _SEPARATOR[data]
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = kind == 0
        turn = np.diff(inside)
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        pieces = np.cumsum(kind == 2, dtype=np.int64)[starts]
        self.breaks = np.ones(len(starts), dtype=bool)
        self.breaks[1:] = pieces[1:] != pieces[:-1]
        rows = np.searchsorted(offsets[1:] - offsets[0], starts, side="right")
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[rows].astype(np.int32)
        salts = np.array([_salt(x) for x in self.langs], dtype=np.uint64)
        self.salt = salts[self.lang] if len(starts) else np.zeros(0, dtype=np.uint64)
        self.hashes = word_hashes(data, starts, ends)
        keep = kind == 0
        keep[ends] = True  # every word is followed by a separator: the line feed at the end of its text at least
        data[ends] = 0x20
        self.data = data[keep]
        self.lengths = ends - starts
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, keys) of the runs of ``n`` words within pieces."""
        if len(self.hashes) < n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        size = len(self.hashes) - n + 1
        whole = np.ones(size, dtype=bool)
        for k in range(1, n):
            whole &= ~self.breaks[k : k + size]
        with np.errstate(over="ignore"):
            keys = mix((window_hashes(self.hashes, n) ^ self.salt[:size]) + np.uint64(n) * _GOLD)
        return whole, keys

    def phrases(self, first: np.ndarray, n: int) -> pa.Array:
        """The texts of runs of ``n`` words, joined by spaces."""
        begin = self.starts[first]
        length = self.starts[first + n - 1] + self.lengths[first + n - 1] - begin
        offsets = np.zeros(len(first) + 1, dtype=np.int64)
        np.cumsum(length, out=offsets[1:])
        places = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], length)
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[places])])


def _held(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which keys the bit map holds."""
    place = keys & np.uint64(len(held) * 64 - 1)
    return (held[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def _runs(words: _Words, maps: dict[int, np.ndarray], lengths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, mask of first words, keys) of runs whose parts are held: words in map 1, pairs in map 2; longer runs in map 3."""
    ones = _held(words.keys(1)[1], maps[1]) if len(words.hashes) else np.zeros(0, dtype=bool)
    pairs = None
    for n in lengths:
        good, keys = words.keys(n)
        if not len(keys):
            continue
        good = good & ones[: len(keys)]
        for k in range(1, n):
            good &= ones[k : k + len(keys)]
        if n > 2:
            if pairs is None:
                pairs = _held(words.keys(2)[1], maps[2])
            for k in range(n - 1):
                good &= pairs[k : k + len(keys)]
        own = 2 if n == 2 else 3
        if own in maps:
            good &= _held(keys, maps[own])
        yield n, good, keys


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text", SLICE):
        words = _Words(batch)
        if not len(words.hashes):
            continue
        _, keys = words.keys(1)
        found, first, counts = np.unique(keys, return_index=True, return_counts=True)
        lang = pa.DictionaryArray.from_arrays(pa.array(words.lang[first]), pa.array(words.langs, pa.string())).dictionary_decode()
        yield pa.RecordBatch.from_arrays([lang, words.phrases(first, 1).cast(pa.string()), pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "phrase", "gram", "n"])


def _combined(held: list[np.ndarray], shard: int) -> pa.RecordBatch:
    found, counts = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), shard, dtype=np.int32)), pa.array(counts.astype(np.int32))], ["gram", "shard", "n"])


def _mined(docs: DataFrame, maps: dict, lengths: tuple[int, ...]) -> DataFrame:
    """(gram, shard, n): every run of the given lengths whose parts are candidates, combined over some millions of words."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % SHARDS
        own = {k: m.value for k, m in maps.items()}
        held: list[np.ndarray] = []
        size = 0
        for batch in text_slices(batches, "text", SLICE):
            for _, good, keys in _runs(_Words(batch), own, lengths):
                held.append(keys[good] & np.uint64((1 << KEY_BITS) - 1))
                size += len(held[-1])
            if size >= HELD_WORDS:
                yield _combined(held, shard)
                held, size = [], 0
        if size:
            yield _combined(held, shard)

    return docs.mapInArrow(tidy(mine), "gram long, shard int, n int")


def _candidates(mined: DataFrame) -> DataFrame:
    """Keys that can have ``MIN_COUNT`` occurrences by what the shards found at their lowered support."""
    local = -(-MIN_COUNT // SHARDS)
    hidden = SHARDS * (local - 1)  # the most occurrences that shards below their support can have between them
    by_shard = mined.repartition("gram").groupBy("gram", "shard").agg(F.sum("n").alias("n")).filter(F.col("n") >= local)
    return by_shard.groupBy("gram").agg(F.sum(F.col("n") - (local - 1)).alias("above")).filter(F.col("above") + hidden >= MIN_COUNT).select("gram")


def _bit_map(grams: DataFrame):
    """A broadcast bit map of keys, of fixed size: one row per used word of 64 bits comes to the driver."""
    slots = MAP_BITS // 64
    rows = grams.select((F.col("gram").bitwiseAND(MAP_BITS - 1)).alias("at"))
    rows = rows.select(F.shiftright("at", 6).cast("int").alias("slot"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    used = rows.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(slots, dtype=np.uint64)
    held[used.column("slot").to_numpy()] = used.column("bits").to_numpy().view(np.uint64)
    return grams.sparkSession.sparkContext.broadcast(held)


def _exact(docs: DataFrame, maps: dict) -> DataFrame:
    """(lang, phrase, n) of the candidates of 2 and more words, counted by their words over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: m.value for k, m in maps.items()}
        for batch in text_slices(batches, "text", SLICE):
            words = _Words(batch)
            for n, good, keys in _runs(words, own, tuple(range(2, MAX_WORDS + 1))):
                at = np.flatnonzero(good)
                if not len(at):
                    continue
                _, first, counts = np.unique(keys[at], return_index=True, return_counts=True)
                first = at[first]
                lang = pa.DictionaryArray.from_arrays(pa.array(words.lang[first]), pa.array(words.langs, pa.string())).dictionary_decode()
                size = np.full(len(first), n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([lang, words.phrases(first, n).cast(pa.string()), pa.array(size), pa.array(counts.astype(np.int64))], ["lang", "phrase", "words", "n"])

    counted = docs.mapInArrow(tidy(count), "lang string, phrase string, words int, n long")
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).filter(F.col("f") >= MIN_COUNT)


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables: (lang, phrase, words, f) of all phrases of up to ``MAX_WORDS`` words found ``MIN_COUNT`` times, and (lang, n)."""
    docs = public_columns(docs, text="text", lang="lang").select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    counted = docs.mapInArrow(tidy(_word_counts), "lang string, phrase string, gram long, n long")
    words = durable(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.first("gram").alias("gram")), "words")
    totals = durable(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    frequent = durable(words.filter(F.col("f") >= MIN_COUNT), "words")
    discard(words)
    maps = {1: _bit_map(frequent.select("gram"))}
    maps[2] = _bit_map(_candidates(_mined(docs, maps, (2,))))
    maps[3] = _bit_map(_candidates(_mined(docs, maps, tuple(range(3, MAX_WORDS + 1)))))
    exact = _exact(docs, maps).unionByName(frequent.select("lang", "phrase", F.lit(1).alias("words"), "f"))
    exact = durable(exact, "phrases")
    discard(frequent)
    return exact, totals


def _part(words: str, start, length) -> F.Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best phrases of each language: lang, rank, phrase, a, l, r, n, score; scores and drops as in the module's text."""
    found, totals = frequent_phrases(docs)
    held = found.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("parts"))
    # Every shorter phrase inside a longer one, with the highest count of those that hold it.
    inner = held.filter("words > 2").select("lang", "words", F.col("a").alias("outer"), "parts")
    inner = inner.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inner = inner.select("lang", _part("parts", F.col("at"), F.col("size")).alias("phrase"), "outer")
    inner = inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    kept = held.join(inner, ["lang", "phrase"], "left")
    kept = kept.filter(F.col("outer").isNull() | (big("outer") * 100 < big("a") * CONTAINED_PERCENT)).drop("outer")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut", _part("parts", F.lit(1), F.col("cut")).alias("left_part"),
        _part("parts", F.col("cut") + 1, F.col("words") - F.col("cut")).alias("right_part"),
    )
    counts = found.select("lang", "phrase", "f")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left_part"), F.col("f").alias("l")), ["lang", "left_part"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right_part"), F.col("f").alias("r")), ["lang", "right_part"])
    cuts = cuts.withColumn("score", F.expr(f"(cast({SCALE} as decimal(20,0)) * cast(a as decimal(18,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    best = best.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
