"""Operator 6: quality rules, and a modified Kneser-Ney model whose perplexity bands reject documents.

The model is over symbols: texts in lower case, runs of white space as one, folded to ``SYMBOLS`` classes (letters a-z,
digits, common marks, the rest by code point). An n-gram of ``ORDER`` symbols is a packed number, a hash without
collisions, and a language has at most ``SYMBOLS ** ORDER`` of them, whatever the size of the corpus: this bounds the
model that a worker loads. Spark counts the n-grams of all documents of each language; tasks only combine their own
counts first. Lower orders use continuation counts, each order its own three discounts. The model is a Parquet table,
(language, order, code) with log probabilities and back-off weights, which workers load as sorted arrays per language.

Copies have one vote: documents of one language whose least hash of five words is the same are a shingle class, and each
of ``m`` documents of a class counts as ``1 / m`` in the n-gram counts (a gram that was seen counts at least once) and as
one row of the class in the bands. Exact copies always share a class, near copies as often as their shingles agree.

The bands of a language are its quartiles of mean negative log-likelihood over classes that pass the base rules,
widened by ``reach`` times their distance; short documents scatter more and get wider bands. A language with fewer than
``MIN_BAND_DOCS`` such classes has no bands of its own: its documents are scored, with all others, by one model over all
languages, and judged by the band that holds those of all languages under that model (without any, by one of all classes).

Cases: a null text has no words and fails the base rules; a null language is a language of its own; repeated rows are
counted as one and returned each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, durable, shared_path
from .common import _file_system, public_columns, text_bytes, text_slices, tidy, window_hashes, word_bounds, word_hashes

ORDER = 4
BITS = 6
SYMBOLS = 1 << BITS
REACH = 6.0
#: Documents of this many symbols scatter as their language does; shorter ones get a band wider by the square root.
TYPICAL_SYMBOLS = 1500
MIN_BAND_DOCS = 20
MIN_SPREAD = 0.02
#: A task hands on its counts after so many slices of text (of 4 MB), which bounds what its Python side holds.
SLICES = 2

_MARKS = " .,;:!?'\"-()0#*$%&|<>/@=_+[]"  # classes after the letters; all digits share the class of 0


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point below 2**16; 0 is the start of a text."""
    points = np.arange(1 << 16)
    fold = (27 + len(_MARKS) + points % (SYMBOLS - 27 - len(_MARKS))).astype(np.uint32)
    for k in range(26):
        fold[[97 + k, 65 + k]] = 1 + k
    for k, mark in enumerate(_MARKS):
        fold[ord(mark)] = 27 + k
    fold[48:58] = 27 + _MARKS.index("0")
    fold[[9, 10, 11, 12, 13, 32]] = 27
    return fold


def symbols(text: str) -> np.ndarray:
    """Symbol classes of a text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    folded = _classes()[np.minimum(points, (1 << 16) - 1)]
    space = folded == 27
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return folded[keep]


def grams(text: str) -> np.ndarray:
    """The packed n-gram that ends at each symbol; the start of the text is padded with class 0."""
    found = symbols(text)
    padded = np.concatenate([np.zeros(ORDER - 1, dtype=np.uint32), found])
    codes = np.zeros(len(found), dtype=np.uint32)
    for k in range(ORDER):
        codes = (codes << np.uint32(BITS)) | padded[k : k + len(found)]
    return codes


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, dtype=np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
    slices = 0
    for batch in text_slices(batches, "text"):
        slices += 1
        if slices > SLICES:
            yield from _counted(held)
            held, slices = {}, 1
        texts: dict[tuple[str | None, int], list[np.ndarray]] = {}
        for lang, copies, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "copies", "text"))):
            if text:
                texts.setdefault((lang, copies), []).append(grams(text))
        for (lang, copies), codes in texts.items():
            found, n = np.unique(np.concatenate(codes), return_counts=True)
            held.setdefault(lang, []).append((found, n / copies))
    yield from _counted(held)


def _counted(held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    for lang, parts in held.items():
        codes, counts = _merge(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int32)), pa.array(counts.astype(np.float64))], names=["lang", "code", "n"]
        )


def shingle_class(data: np.ndarray) -> int:
    """The least hash of five words of a text's UTF-8 bytes, as a signed number; of all its words if they are fewer."""
    words = word_hashes(data, *word_bounds(data))
    return _least(window_hashes(words, min(5, max(1, len(words)))))


def _least(hashes: np.ndarray) -> int:
    return int(hashes.min().view(np.int64)) if len(hashes) else 0


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        found = [shingle_class(data) for data in text_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("text_hash"), pa.array(found, pa.int64())], names=["lang", "text_hash", "shingles"])


def copies(docs: DataFrame) -> DataFrame:
    """(copy_lang, copy_hash, copies): texts whose shingle class has further rows, and the rows of the class."""
    rows = docs.filter("text is not null").mapInArrow(tidy(_classify), "lang string, text_hash binary, shingles bigint")
    texts = durable(rows.groupBy("lang", "shingles", "text_hash").agg(F.count(F.lit(1)).alias("n")), "texts")
    classes = texts.groupBy("lang", "shingles").agg(F.sum("n").alias("copies")).filter("copies > 1")
    classes = classes.select(F.col("lang").alias("class_lang"), F.col("shingles").alias("class"), "copies")
    same = texts["lang"].eqNullSafe(classes["class_lang"]) & (texts["shingles"] == classes["class"])
    return texts.join(classes, same).select(F.col("lang").alias("copy_lang"), F.col("text_hash").alias("copy_hash"), "copies")


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n) over all documents, those of a shingle class with one vote together."""
    docs = docs.withColumn("text_hash", F.unhex(F.md5("text")))
    again = broadcast_if_small(durable(copies(docs), "copies"))
    docs = docs.join(again, docs["lang"].eqNullSafe(again["copy_lang"]) & (docs["text_hash"] == again["copy_hash"]), "left")
    docs = docs.select("lang", F.coalesce("copies", F.lit(1)).alias("copies"), "text")
    counted = docs.mapInArrow(tidy(_count), "lang string, code int, n double").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    return counted.select("lang", "code", F.greatest(F.lit(1), F.round("n")).cast("bigint").alias("n"))


def _key(lang: Column) -> Column:
    """A language as a name of a folder."""
    return F.coalesce(F.concat(F.lit("x"), F.lower(F.hex(F.encode(lang, "UTF-8")))), F.lit("null"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, level, code, logp, back): natural logs of the probability of a gram, and of the weight after it as a context."""
    counts = counts.withColumn("lang", _key(F.col("lang")))
    levels: dict[int, DataFrame] = {ORDER: counts.select("lang", "code", "n")}
    for k in range(ORDER - 1, 0, -1):
        tail = F.col("code").bitwiseAND(F.lit((1 << BITS * k) - 1))
        levels[k] = durable(levels[k + 1].groupBy("lang", tail.alias("code")).agg(F.count(F.lit(1)).alias("n")), "continuations")
    lower: DataFrame | None = None
    out: list[DataFrame] = []
    for k in range(1, ORDER + 1):
        rows = levels[k].join(_discounts(levels[k]), "lang")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = durable(rows.select("lang", "code", "n", F.shiftrightunsigned("code", BITS).alias("context"), cut.alias("cut")), "cut-counts")
        sums = durable(rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed")), "contexts")
        own, freed = (F.col("n") - F.col("cut")) / F.col("total"), F.col("freed") / F.col("total")
        rows = rows.join(sums, ["lang", "context"])
        if lower is None:
            rows = rows.withColumn("p", own + freed / SYMBOLS)
        else:
            shorter = lower.select("lang", F.col("code").alias("tail"), F.col("p").alias("q"))
            rows = rows.withColumn("tail", F.col("code").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))).join(shorter, ["lang", "tail"])
            rows = rows.withColumn("p", own + freed * F.col("q"))
        lower = durable(rows.select("lang", "code", "p"), "probabilities")
        out.append(lower.select("lang", F.lit(k).alias("level"), "code", F.log("p").cast("float").alias("value")))
        weight = F.log(F.col("freed") / F.col("total")).cast("float").alias("value")
        out.append(sums.select("lang", F.lit(-k).alias("level"), F.col("context").alias("code"), weight))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def _discounts(grams: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): three discounts from the counts of counts; where those are missing, half of the count."""
    y = F.col("t1") / F.nullif(F.col("t1") + 2 * F.col("t2"), F.lit(0.0))

    def discount(c: int):
        value = c - (c + 1) * y * F.col(f"t{c + 1}") / F.nullif(F.col(f"t{c}"), F.lit(0.0))
        return F.greatest(F.lit(0.1 * c), F.least(F.coalesce(value, F.lit(0.5 * c)), F.lit(0.95 * c))).alias(f"d{c}")

    counted = grams.groupBy("lang").agg(*[F.sum((F.col("n") == c).cast("double")).alias(f"t{c}") for c in (1, 2, 3, 4)])
    return counted.select("lang", *[discount(c) for c in (1, 2, 3)])


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> str:
    """Count, fit and store a model of each language; returns the folder."""
    return store_model(durable(gram_counts(public_columns(docs, lang=lang, text=text)), "gram-counts"))


def store_model(counts: DataFrame) -> str:
    folder = shared_path(counts.sparkSession, "language-model")
    model = kneser_ney(counts)
    model.repartition("lang", "level", F.pmod("code", F.lit(16))).sortWithinPartitions("lang", "level", "code").write.partitionBy("lang").parquet(folder)
    return folder


class LanguageModel:
    """Sorted code arrays of one language; a level is negative for the weights of contexts of the order above."""

    def __init__(self, levels: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.levels = levels

    def _find(self, level: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.levels.get(level, (np.zeros(0, np.uint32), np.zeros(0, np.float32)))
        if not len(keys):
            return np.zeros(len(codes), dtype=bool), np.zeros(len(codes), dtype=np.float32)
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        return keys[at] == codes, values[at]

    def log_probabilities(self, codes: np.ndarray, level: int = ORDER) -> np.ndarray:
        """Of each gram, backing off where it, or its context, was never seen."""
        if level == 0:
            return np.full(len(codes), -np.log(SYMBOLS), dtype=np.float32)
        seen, out = self._find(level, codes)
        if not seen.all():
            rest = codes[~seen]
            known, weight = self._find(-level, rest >> np.uint32(BITS))
            shorter = self.log_probabilities(rest & np.uint32((1 << BITS * (level - 1)) - 1), level - 1)
            out = out.copy()
            out[~seen] = shorter + np.where(known, weight, np.float32(0))
        return out


@lru_cache(maxsize=16)
def load_model(folder: str, key: str) -> LanguageModel:
    """A language's arrays; at most 16 languages stay loaded in a worker."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, base = _file_system(folder)
    place = f"{base}/lang={key}"
    if system.get_file_info(place).type == fs.FileType.NotFound:
        return LanguageModel({})
    names = [f.path for f in system.get_file_info(fs.FileSelector(place)) if f.path.endswith(".parquet")]
    parts = pa.concat_tables([pq.ParquetFile(system.open_input_file(n)).read() for n in names])
    level, code, value = (parts.column(c).to_numpy() for c in ("level", "code", "value"))
    levels = {}
    for k in np.unique(level):
        codes, values = code[level == k].astype(np.uint32), value[level == k].astype(np.float32)
        order = np.argsort(codes)
        levels[int(k)] = (codes[order], values[order])
    return LanguageModel(levels)


_SYMBOL_MARKS = np.zeros(256, dtype=bool)
_SYMBOL_MARKS[list(b"#*$%&|<>")] = True


def base_figures(text: str, data: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its UTF-8 bytes."""
    return _figures(text, data)[:5]


def _figures(text: str, data: np.ndarray) -> tuple[int, int, int, int, int, int]:
    """The base figures and the shingle class (0 below five words)."""
    starts, ends = word_bounds(data)
    if not len(starts):
        return 0, 0, int(_SYMBOL_MARKS[data].sum()), 0, 0, 0
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = int((points[ends] - points[starts]).sum())
    windows = window_hashes(word_hashes(data, starts, ends))
    repeated = 0
    if len(windows) > 1:
        order = np.argsort(windows)
        same = windows[order][1:] == windows[order][:-1]
        if same.any():
            again = np.zeros(len(windows), dtype=bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            cover = np.zeros(len(starts) + 1, dtype=np.int32)
            cover[: len(windows)] += again
            cover[5 : 5 + len(windows)] -= again
            repeated = int((np.cumsum(cover) > 0).sum())
    lines = text.split("\n")
    seen: set[str] = set()
    dup = 0
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                dup += bool(line.strip(" \t\n\r\x0b\x0c"))
            else:
                seen.add(line)
    return len(starts), chars, int(_SYMBOL_MARKS[data].sum()), dup, repeated, _least(windows)


def _score(folder: str, pooled: bool = False):
    """Score by the model of each text's language, or (``pooled``) by that of the null language."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text_key", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "shingles", "n_grams")], ("nll", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            figures = [_figures(t or "", d if d is not None else np.zeros(0, np.uint8)) for t, d in zip(texts, text_bytes(batch.column("text")))]
            n_grams, nll = [0] * len(texts), [0.0] * len(texts)
            rows: dict[str, list[int]] = {}
            for k, (lang, text) in enumerate(zip(langs, texts)):
                if text:
                    rows.setdefault("null" if lang is None or pooled else "x" + lang.encode().hex(), []).append(k)
            for key, some in rows.items():
                codes = [grams(texts[k]) for k in some]
                logs = load_model(folder, key).log_probabilities(np.concatenate(codes)).astype(np.float64)
                ends = np.cumsum([len(c) for c in codes])
                sums = np.add.reduceat(logs, np.r_[0, ends[:-1]])
                for k, c, total in zip(some, codes, sums):
                    n_grams[k], nll[k] = len(c), -float(total) / len(c)
            columns = [batch.column("doc_id"), langs, batch.column("text_key"), *([f[i] for f in figures] for i in range(6)), n_grams, nll]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


SCORED = "doc_id bigint, lang string, text_key bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, shingles bigint, n_grams bigint, nll double"


def bands(scores: DataFrame, reach: float = REACH, least: int = MIN_BAND_DOCS) -> DataFrame:
    """(lang, low, high) of mean negative log-likelihood, one row per language, from shingle classes that pass the base rules."""
    classes = scores.filter(~F.col("base_failed")).groupBy("lang", "shingles").agg(F.avg("nll").alias("nll"))
    spread = classes.groupBy("lang").agg(
        F.percentile_approx("nll", F.array(F.lit(0.25), F.lit(0.75)), F.lit(10_000)).alias("q"), F.count(F.lit(1)).alias("n")
    )
    width = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(MIN_SPREAD)) * reach
    return spread.filter(F.col("n") >= least).select(
        F.col("lang").alias("band_lang"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), width.alias("reach")
    )


def score_documents(docs: DataFrame, reach: float = REACH, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Figures of the base rules, perplexity per symbol, the document's band, and ``kept``; one row per document."""
    rows = public_columns(docs, doc_id=doc_id, lang=lang, text=text).withColumn("text_key", F.xxhash64("text"))
    counts = durable(gram_counts(rows.select("lang", "text")), "gram-counts")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scores = durable(rows.mapInArrow(tidy(_score(store_model(counts))), SCORED).withColumn("base_failed", failed), "quality")
    limits = durable(bands(scores, reach), "bands")
    wide = F.sqrt(F.greatest(F.lit(1.0), F.lit(float(TYPICAL_SYMBOLS)) / F.greatest(F.lit(1), F.col("n_grams"))))
    joined = scores.join(limits, scores["lang"].eqNullSafe(limits["band_lang"]), "left")
    if not joined.filter(F.col("q1").isNull() & ~F.col("base_failed")).isEmpty():
        every = counts.groupBy("code").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "code", "n")
        pooled = durable(rows.mapInArrow(tidy(_score(store_model(every), pooled=True)), SCORED).withColumn("base_failed", failed), "quality-of-all")
        found = bands(pooled.withColumn("lang", F.lit(None).cast("string")), reach, 1) if limits.isEmpty() else bands(pooled, reach)
        band = durable(found.agg(*[f(c).alias(c) for f, c in ((F.min, "q1"), (F.max, "q3"), (F.max, "reach"))]).select(F.lit(None).cast("string").alias("band_lang"), "*"), "band-of-all")
        rare = pooled.join(limits, pooled["lang"].eqNullSafe(limits["band_lang"]), "left_anti")
        joined = joined.filter("q1 is not null").unionByName(rare.join(F.broadcast(band)))
    low, high = F.col("q1") - F.col("reach") * wide, F.col("q3") + F.col("reach") * wide
    inside = F.coalesce((F.col("nll") >= low) & (F.col("nll") <= high), F.lit(True))
    return joined.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.exp("nll").alias("perplexity"), F.exp(low).alias("lower"), F.exp(high).alias("upper"), "text_key", (~F.col("base_failed") & inside).alias("kept"),
    )
