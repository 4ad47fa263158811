"""Scans of paper files, dictionaries, tables and prediction files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions.dates import day_offset, iso_date, preprint_date
from ..functions.text import REPLACE_SHORT, paper_abstract, paper_text
from ..operators.ordered import with_rank
from ..session import durable

#: JVM names of charsets that Python spells differently.
_CHARSETS = {"latin-1": "ISO-8859-1", "cp1252": "windows-1252"}


def read_preprints(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """(categories, title, abstract, time); ``category`` must equal the whole category list."""
    rows = spark.read.schema(schema.PREPRINT).json(path)
    if category is not None:
        rows = rows.filter(F.col("categories") == category)
    created = F.try_element_at("versions", F.lit(1))["created"]
    return rows.select("categories", "title", "abstract", day_offset(preprint_date(created)).alias("time"))


def read_all_preprints(spark: SparkSession, path: str, source: str = "arxiv") -> DataFrame:
    return read_preprints(spark, path).select(F.lit(source).alias("source"), "title", "abstract", "time")


def read_cited_papers(spark: SparkSession, base: str, first: str | None = None, last: str | None = None, parts: int | None = None) -> DataFrame:
    """gz JSON lines below ``updated_date=YYYY-MM-DD`` folders; the date range prunes folders before listing rows.

    A gz file cannot be split, so ``parts`` spreads the rows of large files after the read.
    """
    full = T.StructType([*schema.CITED_PAPER.fields, T.StructField("_corrupt_record", T.StringType()), T.StructField("updated_date", T.DateType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").json(base)
    if first:
        rows = rows.filter(F.col("updated_date") >= F.lit(first).cast("date"))
    if last:
        rows = rows.filter(F.col("updated_date") <= F.lit(last).cast("date"))
    return rows.repartition(parts) if parts else rows


def checked_papers(rows: DataFrame) -> DataFrame:
    """Add ``time``, ``text`` and ``fault``: null, or why the row is to be skipped ('json', 'date', 'text')."""
    day = iso_date(F.col("publication_date"))
    abstract = paper_abstract(F.col("abstract_inverted_index"), F.col("abstract"))
    out = rows.withColumn("time", day_offset(day)).withColumn("text", paper_text(F.col("title"), abstract, REPLACE_SHORT, strip=True))
    return out.withColumn(
        "fault",
        F.when(F.col("_corrupt_record").isNotNull(), "json").when(F.col("time").isNull(), "date").when(F.col("text") == "", "text"),
    )


def valid_papers(rows: DataFrame) -> DataFrame:
    return checked_papers(rows).filter(F.col("fault").isNull()).drop("fault", "_corrupt_record")


def ingest_report(rows: DataFrame, group: Column | str) -> DataFrame:
    """Per file (or other group): processed rows and skipped rows by reason."""
    checked = checked_papers(rows)
    key = F.col(group) if isinstance(group, str) else group
    return checked.groupBy(key.alias("part")).agg(
        F.count_if(F.col("fault").isNull()).alias("processed"), F.count_if(F.col("fault").isNotNull()).alias("skipped"),
        *[F.count_if(F.col("fault") == f).alias(f"skipped_{f}") for f in ("json", "date", "text")],
    )


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(concept_id, line_no, concept): id among the non-blank lines, and the number among all lines, both from 0.

    The lines of one file are read by as many tasks as it has splits, and numbered by the start of their split and their
    place in it.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"), F.trim(F.regexp_replace("value", "\r$", "")).alias("concept")
    )
    numbered = with_rank(durable(lines, "lines"), ["_block", "_line"], "_no")
    kept = with_rank(numbered.filter("concept <> ''").select("_no", "concept"), ["_no"], "_id")
    return kept.select((F.col("_id") - 1).cast("int").alias("concept_id"), (F.col("_no") - 1).cast("int").alias("line_no"), "concept")


def scan_years(spark: SparkSession, path: str, keys: Sequence[str], first: int, last: int) -> DataFrame:
    """Only the key columns and the ``cYYYY`` columns of the year range that the parquet table has."""
    from ..operators.citations import year_columns

    table = spark.read.parquet(path)
    return table.select(*keys, *[f"c{y}" for y in year_columns(table) if first <= y <= last])


def scan_narrow(spark: SparkSession, path: str, columns: Sequence[str] | None = None, share: float | None = None, seed: int = 42) -> DataFrame:
    """Parquet scan with 8-byte numbers cast to 4 bytes, and an optional random sample."""
    table = spark.read.parquet(path)
    if columns:
        table = table.select(*columns)
    if share is not None:
        table = table.sample(fraction=share, seed=seed)
    narrow = {"double": "float", "bigint": "int"}
    return table.select(*[F.col(n).cast(narrow.get(t, t)).alias(n) for n, t in table.dtypes])


def read_csv(spark: SparkSession, path: str, columns: T.StructType, encodings: Sequence[str] = ("utf-8",), **options) -> DataFrame:
    """CSV with header; names are trimmed by applying ``columns``, and a byte-order mark is cut off.

    With several encodings the first one under which no value holds a replacement character is taken. Charsets that
    Spark does not list, such as gbk, need ``spark.sql.legacy.javaCharsets=true``, which ``build_session`` sets.
    """
    def load(encoding: str) -> DataFrame:
        charset = _CHARSETS.get(encoding, encoding)
        return spark.read.options(header=True, encoding=charset, enforceSchema=True, multiLine=True, escape='"', **options).schema(columns).csv(path)

    for encoding in encodings[:-1]:
        rows = load(encoding)
        texts = [F.col(f.name).contains("�") for f in columns.fields if isinstance(f.dataType, T.StringType)]
        bad = F.lit(False)
        for t in texts:
            bad = bad | F.coalesce(t, F.lit(False))
        if rows.filter(bad).isEmpty():
            return rows
    return load(encodings[-1])


def read_json_arrays(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """Files that each hold one JSON list of objects."""
    return spark.read.schema(columns).option("multiLine", True).json(path)
