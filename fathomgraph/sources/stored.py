"""Pair tables stored for repeated look-ups: bucketed and sorted by pair, with the maxima of their columns beside them.

A look-up moves the pairs that are asked for, never the stored rows: the stored side of the join keeps its buckets. Tables are of the session's catalog; their files lie in the shared folder (or where ``path`` says) and can be
registered again by another session.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard_path, shared_path

KEYS = ("v1", "v2")
#: Rows of a bucket that are aimed at.
BUCKET_ROWS = 2_000_000


@dataclass(frozen=True)
class StoredPairs:
    """A stored table: its catalog name, its folder, its columns, and how it is bucketed."""

    name: str
    path: str
    schema: str
    buckets: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)

    def maxima(self, spark: SparkSession) -> dict[str, float]:
        """The largest value of each number column, 0 (and no rows) replaced by 1: one row."""
        row = spark.read.parquet(f"{self.path}/maxima").first()
        return {n: 1.0 if not row[n] else float(row[n]) for n in row.asDict()}


def _canonical(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"v1": F.least("v1", "v2"), "v2": F.greatest("v1", "v2")})


def store_pairs(rows: DataFrame, name: str | None = None, path: str | None = None, buckets: int | None = None) -> StoredPairs:
    """Store ``rows`` (v1, v2, further columns; either orientation, one row per pair).

    The number of buckets follows the number of rows unless it is given. The maxima are those of all number columns but the keys.
    """
    spark = rows.sparkSession
    name, path = name or f"pairs_{uuid.uuid4().hex}", path or shared_path(spark, "stored-pairs")
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // BUCKET_ROWS))
    out = _canonical(rows).repartition(buckets, *KEYS).write.format("parquet").bucketBy(buckets, *KEYS).sortBy(*KEYS)
    out.option("path", f"{path}/rows").saveAsTable(name)
    numbers = [n for n, t in rows.dtypes if n not in KEYS and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    largest = spark.table(name).agg(*[F.max(n).cast("double").alias(n) for n in numbers] or [F.lit(1.0).alias("none")])
    largest.write.parquet(f"{path}/maxima")
    stored = StoredPairs(name, path, rows.schema.json(), buckets)
    meta = spark.createDataFrame([(name, stored.schema, buckets)], "name string, schema string, buckets int")
    meta.coalesce(1).write.parquet(f"{path}/layout")
    return stored


def open_stored(spark: SparkSession, path: str, name: str | None = None) -> StoredPairs:
    """Register a table that another session stored; its files are read as they lie."""
    from pyspark.sql.types import StructType

    row = spark.read.parquet(f"{path}/layout").first()
    name = name or f"pairs_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(row["schema"])).fields)
    keys = ", ".join(KEYS)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {row['buckets']} BUCKETS LOCATION '{path}/rows'")
    return StoredPairs(name, path, row["schema"], row["buckets"])


def look_up(pairs: DataFrame, stored: StoredPairs, columns: Sequence[str] | None = None, scaled: bool = False) -> DataFrame:
    """Stored columns of each pair in either orientation, null where ``found`` is false; ``scaled`` divides by the stored maxima.

    The hint asks for the bucketed join even where the stored side is small enough to be broadcast.
    """
    spark = pairs.sparkSession
    table = stored.rows(spark)
    columns = list(columns) if columns is not None else [c for c in table.columns if c not in KEYS]
    largest = stored.maxima(spark) if scaled else {}
    table = table.select(*KEYS, *[(F.col(c) / F.lit(largest[c])).alias(c) if c in largest else F.col(c) for c in columns], F.lit(True).alias("_hit"))
    asked = _canonical(pairs.select(*KEYS))
    return asked.join(table.hint("merge"), list(KEYS), "left").select(*KEYS, *columns, F.coalesce("_hit", F.lit(False)).alias("found"))


def drop_stored(spark: SparkSession, stored: StoredPairs) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {stored.name}")
    discard_path(spark, stored.path)
