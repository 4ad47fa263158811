"""Writers, compaction and exports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 256 << 20


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "error") -> None:
    df.write.mode(mode).option("compression", compression).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "error") -> None:
    """CSV with header. Spark writes no byte-order mark; readers that need one must add it."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(header=True, sep=sep, encoding="UTF-8", escape='"', **keep).csv(path)


def write_tsv(df: DataFrame, path: str, mode: str = "error") -> None:
    write_csv(df, path, sep="\t", mode=mode)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_json_arrays(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON list per part file; every task streams its rows between the two brackets."""

    def bracketed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark = "["
        for batch in batches:
            if len(batch):
                lines = mark + batch["value"].iloc[:1]
                yield pd.DataFrame({"value": pd.concat([lines, "," + batch["value"].iloc[1:]])})
                mark = ","
        yield pd.DataFrame({"value": ["[]" if mark == "[" else "]"]})

    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInPandas(bracketed, "value string").write.mode(mode).text(path)


def compact(spark: SparkSession, source: str, target: str, file_bytes: int = TARGET_BYTES) -> int:
    """Rewrite many part files as files of about ``file_bytes``; fails unless the row count stays the same."""
    rows = spark.read.parquet(source)
    files = rows.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).distinct()
    total = files.agg(F.sum("s")).first()[0] or 0
    parts = max(1, -(-total // file_bytes))
    rows.coalesce(parts).write.parquet(target)
    before, after = rows.count(), spark.read.parquet(target).count()
    if before != after:
        raise RuntimeError(f"compaction read {before} rows and wrote {after}")
    return after


def union_graphs(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of both edge tables; a year column that one of them lacks is 0 there."""
    both = one.unionByName(other, allowMissingColumns=True)
    filled = [c for c in both.columns if c not in one.columns or c not in other.columns]
    return both.fillna(0, filled) if filled else both


def graph_report(edges: DataFrame) -> DataFrame:
    """One row: number of edge rows and of distinct vertices."""
    rows = edges.agg(F.count(F.lit(1)).alias("edge_rows")).first()["edge_rows"]
    ends = edges.select(F.explode(F.array("v1", "v2")).alias("v")).groupBy("v").agg(F.count(F.lit(1)))
    return ends.agg(F.lit(rows).cast("bigint").alias("edge_rows"), F.count(F.lit(1)).alias("vertices"))
