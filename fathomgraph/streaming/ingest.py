"""Incremental ingest: only files that no earlier run has taken are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest_new_files(
    spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str,
    transform: Callable[[DataFrame], DataFrame], fmt: str = "json", files_per_batch: int | None = None,
) -> None:
    """Run ``transform`` over the part files not processed yet, add its rows to ``target``, and stop.

    The checkpoint folder remembers the files. Each batch writes a folder of its own, which a repeated batch replaces,
    so a run that was cut off can simply be started again. On a cluster both folders belong in the shared folder.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.load(source).select("*", F.col("_metadata.file_path").alias("file"))

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = (
        rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def file_report(rows: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """Per file: input rows, rows with a match, and matches; 0 for files without a match."""
    total = rows.groupBy("file").agg(F.count(F.lit(1)).alias("processed"))
    hits = matched.groupBy("file").agg(F.count_distinct(key).alias("matched_rows"), F.count(F.lit(1)).alias("matched"))
    return total.join(hits, "file", "left").fillna(0, ["matched_rows", "matched"])
