"""Batch jobs that can be started again: a ledger of the part files that are finished.

A run lists the part files, takes away those that the ledger holds in the same size and date, and works on the rest in groups.
A group's rows are written to a folder of its own; only then is its ledger entry written beside the ledger and renamed into it.
A run that is cut off before the renaming leaves rows that no entry names: they are not read, and their parts are done again.
A group that fails is halved until the failing parts stand alone; these are returned and left open for the next run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Part files that one job works on; the driver holds the names of a group only.
GROUP = 500

_ENTRY = "part string, length bigint, modified timestamp, attempt string"


@dataclass
class RunReport:
    """What a run did: parts finished, and the error of each part that failed."""

    finished: list[str] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _exists(spark: SparkSession, path: str) -> bool:
    place, fs = _file_system(spark, path)
    return fs.exists(place)


def finished_parts(spark: SparkSession, target: str) -> DataFrame:
    """(part, length, modified, attempt): the committed entries."""
    if not _exists(spark, f"{target}/ledger"):
        return spark.createDataFrame([], _ENTRY)
    return spark.read.schema(_ENTRY).parquet(f"{target}/ledger/*")


def list_parts(spark: SparkSession, source: str, pattern: str = "*") -> DataFrame:
    """(part, length, modified) of the files below ``source``; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(source)
    return files.select(F.col("path").alias("part"), "length", F.col("modificationTime").alias("modified"))


def open_parts(spark: SparkSession, source: str, target: str, pattern: str = "*") -> DataFrame:
    """Parts without an entry, and parts that were changed since."""
    return list_parts(spark, source, pattern).join(finished_parts(spark, target), ["part", "length", "modified"], "left_anti")


def _commit(spark: SparkSession, target: str, entries: list[tuple], attempt: str) -> None:
    """Write the entry beside the ledger and rename it into it: there it is whole, or it is not there."""
    waiting = f"{target}/ledger-waiting/{attempt}"
    spark.createDataFrame(entries, _ENTRY).coalesce(1).write.parquet(waiting)
    folder, fs = _file_system(spark, f"{target}/ledger")
    fs.mkdirs(folder)
    if not fs.rename(_file_system(spark, waiting)[0], _file_system(spark, f"{target}/ledger/{attempt}")[0]):
        raise RuntimeError(f"could not commit {waiting}")


def run_open_parts(
    spark: SparkSession, source: str, target: str, work: Callable[[Sequence[str]], DataFrame], pattern: str = "*",
    group: int = GROUP, before_commit: Callable[[str], None] | None = None,
) -> RunReport:
    """Do ``work`` (part paths to rows) for every open part; ``before_commit`` is called between data and entry of a group."""
    report = RunReport()
    todo = open_parts(spark, source, target, pattern).orderBy("part")
    waiting: list[list] = []
    held: list = []
    for row in todo.toLocalIterator():
        held.append(row)
        if len(held) == group:
            waiting.append(held)
            held = []
            _drain(spark, target, work, waiting, report, before_commit)
    waiting.append(held)
    _drain(spark, target, work, waiting, report, before_commit)
    return report


def _drain(spark, target, work, waiting: list[list], report: RunReport, before_commit) -> None:
    while waiting:
        rows = waiting.pop()
        if not rows:
            continue
        attempt = uuid.uuid4().hex
        try:
            work([r["part"] for r in rows]).write.parquet(f"{target}/data/{attempt}")
        except Exception as error:  # the job of a group says nothing of its parts: each half is tried by itself
            if len(rows) == 1:
                report.failed[rows[0]["part"]] = str(error).splitlines()[0]
            else:
                waiting += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
            continue
        if before_commit is not None:
            before_commit(attempt)
        _commit(spark, target, [(r["part"], r["length"], r["modified"], attempt) for r in rows], attempt)
        report.finished += [r["part"] for r in rows]


def read_finished(spark: SparkSession, target: str, schema) -> DataFrame:
    """Rows of committed attempts only, with ``attempt``; rows of parts that were done again later count once, by the last entry.

    ``work`` must give a column ``part`` for changed parts to be told apart; without it all committed rows are returned.
    """
    if not _exists(spark, f"{target}/data"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{target}/data")
    rows = rows.withColumn("attempt", F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]{32})/", 1))
    entries = finished_parts(spark, target)
    if "part" in rows.columns:
        last = entries.groupBy("part").agg(F.max_by("attempt", "modified").alias("attempt"))
        return rows.join(last, ["part", "attempt"], "left_semi").drop("attempt")
    return rows.join(entries.select("attempt").distinct(), "attempt", "left_semi").drop("attempt")
