"""Session settings, the shared folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it is counted and has at most this many rows.
BROADCAST_ROWS = 500_000

_local_dirs: dict[str, str] = {}


def build_session(app: str = "fathomgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on; ``conf`` adds or overrides settings."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.legacy.javaCharsets": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without it; it then gets a fresh temporary folder.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return _qualified(spark, configured.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_dirs[app]


def _qualified(spark: SparkSession, path: str) -> str:
    """With scheme and authority, so that Spark and other readers take it for the same place."""
    if "://" in path or path.startswith("file:"):
        return path
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(place).toString()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark)}/fathomgraph/{name}-{uuid.uuid4().hex}"


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete their shuffle files when they end, not when the driver happens to collect garbage."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


def durable(df: DataFrame, name: str = "stage", by: Sequence[str] = (), codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder, in a folder for each value of ``by``, and read it back.

    Cuts the lineage, survives the loss of executors, and gives later joins a known size. The shuffle files of the write are
    deleted with its end.
    """
    path = shared_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.partitionBy(*by).parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def discard_path(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables written by ``durable`` that nothing reads any more; other tables are left alone."""
    for df in tables:
        path = getattr(df, "_durable_path", None)
        if path:
            discard_path(df.sparkSession, path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only if counting proves that it has at most ``rows`` rows."""
    small = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if small else df


def spread_scan(df: DataFrame, *keys: str) -> DataFrame:
    """Spread the rows of a plain scan over the cores if the files give fewer splits than there are cores.

    For CPU-heavy steps on few or unsplittable files. Tables with enough splits are left alone, so large data is not
    shuffled for it. ``df`` must be a scan with projections and filters only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores, *keys) if df.rdd.getNumPartitions() < cores else df


def tasks_for(df: DataFrame, rows: int) -> int:
    """Partitions of about ``rows`` rows of ``df``, a table read from files, but no fewer than other shuffles have.

    Adaptive execution merges partitions by their bytes in the shuffle; where rows grow after it, their number is given.
    With fewer partitions than ``spark.sql.shuffle.partitions`` a join would deal the rows again.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
