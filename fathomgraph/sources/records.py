"""Records that span lines, read from files that many tasks share: quoted CSV, and JSON lists of objects.

The files are read as splittable text. A first pass sums, for each split, what changes the state between lines: quotes for CSV
(inside or outside of a quoted field), brackets outside of strings for JSON (the depth). Prefix sums over the splits of a file,
one row each, give the state in which every split begins. A second pass cuts each split into records; a record that begins
in one split and ends in another leaves a piece in each, and only these pieces are brought together, by a running count of
the beginnings. Records are whole strings afterwards and are parsed by ``from_csv`` and ``from_json``.

CSV: fields are quoted by ``"``, which is doubled inside; an unquoted field must not hold one. JSON: a file is one list of
objects; what is between objects is skipped. A single line is read by one task, as Spark cuts text at line ends only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import BROADCAST_ROWS, durable

#: Pieces of a split: a whole record, one that goes on in the next split, one that began before and goes on, one that ends.
WHOLE, BEGINS, GOES_ON, ENDS = range(4)

_JSON_TOKEN = re.compile(rb'"(?:[^"\\]++|\\.)*+"|[{}\[\]]')


class _Csv:
    """State: the parity of the quotes before a line."""

    @staticmethod
    def change(line: bytes) -> int:
        return line.count(b'"')

    @staticmethod
    def state(total: int) -> int:
        return total & 1

    @staticmethod
    def pieces(lines: Iterator[bytes], inside: int) -> Iterator[tuple[int, bytes]]:
        held: list[bytes] = []
        began = not inside  # whether the record that is held began in this split
        for line in lines:
            held.append(line)
            inside ^= line.count(b'"') & 1
            if not inside:
                record = b"\n".join(held)
                if began:
                    if record.strip():
                        yield WHOLE, record
                else:
                    yield ENDS, record
                held, began = [], True
        if held:
            yield BEGINS if began else GOES_ON, b"\n".join(held)


class _Json:
    """State: the depth before a line; a line never begins inside a string."""

    @staticmethod
    def change(line: bytes) -> int:
        return sum(1 if t in b"{[" else -1 for t in _JSON_TOKEN.findall(line) if len(t) == 1)

    @staticmethod
    def state(total: int) -> int:
        return total

    @staticmethod
    def pieces(lines: Iterator[bytes], depth: int) -> Iterator[tuple[int, bytes]]:
        held: list[bytes] = []
        began, inside = False, depth >= 2
        for line in lines:
            start = 0
            for m in _JSON_TOKEN.finditer(line):
                token = m.group()
                if len(token) > 1:
                    continue
                if token in b"{[":
                    depth += 1
                    if depth == 2 and not inside:
                        inside, began, start = True, True, m.start()
                else:
                    depth -= 1
                    if depth == 1 and inside:
                        held.append(line[start : m.end()])
                        yield WHOLE if began else ENDS, b"\n".join(held)
                        held, inside, began = [], False, False
            if inside:
                held.append(line[start:])
        if held:
            yield BEGINS if began else GOES_ON, b"\n".join(held)


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, block, line): lines as bytes with the split they are in; the rows of a split are in order."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _by_split(batches: Iterator[pa.RecordBatch], extra: str | None = None) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """The lines of each split of a task in turn; a split may go over many batches."""

    def rows() -> Iterator[tuple[tuple, bytes]]:
        for batch in batches:
            more = batch.column(extra).to_pylist() if extra else [None] * batch.num_rows
            for file, block, state, line in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), more, batch.column("line").to_pylist()):
                yield (file, block, state), line or b""

    for key, group in groupby(rows(), key=lambda r: r[0]):
        yield key, (line for _, line in group)


def split_records(spark: SparkSession, path: str | Sequence[str], kind: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(file, block, no, record): the records of all files as bytes, in order of block and ``no`` within a file.

    ``kind`` is "csv" or "json". The splits' states are broadcast if they are counted to be at most ``broadcast_rows``;
    beyond it, the lines are numbered and brought to the state of their split by a sorted exchange.
    """
    reader = {"csv": _Csv, "json": _Json}[kind]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block, _), lines in _by_split(batches):
            yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "total": [sum(map(reader.change, lines))]})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "no", "piece", "record"]

        def batch(file: str, block: int, rows: list[tuple]) -> pa.RecordBatch:
            n = len(rows)
            columns = [pa.array([file] * n), pa.array([block] * n, pa.int64()), pa.array([r[0] for r in rows], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names)

        for (file, block, before), lines in _by_split(batches, "before"):
            rows, size = [], 0
            for no, (piece, record) in enumerate(reader.pieces(lines, reader.state(before))):
                rows.append((no, piece, record))
                size += len(record)
                if size > 4_000_000:
                    yield batch(file, block, rows)
                    rows, size = [], 0
            if rows:
                yield batch(file, block, rows)

    lines = _lines(spark, path)
    totals = durable(lines.mapInArrow(summed, "file string, block bigint, total bigint"), "splits")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    states = durable(totals.select("file", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before")), "split-states")
    if states.limit(broadcast_rows + 1).count() <= broadcast_rows:
        placed = lines.join(F.broadcast(states), ["file", "block"])  # keeps the order of the lines
    else:
        numbered = lines.withColumn("at", F.monotonically_increasing_id())
        placed = numbered.join(states, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "at").drop("at")
    pieces = durable(placed.mapInArrow(cut, "file string, block bigint, no bigint, piece int, record binary"), "pieces")
    across = pieces.filter(F.col("piece") != WHOLE)  # two of a split at most
    nth = F.sum((F.col("piece") == BEGINS).cast("int")).over(Window.partitionBy("file").orderBy("block", "no").rowsBetween(Window.unboundedPreceding, 0))
    parts = across.withColumn("nth", nth).groupBy("file", "nth").agg(F.array_sort(F.collect_list(F.struct("block", "no", "record"))).alias("parts"))
    joined = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.col("parts")[0]["record"], lambda a, p: F.concat(a, F.lit(b"\n"), p["record"]))
    whole = parts.select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["no"].alias("no"), joined.alias("record"))
    return pieces.filter(F.col("piece") == WHOLE).select("file", "block", "no", "record").unionByName(whole)


def read_quoted_csv(spark: SparkSession, path: str | Sequence[str], columns: T.StructType, encoding: str = "utf-8", **options) -> DataFrame:
    """CSV files with a header each, whose quoted fields may hold line breaks; fields are taken by position.

    As ``readers.read_csv``, but a file is read by as many tasks as it has splits. ``encoding`` must be one in which quotes and
    line feeds are single bytes of ASCII (UTF-8, Latin-1, GBK and the like).
    """
    records = split_records(spark, path, "csv")
    first = Window.partitionBy("file").orderBy("block", "no")
    header = records.select("file", "block", "no").withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")
    rows = records.join(header, ["file", "block", "no"], "left_anti")
    text = F.regexp_replace(F.decode("record", encoding), "\r$", "")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.fields)
    parsed = F.from_csv(text, ddl, {"escape": '"', **options})
    return rows.select(parsed.alias("_row")).select("_row.*")


def read_json_lists(spark: SparkSession, path: str | Sequence[str], columns: T.StructType) -> DataFrame:
    """Files that each hold one JSON list of objects, over as many lines as they like.

    As ``readers.read_json_arrays``, but a file is read by as many tasks as it has splits.
    """
    records = split_records(spark, path, "json")
    return records.select(F.from_json(F.decode("record", "utf-8"), columns).alias("_row")).select("_row.*")
