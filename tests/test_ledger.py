"""Resumed batch runs: cut between data and entry, failing and changed parts."""

import json
import time

import pytest
from fathomgraph.streaming import ledger
from pyspark.sql import functions as F

SCHEMA = "part string, id int, n int"


def write(folder, name, ids, text=None):
    (folder / name).write_text(text if text is not None else "\n".join(json.dumps({"id": k}) for k in ids))


def worker(spark, seen):
    def work(parts):
        seen.append(sorted(p.rsplit("/", 1)[1] for p in parts))
        rows = spark.read.schema("id int").option("mode", "FAILFAST").json(list(parts))
        return rows.select(F.col("_metadata.file_path").alias("part"), "id", (F.col("id") * 2).alias("n"))

    return work


def ids(spark, target):
    return sorted(r["id"] for r in ledger.read_finished(spark, target, SCHEMA).collect())


def test_a_run_cut_between_data_and_entry_is_done_again(spark, tmp_path):
    source, target, seen = tmp_path / "in", str(tmp_path / "out"), []
    source.mkdir()
    for k in range(5):
        write(source, f"p{k}.json", range(10 * k, 10 * k + 3))
    assert ids(spark, target) == []
    calls = []

    def killed(attempt):
        calls.append(attempt)
        if len(calls) == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        ledger.run_open_parts(spark, str(source), target, worker(spark, seen), group=2, before_commit=killed)
    assert seen == [["p0.json", "p1.json"], ["p2.json", "p3.json"]]
    assert ids(spark, target) == [0, 1, 2, 10, 11, 12]  # the second group's rows lie there, but nothing names them
    report = ledger.run_open_parts(spark, str(source), target, worker(spark, seen), group=2)
    assert seen[2:] == [["p2.json", "p3.json"], ["p4.json"]] and len(report.finished) == 3 and not report.failed
    assert ids(spark, target) == [k for p in range(5) for k in range(10 * p, 10 * p + 3)]
    assert ledger.run_open_parts(spark, str(source), target, worker(spark, seen)).finished == [] and len(seen) == 4


def test_failing_parts_stand_alone_and_stay_open(spark, tmp_path):
    source, target, seen = tmp_path / "in", str(tmp_path / "out"), []
    source.mkdir()
    for k in range(4):
        write(source, f"p{k}.json", [k])
    write(source, "bad.json", [], text='{"id": "x" broken')
    report = ledger.run_open_parts(spark, str(source), target, worker(spark, seen))
    assert [p.rsplit("/", 1)[1] for p in report.failed] == ["bad.json"] and len(report.finished) == 4
    assert ids(spark, target) == [0, 1, 2, 3]
    time.sleep(1.1)
    write(source, "bad.json", [7])
    write(source, "p0.json", [50])  # changed since
    seen.clear()
    ledger.run_open_parts(spark, str(source), target, worker(spark, seen))
    assert seen == [["bad.json", "p0.json"]] and ids(spark, target) == [1, 2, 3, 7, 50]
