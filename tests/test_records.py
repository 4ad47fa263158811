"""Records over lines: files of many splits give the rows of a whole-file parse."""

import csv
import io
import json
import random

import pytest
from fathomgraph.sources import records
from pyspark.sql import types as T

ROW = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("note", T.StringType())])


def texts(seed, n):
    rng = random.Random(seed)
    pieces = ["plain", 'a "quoted" word', "line\nbreak", "two\n\nbreaks", "comma, and", "ünï 日本", "\r\nwindows", "{[}]", "x" * 300, "\\"]
    return [(k, " ".join(rng.choices(pieces, k=rng.randint(1, 6))), rng.choice(["n", 'say "\n"', "-"])) for k in range(n)]


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("3000", "1")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def write_csv(path, rows):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["id", "text", "note"])
    writer.writerows(rows)
    path.write_bytes(("﻿" if "bom" in path.name else "").encode() + out.getvalue().encode())


@pytest.mark.parametrize("bound", [records.BROADCAST_ROWS, 0])
def test_quoted_csv(spark, tmp_path, small_splits, bound, monkeypatch):
    real = records.split_records
    monkeypatch.setattr(records, "split_records", lambda *a: real(*a, broadcast_rows=bound))
    one, two = texts(1, 300), [(1000 + k, t, n) for k, t, n in texts(2, 150)]
    two.append((5000, "\n".join(f"line {k}, of one long field" for k in range(900)), "end"))  # goes over many splits
    write_csv(tmp_path / "a.csv", one)
    write_csv(tmp_path / "bom.csv", two)
    got = records.read_quoted_csv(spark, str(tmp_path), ROW)
    assert sorted(map(tuple, got.collect())) == sorted(one + two)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10


def test_csv_edges(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,note\n1,"never\nclosed')
    (tmp_path / "b.csv").write_text("id,text,note\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_bytes("id,text,note\r\n7,图,x\r\n\r\n8,,\r\n".encode("gbk"))
    assert records.read_quoted_csv(spark, str(tmp_path / "b.csv"), ROW).collect() == []
    assert records.read_quoted_csv(spark, str(tmp_path / "c.csv"), ROW).collect() == []
    assert [r["id"] for r in records.read_quoted_csv(spark, str(tmp_path / "a.csv"), ROW).collect()] == [1]
    assert sorted(map(tuple, records.read_quoted_csv(spark, str(tmp_path / "d.csv"), ROW, "gbk").collect())) == [(7, "图", "x"), (8, None, None)]


@pytest.mark.parametrize("indent", [None, 1])
def test_json_lists(spark, tmp_path, small_splits, indent):
    kind = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("more", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])
    rows = [{"id": k, "text": t, "more": [{"a": n, "b": "]}"}] * (k % 3)} for k, t, n in texts(3, 400)]
    rows.append({"id": 9999, "text": "long", "more": [{"k": f"value {k}"} for k in range(1500)]})
    for part, name in enumerate(("a.json", "b.json")):
        (tmp_path / name).write_text(json.dumps(rows[part::2], indent=indent, ensure_ascii=False).replace("}, {", "},\n{"))
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "none.json").write_text("")
    got = records.read_json_lists(spark, str(tmp_path), kind)
    want = [(r["id"], r["text"], [tuple(sorted(m.items())) for m in r["more"]]) for r in rows]
    have = [(r["id"], r["text"], [tuple(sorted(m.items())) for m in r["more"]]) for r in got.collect()]
    assert sorted(have) == sorted(want)
