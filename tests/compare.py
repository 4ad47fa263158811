"""Run registered queries beside their SQL twins on the same tables and report differences."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _text(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return repr(value + 0.0)
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(_text(r[k]) for k in order) for r in rows)


def differences(name, spark_df, con, sql) -> list[str]:
    names, mine = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.execute(sql)
    other_names, theirs = rows_of([c[0] for c in rel.description], rel.fetchall())
    if names != other_names:
        return [f"{name}: columns {names} != {other_names}"]
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return [f"{name}: {len(mine)} rows vs {len(theirs)}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"]
    return []


def main(sf_dir: str, wanted: list[str]) -> None:
    from fathomgraph.session import build_session
    import __spark_entry__ as entry

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.maxResultSize": "6g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                found = differences(name, df, con, oracles[name])
            else:
                found = []
                print("   rows only:", len(df.collect()))
        except Exception as e:  # noqa: BLE001
            found = [f"{name}: {type(e).__name__} {str(e)[:1500]}"]
        bad += bool(found)
        print(f"{'BAD ' if found else 'ok  '}{name} {time.time() - t:.1f}s", *found, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
