"""Run named queries against their DuckDB oracles: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


def difference(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when the query and its oracle agree, else what differs."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}; e.g. {[g for g in got if g not in set(want)][:2]} / {[w for w in want if w not in set(got)][:2]}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"{g} vs {w}"
    return None if got else "no rows"


def main() -> None:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf, names = sys.argv[1] if len(sys.argv) > 1 else "0.001", sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            problem = difference(spark, con, sf_dir, query, oracles[name]) if name in oracles else f"{len(query(spark, sf_dir).collect())} rows, no oracle"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - started:.1f}s {(problem or '')[:900]}", flush=True)


if __name__ == "__main__":
    main()
