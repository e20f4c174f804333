"""Runs queries and their SQL twins side by side: python tests/oracle_check.py [sf_dir] [query ...]"""

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark_frame, con, sql):
    """None where both sides agree, else a description of the difference."""
    ours = _rows(spark_frame.columns, [tuple(r) for r in spark_frame.collect()])
    result = con.execute(sql)
    theirs = _rows([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} against {theirs[0]}"
    if ours[1] != theirs[1]:
        only_ours = sorted(set(ours[1]) - set(theirs[1]))[:3]
        only_theirs = sorted(set(theirs[1]) - set(ours[1]))[:3]
        return f"{len(ours[1])} rows against {len(theirs[1])}: {only_ours} / {only_theirs}"
    return None


def types(spark_frame, con, sql):
    ours = {f.name: f.dataType.simpleString() for f in spark_frame.schema.fields}
    names = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean"}
    theirs = {r[0]: names.get(r[1], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {c: (ours[c], theirs.get(c)) for c in ours if ours[c] != theirs.get(c)}


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    con, texts = connect(sf_dir), entry.oracle_sql()
    wanted = sys.argv[2:] or list(entry.queries())
    for name in wanted:
        start = time.time()
        try:
            frame = entry.queries()[name](spark, sf_dir)
            if name in texts:
                mid = time.time()
                said = compare(frame, con, texts[name]) or "ok"
                off = types(frame, con, texts[name])
                print(f"{name:24s} {time.time() - start:6.2f}s  {said} {off or ''}", flush=True)
            else:
                print(f"{name:24s} rows only: {len(frame.collect())} {time.time() - start:6.2f}s", flush=True)
        except Exception as problem:
            print(f"{name:24s} FAILED {type(problem).__name__}: {str(problem)[:600]}", flush=True)
