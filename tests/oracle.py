"""Run registered queries and their SQL side by side.

    python -m tests.oracle /root/testdata/sf0.01 [name …]
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillstone")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", os.environ.get("SESSION_TZ", "UTC"))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(plain, key=lambda r: tuple(str(v) for v in r))


def compare(frame, connection, sql) -> list[str]:
    """Differences between a Spark result and a SQL result, at most a few of them."""
    result = connection.execute(sql)
    names, want = _rows([d[0] for d in result.description], result.fetchall())
    got_names, got = _rows(frame.columns, frame.collect())
    if names != got_names:
        return [f"columns {got_names} != {names}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}", *[f"got {r}" for r in got[:3]], *[f"want {r}" for r in want[:3]]]
    bad = []
    for mine, theirs in zip(got, want):
        for name, a, b in zip(names, mine, theirs):
            if a != b or type(a) is not type(b):
                bad.append(f"{name}: {a!r} != {b!r} in {mine}"[:400])
    return bad[:4]


def main(folder: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry

    spark, connection = session(), database(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in wanted or list(queries):
        begun = time.time()
        try:
            frame = queries[name](spark, folder)
            if name in oracles:
                problems = compare(frame, connection, oracles[name])
                state = "same" if not problems else "DIFFERENT"
            else:
                problems, state = [], f"rows {len(frame.collect())}"
        except Exception as error:  # report and go on with the next query
            problems, state = [str(error)[:1500]], "ERROR"
        failed += bool(problems)
        print(f"{name:32s} {state:10s} {time.time() - begun:6.2f}s", flush=True)
        for problem in problems:
            print("    " + problem, flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
