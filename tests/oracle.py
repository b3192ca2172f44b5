"""Run registered queries next to their DuckDB oracles and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([_plain(row[i]) for i in order]) for row in rows)


def compare(spark, connection, name, query, sql, sf_dir):
    """(rows, seconds, message); the message is empty when both agree."""
    start = time.time()
    frame = query(spark, sf_dir)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    seconds = time.time() - start
    if sql is None:
        return len(got[1]), seconds, ""
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if got[0] != want[0]:
        return len(got[1]), seconds, f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:2]
        lost = [r for r in want[1] if r not in set(got[1])][:2]
        return len(got[1]), seconds, f"{len(got[1])} rows vs {len(want[1])}; extra {extra}; lost {lost}"
    return len(got[1]), seconds, ""


def main(sf_dir: str, only: list[str]) -> int:
    from usagelake.plans import registry
    from usagelake.session import build_session

    spark = build_session("local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                                         "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    connection = connect(sf_dir)
    bad = 0
    for name, query in registry.QUERIES.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            count, seconds, message = compare(
                spark, connection, name, query, registry.ORACLES.get(name), sf_dir)
        except Exception as error:  # report and go on
            count, seconds, message = -1, 0.0, f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(message)
        print(f"{'BAD ' if message else 'ok  '} {name:34s} rows={count:<7d} {seconds:6.2f}s "
              f"{'' if registry.ORACLES.get(name) else '(no oracle) '}{message}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
