"""Side-by-side run of the registered queries and their SQL."""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{directory}/{name}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return 0.0 if value == 0 else value
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, 0 if v is None else v) for v in row))


def differences(spark_df, connection, sql: str) -> list[str]:
    """What differs between a Spark result and the SQL result; empty if nothing does."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} / {sorted(names)}"]
    expected = _rows(names, result.fetchall())
    actual = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(actual) != len(expected):
        return [f"rows {len(actual)} / {len(expected)}"]
    found = [f"{a} / {e}" for a, e in zip(actual, expected) if a != e]
    types = [
        f"types {a} / {e}"
        for a, e in zip(actual[:50], expected[:50])
        if [type(x) for x in a] != [type(x) for x in e]
    ]
    return found[:5] + types[:2]


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from tessera.session import build_session

    directory = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session(
        master="local[8]", settings={"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(directory)
    oracles = oracle_sql()
    bad = 0
    for name, run in queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        started = time.time()
        try:
            df = run(spark, directory)
            if name in oracles:
                found = differences(df, connection, oracles[name])
            else:
                found = [] if df.count() else ["no rows"]
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        verdict = "ok" if not found else "DIFF"
        print(f"{verdict:5}{time.time() - started:7.2f}s {name}", *found, sep="\n      ", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
