"""Runs registered queries and their SQL on one folder and compares the rows: python tests/compare.py FOLDER [NAME...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def normal(value: object) -> object:
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(normal, value))
    return int(value) if type(value).__name__ == "Decimal" and value == int(value) else value


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs, or nothing."""
    ours, theirs = rows_of(df.columns, df.collect()), con.execute(sql)
    theirs = rows_of([d[0] for d in theirs.description], theirs.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} and {len(theirs[1])} rows"
    for a, b in zip(ours[1], theirs[1], strict=True):
        if a != b:
            return f"{a} and {b}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).parents[1]))
    import __spark_entry__ as entry

    from basewise.session import session

    spark = session("compare", "local[4]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_driver_memory="6g", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sys.argv[1]), entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or oracles:
        began = time.time()
        try:
            said = difference(queries[name](spark, sys.argv[1]), con, oracles[name]) if name in oracles else f"no SQL; {queries[name](spark, sys.argv[1]).count()} rows"
        except Exception as e:  # the next query still runs
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
