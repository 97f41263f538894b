"""Compare a registered query with its statement, value by value.

Run as a script: ``python tests/compare.py [folder] [name ...]``.
"""

from __future__ import annotations

import contextlib
import io
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Spark type -> the type the other engine must report.
SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        files = path / "*.parquet" if path.is_dir() else path
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{files}'")
    return connection


def differences(df: DataFrame, connection: duckdb.DuckDBPyConnection, statement: str) -> list[str]:
    relation = connection.sql(statement)
    expected_types = dict(zip(relation.columns, [str(t) for t in relation.types]))
    actual_types = {name: SAME_TYPE.get(kind, kind) for name, kind in df.dtypes}
    if expected_types != actual_types:
        odd = {
            name: (actual_types.get(name), expected_types.get(name))
            for name in {*actual_types, *expected_types}
            if actual_types.get(name) != expected_types.get(name)
        }
        return [f"types differ (ours, expected): {odd}"]
    columns = sorted(expected_types)
    actual = [tuple(row[c] for c in columns) for row in df.collect()]
    at = [relation.columns.index(c) for c in columns]
    expected = [tuple(row[i] for i in at) for row in relation.fetchall()]
    if len(actual) != len(expected):
        return [f"{len(actual)} rows, expected {len(expected)}"]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    pairs = list(zip(sorted(actual, key=key), sorted(expected, key=key)))
    return [f"{columns}: {a} expected {e}" for a, e in pairs if a != e][:5]


def plan(df: DataFrame) -> str:
    """The plan as text; the one that ran, once the frame has run."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    from bazaarlens.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark, connection, bad = local_session("compare"), connect(sf_dir), 0
    for name in names:
        began = time.perf_counter()
        try:
            df = queries()[name](spark, sf_dir)
            found = differences(df, connection, oracle_sql()[name])
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        print(f"{'BAD ' if found else 'ok  '} {name} {time.perf_counter() - began:.2f}s", *found, sep="\n     " if found else "")
    print(f"{len(names) - bad} of {len(names)} agree")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
