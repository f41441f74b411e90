"""Compare each registered query with its SQL: schema, row count and values, rows in any order."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
# Spark type -> SQL type of the oracle's engine.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def _same(left, right) -> bool:
    if isinstance(left, float) and isinstance(right, float):
        return math.isclose(left, right, rel_tol=0, abs_tol=2e-9)
    return left == right and isinstance(left, type(right))


def difference(frame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    types = [str(c[1]) for c in cursor.description]
    expected = cursor.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} instead of {sorted(columns)}"
    wanted = dict(zip(columns, types))
    for field in frame.schema.fields:
        if TYPES[field.dataType.simpleString()] != wanted[field.name]:
            return f"{field.name} is {field.dataType.simpleString()}, the oracle has {wanted[field.name]}"
    got = [tuple(r) for r in frame.select(*columns).collect()]
    if len(got) != len(expected):
        return f"{len(got)} rows instead of {len(expected)}"
    for left, right in zip(sorted(got, key=_key), sorted(expected, key=_key)):
        if not all(_same(a, b) for a, b in zip(left, right)):
            return f"{left} instead of {right}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = difference(query(spark, sf_dir), con, oracle[name])
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{name:32s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
