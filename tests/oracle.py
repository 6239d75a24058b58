"""Runs queries beside their SQL in DuckDB and compares all values."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(plain(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((v is None, type(v).__name__, v) for v in row))


def compare(spark, con, query, sql, sf_dir):
    """Return None if equal, else a message."""
    found = query(spark, sf_dir).toArrow()
    expected = con.sql(sql).to_arrow_table()
    if sorted(found.column_names) != sorted(expected.column_names):
        return f"columns {found.column_names} / {expected.column_names}"
    for name in found.column_names:
        a, b = found.schema.field(name).type, expected.schema.field(name).type
        if str(a).removeprefix("large_") != str(b).removeprefix("large_"):
            return f"type of {name}: {a} / {b}"
    left = rows_of(found.column_names, list(zip(*[c.to_pylist() for c in found.columns])))
    right = rows_of(expected.column_names, list(zip(*[c.to_pylist() for c in expected.columns])))
    if len(left) != len(right):
        return f"{len(left)} rows / {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"row {a} / {b}"
    return None if left else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in names:
        start = time.time()
        try:
            result = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
        except Exception as error:  # report and go on with the next query
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:28s} {time.time() - start:6.2f}s {result or 'ok'}", flush=True)
