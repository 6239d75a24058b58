"""Jumps to any page: records in order, cut into ranges whose sizes are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..columns import DEFAULT, Columns
from ..functions.documents import list_text
from .browse import record_filter

ROWS_PER_RANGE = 1_000_000


def _order(column: int, direction: str, cols: Columns) -> list[Column]:
    value = [F.col(cols.id), F.col(cols.source), F.col(cols.has_diff),
             list_text(F.col(cols.fields))][int(column)]
    first = {"asc": value.asc_nulls_last(), "desc": value.desc_nulls_last()}[direction.lower()]
    return [first, F.col(cols.id).asc_nulls_last()]


def write_rank_index(
    records: DataFrame,
    path: str,
    order_column: int = 0,
    direction: str = "asc",
    rows_per_range: int = ROWS_PER_RANGE,
    cols: Columns = DEFAULT,
) -> None:
    """Store the four table columns of the records in the order of ``browse``, cut into ranges.

    Ranges follow each other in order and grow in number with the records. A value that many
    records share is cut by id, and rows without an id by their place, so no range is hot. Each
    range is one sorted file; their sizes are a small table beside them.
    """
    spark = records.sparkSession
    ranges = max(1, -(-records.count() // rows_per_range))
    order = [*_order(order_column, direction, cols), F.col("_place").asc()]
    rows = records.select(cols.id, cols.source, cols.has_diff, cols.fields) \
        .withColumn("_place", F.monotonically_increasing_id())
    rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()) \
        .sortWithinPartitions("_range", *order).drop("_place") \
        .write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    _rows(spark, path, cols).groupBy("_range").agg(F.count("*").alias("n")) \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/sizes")


def _rows(spark: SparkSession, path: str, cols: Columns) -> DataFrame:
    return spark.read.schema(
        f"`{cols.id}` string, `{cols.source}` string, `{cols.has_diff}` string, "
        f"`{cols.fields}` array<string>, _range int").parquet(f"{path}/rows")


def jump(
    spark: SparkSession,
    path: str,
    order_column: int = 0,
    direction: str = "asc",
    sources: list[str] | None = None,
    fields: list[str] | None = None,
    start: int = 0,
    length: int = 10,
    cols: Columns = DEFAULT,
) -> DataFrame:
    """The page of ``browse`` that begins at ``start``, from a rank index of the same order.

    The sizes say which ranges the page lies in, and only these are read. With sources or
    fields the matching rows of each range are counted first, in one pass over the narrow
    columns. Nothing is sorted but the page, or with such a filter the ranges it lies in. Pages
    beyond the end are empty. Searches need the payloads: see ``browse``.
    """
    rows = _rows(spark, path, cols)
    filtered = bool(sources or fields)
    rows = rows.filter(record_filter("", sources, fields, cols))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("n")) if filtered \
        else spark.read.schema("_range int, n long").parquet(f"{path}/sizes")
    # a row per range: few beside the records, so one task can add them up
    before = F.sum("n").over(Window.orderBy("_range")) - F.col("n")
    touched = sizes.withColumn("before", before) \
        .where((F.col("before") < start + length) & (F.col("before") + F.col("n") > start)) \
        .orderBy("_range").collect()
    numbers = [r["_range"] for r in touched]
    found = rows.filter(F.col("_range").isin(numbers) if numbers else F.lit(False))
    offset = start - touched[0].before if touched else 0
    place = F.struct("_range", F.col("_metadata.row_index"))
    if not filtered:  # then a row's place in its file is its place in the range
        at = F.lit(0).cast("long")
        for r in touched:
            at = F.when(F.col("_range") == r["_range"], F.lit(r.before)).otherwise(at)
        rank = at + F.col("_metadata.row_index")
        found, offset = found.filter((rank >= start) & (rank < start + length)), 0
    return found.withColumn("_place", place).orderBy("_place").offset(offset).limit(length) \
        .select(cols.id, cols.source, cols.has_diff,
                list_text(F.col(cols.fields)).alias(cols.fields))
