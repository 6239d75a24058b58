"""Counts by source and field.

``count_cells`` reads the diffs once; every other count here is derived from its result,
which has at most one row per source and field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import DEFAULT, Columns
from ..sources.datasets import read_dataset, write_dataset
from .matrix import field_list, has_diff_flag


def count_cells(
    diffs: DataFrame, cols: Columns = DEFAULT, path: str | None = None
) -> DataFrame:
    """Records and changed records per source and field, in one pass.

    A null field stands for the record itself, so those rows hold the record counts. Counts
    are combined before the shuffle, so a hot source costs no more than another. With
    ``path`` they are written there first, so that several counts derived from them do not
    compute the diffs again.
    """
    slots = F.concat(F.array(F.lit(None).cast("string")), field_list(cols))
    cells = (
        diffs.select(
            F.col(cols.source).alias("source"),
            has_diff_flag(cols).cast("long").alias("changed"),
            F.explode(slots).alias("field"))
        .groupBy("source", "field")
        .agg(F.count("*").alias("records"), F.sum("changed").alias("with_diff"))
    )
    if path is None:
        return cells
    write_dataset(cells, path)
    return read_dataset(diffs.sparkSession, path)


def _of_records(column: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("field").isNull(), F.col(column))), F.lit(0))


def percent(part: Column, whole: Column) -> Column:
    """Percentage with two decimals; null for zero records."""
    return F.round(F.try_divide(part, whole) * 100, 2)


def global_counts(cells: DataFrame) -> DataFrame:
    """Total records, changed records and their percentage."""
    totals = cells.agg(
        _of_records("records").alias("total_records"),
        _of_records("with_diff").alias("total_records_with_diff"))
    return totals.withColumn("records_with_diff_percent", percent(
        F.col("total_records_with_diff"), F.col("total_records")))


def source_counts(cells: DataFrame) -> DataFrame:
    """Changed records per source, records with a missing side included."""
    return (
        cells.filter(F.col("field").isNull())
        .select("source", F.col("with_diff").alias("n"))
    )


def field_counts(cells: DataFrame) -> DataFrame:
    """Records changed in each field."""
    return (
        cells.filter(F.col("field").isNotNull())
        .groupBy("field").agg(F.sum("records").alias("n"))
    )


def source_field_counts(cells: DataFrame, zeros: list[str] | None = None) -> DataFrame:
    """Records changed per source and field, of the pairs that occur.

    ``zeros`` names fields for which every source gets a row, with 0 where the pair doesn't
    occur: the fields that a report shows. One aggregate gives both. Cells are used twice then:
    pass stored ones for large diffs. Read the rows by source, or by field for the transposed
    view.
    """
    named = cells.filter(F.col("field").isNotNull()) \
        .select("source", "field", F.col("records").alias("n"))
    if not zeros:
        return named
    asked = cells.filter(F.col("field").isNull()).select(
        "source", F.explode(F.array(*map(F.lit, zeros))).alias("field"),
        F.lit(0).cast("long").alias("n"))
    return named.unionByName(asked).groupBy("source", "field").agg(F.sum("n").alias("n"))


def metrics_rows(cells: DataFrame) -> DataFrame:
    """The metrics as flat rows (``path``, ``value``), for any number of pairs that occur.

    A null source is written ``(null)`` in paths; ``metrics_document`` keeps it apart from a
    source of that name.
    """
    cells = cells.withColumn("source", F.coalesce("source", F.lit("(null)")))
    summary = global_counts(cells).select(F.explode(F.create_map(
        F.lit("summary.total_records"), F.col("total_records").cast("double"),
        F.lit("summary.total_records_with_diff"),
        F.col("total_records_with_diff").cast("double"),
        F.lit("summary.records_with_diff_percent"), F.col("records_with_diff_percent"),
    )).alias("path", "value"))
    value = F.col("n").cast("double").alias("value")
    by_source = source_counts(cells).select(
        F.concat_ws(".", F.lit("analysis.by_source"), "source", F.lit("count")).alias("path"),
        value)
    by_field = field_counts(cells).select(
        F.concat_ws(".", F.lit("analysis.by_field"), "field", F.lit("count")).alias("path"),
        value)
    pairs = source_field_counts(cells).select(
        F.explode(F.array(
            F.concat_ws(".", F.lit("analysis.by_source"), "source",
                        F.lit("field_counts"), "field"),
            F.concat_ws(".", F.lit("analysis.by_field"), "field",
                        F.lit("source_counts"), "source"))).alias("path"),
        value)
    return summary.unionByName(by_source).unionByName(by_field).unionByName(pairs)


def metrics_document(cells: DataFrame) -> DataFrame:
    """The metrics as JSON, one row each (``part``, ``source``, ``field``, ``metrics``): the
    summary, every source, every field, and every pair of them that occurs.

    All rows are grouped aggregates of the cells, so sources, fields and pairs may be any
    number. A null and an empty source have rows of their own, and a field's count includes the
    records of all sources. Cells are used several times: pass stored ones for large diffs.
    """
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, part: str, source: Column, field: Column, *values: Column):
        return df.select(F.lit(part).alias("part"), source.alias("source"),
                         field.alias("field"), F.to_json(F.struct(*values)).alias("metrics"))

    count = F.col("n").alias("count")
    names = cells.agg(F.count_if(F.col("field").isNull()).alias("sources"))
    fields = field_counts(cells).agg(F.count("*")).scalar()
    summary = global_counts(cells).select("*", names.scalar().alias("sources"),
                                          fields.alias("fields_with_diffs"))
    source, field = F.col("source"), F.col("field")
    return rows(summary, "summary", none, none, *map(F.col, summary.columns)) \
        .unionByName(rows(source_counts(cells), "source", source, none, count)) \
        .unionByName(rows(field_counts(cells), "field", none, field, count)) \
        .unionByName(rows(source_field_counts(cells), "pair", source, field, count))
