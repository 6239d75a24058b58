"""Record x field change matrix, in long and wide form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import DEFAULT, Columns


def field_list(cols: Columns = DEFAULT) -> Column:
    """Changed fields of a record; empty where none are stored."""
    return F.coalesce(F.col(cols.fields), F.array().cast("array<string>"))


def has_diff_flag(cols: Columns = DEFAULT) -> Column:
    return (F.col(cols.has_diff) == "true").cast("int")


def missing_flag(diffs: DataFrame, cols: Columns = DEFAULT) -> Column:
    """1 if a side is missing; the stored flag where there is one, else from payloads."""
    if cols.missing in diffs.columns:
        return F.col(cols.missing).cast("int")
    return (F.col(cols.record_a).isNull() | F.col(cols.record_b).isNull()).cast("int")


def record_flags(diffs: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """``has_diff`` and ``a_or_b_missing`` as 0/1 for every record."""
    return diffs.select(
        cols.id, cols.source, has_diff_flag(cols).alias(cols.has_diff),
        missing_flag(diffs, cols).alias(cols.missing))


def items_of(df: DataFrame, values: str, name: str) -> DataFrame:
    """One row per item of an array, which takes the array's place.

    For a plain ``explode`` Spark filters the rows by the size of the array first. That filter
    goes below the diff, which then compares every record twice.
    """
    others = [column for column in df.columns if column != values]
    return df.select(*others, F.posexplode_outer(values).alias("_at", name)).where(
        F.col("_at").isNotNull()).drop("_at")


def field_cells(diffs: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Long form: one row per record and changed field.

    Records with a missing side have none, as the diff leaves their field list empty.
    """
    return items_of(diffs.select(cols.id, cols.source, cols.fields), cols.fields, "field")


def changed_fields(diffs: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Distinct fields changed in at least one record."""
    return items_of(diffs.select(cols.fields), cols.fields, "field").distinct()


def distinct_sources(diffs: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    return diffs.select(cols.source).distinct()


def name_list(fields: DataFrame) -> list[str]:
    """Distinct values of the column ``field`` as a sorted list, to become column names.

    Only a wide matrix needs it, since its schema is made of the names; the stored list of
    changed fields, the long form and all counts work without.
    """
    named = fields.filter(F.col("field").isNotNull()).select("field").distinct()
    return sorted(row.field for row in named.collect())


def field_names(diffs: DataFrame, cols: Columns = DEFAULT) -> list[str]:
    """Fields changed in at least one record, sorted."""
    return name_list(changed_fields(diffs, cols))


def matrix_columns(fields: list[str], cols: Columns = DEFAULT) -> dict[str, str]:
    """Column name of each field.

    A field named like a fixed column, or like an earlier field in other letter case, gets
    the prefix ``field_``.
    """
    taken = {name.lower() for name in cols.final_fixed}
    names = {}
    for field in fields:
        name = field
        while name.lower() in taken:
            name = f"field_{name}"
        taken.add(name.lower())
        names[field] = name
    return names


def field_columns(
    fields: list[str], cols: Columns = DEFAULT, data_type: str = "int"
) -> list[Column]:
    return [
        F.array_contains(field_list(cols), field).cast(data_type).alias(name)
        for field, name in matrix_columns(fields, cols).items()
    ]


def field_matrix(
    diffs: DataFrame, fields: list[str] | None = None, cols: Columns = DEFAULT
) -> DataFrame:
    """Wide form: flags and one 0/1 column per changed field, for every record.

    The changed fields sit in the record's own row, so the matrix is a projection: no
    pivot, no join and no shuffle. Without ``fields`` they are looked up first.
    """
    names = field_names(diffs, cols) if fields is None else fields
    return diffs.select(
        cols.id, cols.source, has_diff_flag(cols).alias(cols.has_diff),
        missing_flag(diffs, cols).alias(cols.missing), *field_columns(names, cols))
