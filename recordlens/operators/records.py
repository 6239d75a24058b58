"""Final records: diffs with their matrix columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import DEFAULT, Columns
from .matrix import field_columns, field_names, missing_flag


def final_records(
    diffs: DataFrame, fields: list[str] | None = None, cols: Columns = DEFAULT
) -> DataFrame:
    """Diffs columns, the missing-side flag and one long 0/1 column per changed field.

    A projection of the diffs: payloads are neither joined nor shuffled.
    """
    names = field_names(diffs, cols) if fields is None else fields
    return diffs.select(
        *cols.final_fixed[:-1], missing_flag(diffs, cols).alias(cols.missing),
        *field_columns(names, cols, "long"))


def join_matrix(diffs: DataFrame, matrix: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Inner join of diffs with a stored matrix on record id, for a matrix kept apart."""
    extra = [name for name in matrix.columns if name not in cols.matrix_fixed]
    flags = matrix.select(
        cols.id, F.col(cols.missing).cast("int").alias(cols.missing),
        *[F.col(f"`{name}`").cast("long").alias(name) for name in extra])
    return diffs.drop(cols.missing).join(flags, cols.id, "inner")
