"""Queries over the final records: filter, search, sort, page, look up."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..columns import DEFAULT, Columns
from ..functions.canonical import root_sorted
from ..functions.documents import any_of, list_text, payload_contains, root_keys
from .matrix import field_list


def record_filter(
    search: str = "",
    sources: list[str] | None = None,
    fields: list[str] | None = None,
    cols: Columns = DEFAULT,
) -> Column:
    """All of the given conditions; true for every row when none is given.

    ``search`` is a literal, case-sensitive substring of either payload.
    """
    conditions = []
    if sources:
        conditions.append(F.col(cols.source).isin(list(sources)))
    if fields:
        conditions.append(any_of(F.col(cols.fields), fields))
    if search:
        conditions.append(
            payload_contains([F.col(cols.record_a), F.col(cols.record_b)], search))
    return reduce(and_, conditions, F.lit(True))


def filtered_records(records: DataFrame, condition: Column, cols: Columns = DEFAULT) -> DataFrame:
    """The four table columns of the matching records."""
    return records.filter(condition).select(
        cols.id, cols.source, cols.has_diff,
        list_text(F.col(cols.fields)).alias(cols.fields))


def browse(
    records: DataFrame,
    search: str = "",
    sources: list[str] | None = None,
    fields: list[str] | None = None,
    order_column: int = 0,
    direction: str = "asc",
    start: int = 0,
    length: int = 10,
    after: tuple | None = None,
    cols: Columns = DEFAULT,
) -> DataFrame:
    """One page of matching records.

    ``after`` (value of the ordering column, id) is the last row of the page before: the next
    page then costs the same at any depth, while ``start`` counts all rows before it.
    Rows of one value that have no id share the last place there: give pages of such rows by
    ``start``.

    ``order_column`` is 0 id, 1 source, 2 has_diff, 3 modified fields (as text). Nulls come
    last in both directions and ties are ordered by id. Spark plans this as a top-k: only
    the four narrow columns are sorted and no full sort takes place.
    """
    column = F.col([cols.id, cols.source, cols.has_diff, cols.fields][int(order_column)])
    order = {"asc": column.asc_nulls_last(), "desc": column.desc_nulls_last()}
    matching = filtered_records(records, record_filter(search, sources, fields, cols), cols)
    if after is not None:
        value, record_id = (F.lit(x) for x in after)
        beyond = column > value if direction.lower() == "asc" else column < value
        beyond = F.when(value.isNull(), False).otherwise(beyond | column.isNull())
        behind = F.when(record_id.isNull(), False).otherwise(
            F.col(cols.id).isNull() | (F.col(cols.id) > record_id))
        matching = matching.filter(beyond | (column.eqNullSafe(value) & behind))
    return (
        matching.orderBy(order[direction.lower()], F.col(cols.id).asc_nulls_last())
        .offset(start).limit(length)
    )


def browse_counts(
    records: DataFrame,
    search: str = "",
    sources: list[str] | None = None,
    fields: list[str] | None = None,
    cols: Columns = DEFAULT,
) -> DataFrame:
    """Number of all records and of matching records, in one scan."""
    condition = record_filter(search, sources, fields, cols)
    return records.agg(
        F.count("*").alias("records_total"),
        F.count_if(F.coalesce(condition, F.lit(False))).alias("records_filtered"))


def record_payloads(records: DataFrame, record_id, cols: Columns = DEFAULT) -> DataFrame:
    """A and B of one record, root keys in order. No row for an unknown id.

    On the stored records of a run this reads only the pages around the id of the row groups
    whose Bloom filter knows it."""
    found = records.filter(F.col(cols.id) == record_id)
    return found.select(
        cols.id,
        root_sorted(F.col(cols.record_a)).alias(cols.record_a),
        root_sorted(F.col(cols.record_b)).alias(cols.record_b))


def record_summaries(records: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Number and list of changed fields, and fields on one side only, per record."""
    a, b = root_keys(F.col(cols.record_a)), root_keys(F.col(cols.record_b))
    return records.select(
        cols.id,
        F.size(field_list(cols)).alias("fields_changed"),
        field_list(cols).alias(cols.fields),
        F.array_except(a, b).alias("fields_only_in_a"),
        F.array_except(b, a).alias("fields_only_in_b"))


def record_summary(
    records: DataFrame, record_id, strict: bool = False, cols: Columns = DEFAULT
) -> DataFrame:
    """Summary of one record; strict mode raises for an unknown id."""
    summary = record_summaries(records.filter(F.col(cols.id) == record_id), cols)
    if strict and summary.isEmpty():
        raise ValueError(fixed.UNKNOWN_RECORD.format(id=cols.id, value=record_id))
    return summary
