"""Checks of a collated dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..columns import DEFAULT, Columns


class DatasetCheckError(Exception):
    """A collated dataset failed a check."""


def check_counts(collated: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """One row: records, records without A, without B, and ids held more than once.

    One scan and one shuffle of per-id counts, combined before the shuffle.
    """
    per_id = collated.groupBy(cols.id).agg(
        F.count("*").alias("n"),
        F.count(cols.record_a).alias("with_a"),
        F.count(cols.record_b).alias("with_b"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return per_id.agg(
        total.alias("total_records"),
        (total - F.coalesce(F.sum("with_a"), F.lit(0))).alias("record_a_nulls"),
        (total - F.coalesce(F.sum("with_b"), F.lit(0))).alias("record_b_nulls"),
        F.count_if(F.col("n") > 1).alias("duplicate_ids"))


def duplicate_ids(collated: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """One row: the number of ids held more than once; a null id counts as one id."""
    per_id = collated.groupBy(cols.id).agg(F.count("*").alias("n"))
    return per_id.agg(F.count_if(F.col("n") > 1).alias("duplicate_ids"))


def raise_for(counts: dict, cols: Columns = DEFAULT) -> None:
    """Raise for the counts of an empty, one-sided or repeating dataset."""
    total = counts["total_records"]
    if total == 0:
        raise DatasetCheckError(fixed.EMPTY_DATASET_MESSAGE)
    if total in (counts["record_a_nulls"], counts["record_b_nulls"]):
        raise DatasetCheckError(fixed.EMPTY_RECORDS_MESSAGE.format(
            record_a=cols.record_a, record_b=cols.record_b))
    if counts["duplicate_ids"] > 0:
        raise DatasetCheckError(fixed.DUPLICATE_IDS_MESSAGE.format(id=cols.id))


def validate(collated: DataFrame, cols: Columns = DEFAULT) -> None:
    """Raise if the dataset is empty, lacks one side in every row, or repeats an id."""
    raise_for(check_counts(collated, cols).first().asDict(), cols)
