"""Latest state per record and the A/B join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..columns import DEFAULT, Columns


def latest_state(
    df: DataFrame,
    cols: Columns = DEFAULT,
    tie_break: list[Column] | None = None,
    drop_deleted: bool = True,
    drop_null_ids: bool = False,
) -> DataFrame:
    """Newest row of every record id.

    Newest run date first, then ``daily`` before ``full``, then ``delete`` before
    ``index``. Ties go to ``tie_break``, then to the remaining columns, so that the choice
    is the same on every run. The row filter lets Spark keep one row per id in each map
    task before the shuffle, so a hot id never reaches one task whole.
    """
    if drop_null_ids:
        df = df.filter(F.col(cols.id).isNotNull())
    order = [
        F.col(cols.run_date).desc_nulls_last(),
        F.col(cols.run_type).asc_nulls_last(),
        F.col(cols.action).asc_nulls_last(),
        *(tie_break or []),
        *[F.col(name).asc_nulls_last() for name in (cols.source, cols.payload)
          if name in df.columns],
    ]
    window = Window.partitionBy(cols.id).orderBy(*order)
    newest = (
        df.withColumn("_position", F.row_number().over(window))
        .filter(F.col("_position") == 1).drop("_position")
    )
    return keep_present(newest, cols) if drop_deleted else newest


def keep_present(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Drop deleted records. A null action is dropped too, as its comparison is null."""
    return df.filter(F.col(cols.action) != fixed.DELETE_ACTION)


def row_key(columns: list[str]) -> Column:
    """Stable row id: a digest of the given columns. Each value comes with its length, so that
    no two rows of different values share a key; null differs from empty text."""
    values = [F.col(c).cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.length(v), F.lit(":"), v), F.lit("-")) for v in values]
    return F.sha2(F.concat_ws("|", *parts), 256)


def join_versions(a: DataFrame, b: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Full outer join of A and B on record id, describing columns taken from A, then B.

    An id held m times by A and n times by B gives m x n rows; reduce each side with
    ``latest_state`` first, as ``collate`` does, to get one.
    """
    left, right = a.alias("a"), b.alias("b")
    joined = left.join(right, F.col(f"a.{cols.id}") == F.col(f"b.{cols.id}"), "full_outer")
    described = [cols.id, cols.source, cols.run_date, cols.run_type, cols.action]
    return joined.select(
        *[F.coalesce(f"a.{name}", f"b.{name}").alias(name) for name in described],
        F.col(f"a.{cols.payload}").alias(cols.record_a),
        F.col(f"b.{cols.payload}").alias(cols.record_b))


def collate(
    a: DataFrame,
    b: DataFrame,
    cols: Columns = DEFAULT,
    tie_break: list[Column] | None = None,
    drop_null_ids: bool = False,
) -> DataFrame:
    """Latest A beside latest B for every record that is not deleted.

    Window and join use the same key, so each side is shuffled once.
    """
    sides = [
        latest_state(side.select(*cols.version) if tie_break is None else side, cols,
                     tie_break, drop_deleted=False, drop_null_ids=drop_null_ids)
        for side in (a, b)
    ]
    present = keep_present(join_versions(*sides, cols), cols)
    described = [cols.id, cols.source, cols.run_date, cols.run_type, cols.action]
    return present.select(
        row_key(described).alias(cols.row_key), *described, cols.record_a, cols.record_b)


def union_versions(versions: dict[str, DataFrame]) -> DataFrame:
    """Rows of several versions in one frame, with their label in ``version``."""
    labelled = [df.withColumn("version", F.lit(label)) for label, df in versions.items()]
    return reduce(DataFrame.unionByName, labelled)
