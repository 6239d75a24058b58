"""Structural diff of collated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import DEFAULT, Columns
from ..functions.canonical import record_deltas
from ..functions.documents import change_document, root_keys
from .matrix import items_of

_CHANGES = (
    "array<struct<field:string,path:string,kind:string,old:string,new:string,"
    "old_indexes:array<int>,new_indexes:array<int>>>"
)


def _missing(cols: Columns) -> Column:
    return F.col(cols.record_a).isNull() | F.col(cols.record_b).isNull()


def record_changes(
    collated: DataFrame,
    cols: Columns = DEFAULT,
    ignore_order: bool = True,
    root_overlap_threshold: float = 0.0,
    pair_limit: float = 0.0,
) -> DataFrame:
    """Add ``modified_fields``, ``changes``, ``has_diff`` and ``a_or_b_missing``.

    Both sides missing: no diff. One side missing: a diff without details. Payloads that
    are equal byte for byte are settled without parsing; only the others are sent to
    Python, as the condition sits inside the arguments. Arrays compare as multisets unless
    ``ignore_order`` is false. Records whose shared share of root keys is below
    ``root_overlap_threshold`` count as changed in every field. Array items are compared
    by value. With a ``pair_limit``, unequal objects (or arrays) in two arrays are paired at the
    least total distance, each pair below the limit, and compared in turn; the distance is
    the part of their single values that differs. Arrays with more than 4,096 pairs of such
    items (64 x 64) are not paired: their items are removed and added. Two unequal records with no root keys at all
    (other JSON than objects) are a diff with no fields.
    """
    a, b = F.col(cols.record_a), F.col(cols.record_b)
    open_row = a.isNotNull() & b.isNotNull() & (a != b)
    compared = collated.withColumn("_delta", record_deltas(
        F.when(open_row, a), F.when(open_row, b), ignore_order, root_overlap_threshold,
        pair_limit))
    one_missing = a.isNull() != b.isNull()
    return compared.select(
        *collated.columns,
        F.coalesce(F.col("_delta.fields"), F.array().cast("array<string>")).alias(cols.fields),
        F.coalesce(F.col("_delta.changes"), F.array().cast(_CHANGES)).alias("changes"),
        F.when(one_missing | F.col("_delta").isNotNull(), "true").otherwise("false")
        .alias(cols.has_diff),
        _missing(cols).cast("int").alias(cols.missing))


def diff_records(
    collated: DataFrame,
    cols: Columns = DEFAULT,
    ignore_order: bool = True,
    root_overlap_threshold: float = 0.0,
    keep_missing_flag: bool = False,
    pair_limit: float = 0.0,
) -> DataFrame:
    """Diffs dataset: payloads (binary, as its schema has them), change document, changed root
    fields and ``has_diff``.

    ``keep_missing_flag`` adds ``a_or_b_missing``, so later steps need not read payloads.
    """
    described = [cols.id, cols.source, cols.record_a, cols.record_b]
    changed = record_changes(
        collated.select(*described), cols, ignore_order, root_overlap_threshold, pair_limit)
    document = F.when(F.col(cols.missing) == 0, change_document("changes"))
    return changed.select(
        F.col(cols.id).cast("string").alias(cols.id),
        F.col(cols.source).cast("string").alias(cols.source),
        *[F.col(side).cast("binary").alias(side) for side in (cols.record_a, cols.record_b)],
        document.alias(cols.document), cols.fields, cols.has_diff,
        *([cols.missing] if keep_missing_flag else []))


def change_table(changed: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """One row per change, from the output of ``record_changes``."""
    return (
        items_of(changed.select(cols.id, cols.source, "changes"), "changes", "c")
        .select(
            cols.id, cols.source, "c.field", "c.path", "c.kind", "c.old", "c.new",
            F.when(F.col("c.kind") == "repetition_changed", F.size("c.old_indexes"))
            .alias("old_repeat"),
            F.when(F.col("c.kind") == "repetition_changed", F.size("c.new_indexes"))
            .alias("new_repeat"))
    )


def key_differences(collated: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Root fields only in A and only in B, for every record."""
    a, b = root_keys(F.col(cols.record_a)), root_keys(F.col(cols.record_b))
    return collated.select(
        cols.id,
        F.array_except(a, b).alias("fields_only_in_a"),
        F.array_except(b, a).alias("fields_only_in_b"))


def flat_changed_fields(a: str, b: str, fields: list[str]) -> Column:
    """Changed fields of two struct columns with the same flat, known fields.

    No JSON and no Python: for typed records this replaces the structural diff. A null
    field counts as absent. Null for a missing side.
    """
    changed = [
        F.when(~F.col(f"{a}.`{name}`").eqNullSafe(F.col(f"{b}.`{name}`")), F.lit(name))
        for name in sorted(fields)
    ]
    return F.when(
        F.col(a).isNotNull() & F.col(b).isNotNull(), F.array_compact(F.array(*changed)))
