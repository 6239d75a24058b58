"""The whole comparison, from two version datasets to final records and metrics."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..columns import DEFAULT, Columns
from ..operators.checks import duplicate_ids, raise_for
from ..operators.collate import collate
from ..operators.diff import diff_records
from ..operators.matrix import field_matrix, name_list
from ..operators.metrics import count_cells, metrics_document
from ..operators.records import final_records
from ..operators.versions import Transform, run_versions, version_path
from ..sources.datasets import read_dataset, read_version, register_records, write_dataset
from ..sources.runs import publish_run, published_runs


class RunResult(NamedTuple):
    records: DataFrame
    matrix: DataFrame
    cells: DataFrame
    metrics: DataFrame


_PART = "source_part"


def run_diff(
    a: DataFrame,
    b: DataFrame,
    output: str,
    ignore_order: bool = True,
    root_overlap_threshold: float = 0.0,
    write_records: bool = False,
    rebalance: bool = True,
    wide: bool = False,
    cols: Columns = DEFAULT,
    pair_limit: float = 0.0,
    fields: list[str] | None = None,
) -> RunResult:
    """Compare two versions and store the results below ``output``.

    The diffs are written once, to shared storage, before anything else uses them: parsing
    happens once, and a lost executor costs no more than the tasks it ran. The counts the
    checks need are observed during that write. All counts read narrow columns of the
    stored diffs. Every run has a folder of its own, and is published by a numbered commit that
    names it once all checks have passed: a run that fails leaves the one before as it is, and
    runs into one output at the same time are all kept.

    The diffs are partitioned by source and ``has_diff``. The folder names escape the source
    (hive keys can't tell null from empty), the column itself is stored as it is. ``wide`` adds
    a column per changed field to records and matrix, and ``fields`` a column for each of these,
    as ``load_run`` does. ``write_records``
    stores a second copy with these columns in it, for readers other than ``load_run``.
    ``rebalance`` shuffles the diffs once more before the write, for few, even files; otherwise
    each task writes one file per source and flag. Files are sorted by id and have Bloom filters
    of it, for lookups of single records.
    """
    spark = a.sparkSession
    run = uuid.uuid4().hex
    place = f"{output}/runs/{run}"
    diffs = diff_records(
        collate(a, b, cols), cols, ignore_order, root_overlap_threshold,
        keep_missing_flag=True, pair_limit=pair_limit)
    seen = Observation()
    observed = diffs.observe(
        seen,
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.col(cols.record_a).isNull()).alias("record_a_nulls"),
        F.count_if(F.col(cols.record_b).isNull()).alias("record_b_nulls"))
    partitions = [_PART, cols.has_diff]
    write_dataset(_parted(observed, cols), f"{place}/diffs", partitions, rebalance=rebalance,
                  keep_other_partitions=False, cluster_by=cols.id)
    stored = spark.read.schema(_parted(diffs, cols).schema).parquet(f"{place}/diffs")
    if stored.isEmpty():  # such a plan has no observation, and its folder no files
        raise_for({"total_records": 0, "record_a_nulls": 0, "record_b_nulls": 0,
                   "duplicate_ids": 0}, cols)
    raise_for({**seen.get, "duplicate_ids": 0}, cols)
    raise_for({**seen.get, "duplicate_ids": duplicate_ids(stored, cols).first()[0]}, cols)
    stored = _stored(spark, place)
    count_cells(stored, cols, f"{place}/counts")
    if write_records:
        records = _load(spark, place, True, cols, fields).records
        write_dataset(_parted(records, cols), f"{place}/records", partitions,
                      keep_other_partitions=False, cluster_by=cols.id)
    publish_run(spark, output, run)
    result = load_run(spark, output, wide or write_records, cols, run=run, fields=fields)
    if write_records:
        columns = result.records.columns
        records = read_dataset(spark, f"{place}/records").select(
            *[F.col(f"`{name}`") for name in columns])
        result = result._replace(records=records)
    return result


def _parted(diffs: DataFrame, cols: Columns) -> DataFrame:
    return diffs.withColumn(_PART, F.coalesce(F.concat(F.lit("="), cols.source), F.lit("null")))


def load_run(
    spark: SparkSession, output: str, wide: bool = False, cols: Columns = DEFAULT,
    view: str | None = None, run: str | None = None, fields: list[str] | None = None,
) -> RunResult:
    """Results of the run published last, or of the published run of that name.

    Records hold the list of changed fields. With ``wide`` they and the matrix also have a
    column per changed field, whose names come to the driver; with ``fields`` a column for each
    of these instead, changed anywhere or not, and no look for names. ``view`` registers the
    records.
    """
    published = published_runs(spark, output)
    if run is not None:
        published = published.where(F.col("run") == run)
    run = published.agg(F.max_by("run", F.struct("number", "run"))).first()[0]
    if run is None:
        raise ValueError(f"No such published run below {output}")
    result = _load(spark, f"{output}/runs/{run}", wide, cols, fields)
    if view:
        register_records(result.records, view)
    return result


def _stored(spark: SparkSession, place: str) -> DataFrame:
    return read_dataset(spark, f"{place}/diffs").drop(_PART)


def _load(spark: SparkSession, place: str, wide: bool, cols: Columns,
          fields: list[str] | None = None) -> RunResult:
    diffs = _stored(spark, place)
    cells = read_dataset(spark, f"{place}/counts")
    names = fields if fields is not None else name_list(cells) if wide else []
    return RunResult(final_records(diffs, names, cols), field_matrix(diffs, names, cols), cells,
                     metrics_document(cells))


def compare_transforms(
    inputs: DataFrame,
    transform_a: Transform,
    transform_b: Transform,
    output: str,
    strict: bool = True,
    cols: Columns = DEFAULT,
    **options,
) -> RunResult:
    """Run two versions of a transform over the same inputs and compare their results.

    Each version is stored once, below ``output``, failed rows included, which readers drop;
    a lenient run lists its rejects beside them."""
    spark = inputs.sparkSession
    run = run_versions(inputs, transform_a, transform_b, strict, cols=cols, staging=output)
    if not strict:
        write_dataset(run.rejects, f"{output}/rejects")
    a, b = (read_version(spark, version_path(output, label), cols) for label in "ab")
    return run_diff(a, b, output, cols=cols, **options)
