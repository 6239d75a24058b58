"""Apply two versions of a transform to the same input."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..columns import DEFAULT, Columns
from ..functions.filenames import version_label
from ..session import scratch_dir
from ..sources.datasets import FAILED, read_dataset, without_failed, write_dataset
from .collate import union_versions
from .isolation import ERROR, ERROR_TYPE, Isolated

Transform = Callable[[DataFrame], DataFrame]


class VersionFailed(RuntimeError):
    """Parts of the input failed in strict mode."""


class VersionRun(NamedTuple):
    """``rejects``: rows that failed by their values. ``failures``: version, part, row and message
    of what isolated transforms could not take."""

    a: DataFrame
    b: DataFrame
    rejects: DataFrame
    failures: DataFrame


def version_path(output: str, label: str) -> str:
    return f"{output}/transformed/{label}/dataset"


def run_versions(
    inputs: DataFrame,
    transform_a: Transform,
    transform_b: Transform,
    strict: bool = True,
    failed: Column | None = None,
    cols: Columns = DEFAULT,
    staging: str | None = None,
) -> VersionRun:
    """Run both transforms over ``inputs``, each once: its output is stored below ``staging``
    (by default a new scratch folder) with a flag for failed rows, and all results read that.

    A row has failed when ``failed`` holds; by default when it has no payload and is not a
    deletion, which is what a transform built on Spark's ``try_*`` functions leaves. Transforms
    that may raise are wrapped in ``Isolated``, which turns what fails into rows with an error.
    Strict mode ends the job if a row failed; for isolated transforms it does so once both have
    run, and says how many of the parts of both runs failed. Lenient mode goes on without the
    failed rows and hands them over.
    """
    if failed is None:
        failed = F.col(cols.payload).isNull() & (
            F.coalesce(F.col(cols.action), F.lit("")) != fixed.DELETE_ACTION)
    staging = staging or scratch_dir(inputs.sparkSession, "staged")
    kept, rejected, failures, parts = {}, {}, {}, 0
    for label, transform in (("a", transform_a), ("b", transform_b)):
        out = inputs.transform(transform)
        if ERROR not in out.columns:
            out = out.withColumn(ERROR, F.lit(None).cast(ERROR_TYPE))
        wrong = F.col(ERROR).isNotNull() | F.coalesce(failed, F.lit(False))
        # the flag is computed from the stored columns' values in the same step, so both agree
        flagged = out.withColumn(FAILED, wrong)
        path = version_path(staging, label)
        flagged.write.mode("overwrite").parquet(path)
        stored = inputs.sparkSession.read.schema(flagged.schema).parquet(path)
        kept[label] = stored.filter(~F.col(FAILED)).drop(FAILED, ERROR)
        bad = stored.filter(FAILED)
        rejected[label] = bad.filter(F.col(ERROR).isNull()).select(*cols.version)
        failures[label] = bad.filter(F.col(ERROR).isNotNull()).select(f"{ERROR}.*")
        if strict:
            first = rejected[label].select(cols.id).first()
            if first is not None:
                raise ValueError(fixed.VERSION_FAILED.format(label, first[0]))
            parts += transform.count_parts(inputs) if isinstance(transform, Isolated) else 0
    rejects, wrong = union_versions(rejected), _listed(failures)
    if strict and parts:
        n = wrong.select("version", "part").distinct().count()
        if n:
            raise VersionFailed(fixed.PARTS_FAILED.format(n, parts))
    return VersionRun(kept["a"], kept["b"], rejects.limit(0) if strict else rejects, wrong)


def _listed(failures: dict[str, DataFrame]) -> DataFrame:
    return union_versions(failures).select("version", *ERROR_TYPE.names)


def read_failures(spark: SparkSession, output: str) -> DataFrame:
    """version, part, row and message of everything that failed in a stored lenient run."""
    stored = {label: spark.read.parquet(version_path(output, label)) for label in "ab"}
    return _listed({
        label: df.filter(F.col(FAILED) & F.col(ERROR).isNotNull()).select(f"{ERROR}.*")
        for label, df in stored.items()})


def write_versions(
    run: VersionRun, output: str, partition_by: list[str] | None = None,
    cols: Columns = DEFAULT,
) -> None:
    """Store both versions, and the rejects of a lenient run, below ``output``."""
    for label, version in (("a", run.a), ("b", run.b)):
        write_dataset(version.select(*cols.version), version_path(output, label),
                      partition_by, keep_other_partitions=False)
    write_dataset(run.rejects, f"{output}/rejects")


def read_labelled_versions(spark: SparkSession, output: str) -> DataFrame:
    """Rows of both stored versions, with the version named by the path of their file."""
    named = F.substring_index(version_label(F.col("_metadata.file_path")), "/", 1)
    both = [without_failed(read_dataset(spark, version_path(output, label)))
            .withColumn("version", named) for label in "ab"]
    return both[0].drop(ERROR).unionByName(both[1].drop(ERROR))
