"""Run history: one row per run, and the input files of each run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filenames import run_time


_COMMITS = "number long, run string, published_at timestamp"


def publish_run(spark: SparkSession, output: str, run: str) -> None:
    """Make a finished run below ``output`` visible.

    A commit is a folder of its own, named by the next number and the run, so that no writer
    shares a temporary folder with another or replaces what it wrote. Runs that publish at once
    may take the same number; the run's name then orders them, for every reader alike. No clock
    and no exclusive create of the store is relied on. A write that breaks off leaves no data
    file in the commit's folder, so the run stays invisible.
    """
    last = published_runs(spark, output).agg(F.max("number")).first()[0]
    number = 0 if last is None else last + 1
    spark.range(1).select(F.current_timestamp().alias("published_at")) \
        .write.mode("overwrite").parquet(f"{output}/commits/number={number}/run={run}")


def published_runs(spark: SparkSession, output: str) -> DataFrame:
    """number, run and published_at of every published run; no rows where there is none yet.
    The last one is the greatest by (number, run)."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{output}/commits")
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return spark.range(0).select(F.from_json(F.lit("{}"), _COMMITS).alias("c")).select("c.*")
    return spark.read.schema(_COMMITS).parquet(f"{output}/commits") \
        .select("number", "run", "published_at")


def read_run_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """Run documents (one JSON file per run), oldest first."""
    runs = spark.read.option("multiLine", "true").json(pattern)
    return runs.orderBy(run_time(F.col("run_timestamp")).asc_nulls_last())


def save_run(
    history: str,
    metrics_document: DataFrame,
    run_timestamp: str,
    message: str | None = None,
    inputs: DataFrame | None = None,
    datasets: dict[str, str] | None = None,
) -> None:
    """Append one run: the rows of its metrics, its locations, and its input files. Each call
    writes folders of its own, so that several may save at once."""
    places, entry = datasets or {}, f"save-{uuid.uuid4().hex}"
    rows = metrics_document.select(
        F.lit(run_timestamp).alias("run_timestamp"),
        F.lit(message).cast("string").alias("run_message"),
        F.create_map(*[F.lit(x) for pair in places.items() for x in pair])
        .cast("map<string,string>").alias("datasets"),
        "part", "source", "field", "metrics")
    if inputs is not None:
        (
            inputs.select(F.lit(run_timestamp).alias("run_timestamp"), "path")
            .write.parquet(f"{history}/inputs/entry={entry}")
        )
    rows.write.parquet(f"{history}/runs/entry={entry}")


def read_history(spark: SparkSession, history: str) -> DataFrame:
    """All saved runs, oldest first: a row per metrics row, the summary's with null names."""
    runs = spark.read.parquet(f"{history}/runs").drop("entry")
    return runs.orderBy(run_time(F.col("run_timestamp")).asc_nulls_last())


def read_run_inputs(spark: SparkSession, history: str) -> DataFrame:
    """Input files of the saved runs. They are stored before the run itself: those of a save
    that broke off belong to no saved run and are left out."""
    saved = spark.read.parquet(f"{history}/runs").select("entry").distinct()
    return spark.read.parquet(f"{history}/inputs").join(saved, "entry", "left_semi") \
        .drop("entry")
