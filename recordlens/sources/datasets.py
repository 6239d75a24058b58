"""Parquet datasets: scans, partitioned sink, named views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..columns import DEFAULT, Columns, version_schema
from ..operators.collate import latest_state

#: Column of a stored version that marks the rows which are no part of it.
FAILED = "_failed"
MAX_ROWS_PER_FILE = 0  # no limit: rebalancing sizes files by bytes


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Hive-partitioned parquet dataset. Partition values stay text, so a source named ``0123``
    stays so; no session setting is touched."""
    stored = spark.read.parquet(path).schema
    in_files = spark.read.option("recursiveFileLookup", "true").parquet(path).schema.names
    schema = StructType([f if f.name in in_files else StructField(f.name, StringType())
                         for f in stored])
    return spark.read.schema(schema).parquet(path)


def read_version(spark: SparkSession, path: str, cols: Columns = DEFAULT) -> DataFrame:
    """The six columns of one version's dataset, any of them possibly a hive key."""
    df = without_failed(read_dataset(spark, path))
    return df.select(*[
        F.col(f.name).cast(f.dataType).alias(f.name) for f in version_schema(cols)])


def without_failed(stored: DataFrame) -> DataFrame:
    """The rows of a stored version that did not fail."""
    return stored.filter(~F.col(FAILED)).drop(FAILED) if FAILED in stored.columns else stored


def write_dataset(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    max_rows_per_file: int = MAX_ROWS_PER_FILE,
    rows_per_group: int | None = None,
    rebalance: bool = True,
    keep_other_partitions: bool = True,
    cluster_by: str | None = None,
) -> None:
    """Write parquet, replacing the partitions that get rows (or the whole folder).

    Without ``keep_other_partitions`` the whole folder is replaced in any case.
    With hive partitions, ``rebalance`` adds a shuffle that gives each of them files of even
    size in bytes; AQE splits a hot partition over many tasks. Without it every task writes its
    own file per hive partition and nothing is shuffled.

    With ``cluster_by`` the rows of each file are sorted by that column and every row group has
    a Bloom filter of it. A file holds a random part of the values, so a lookup of one value
    reads the pages of at most one row group per file that its filter doesn't rule out.
    """
    keys = partition_by or []
    if rebalance and keys:
        df = df.hint("rebalance", *keys)
    if cluster_by:  # the writer sorts by the hive keys in any case
        df = df.sortWithinPartitions(*keys, cluster_by)
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", max_rows_per_file)
    if cluster_by:
        writer = writer.option(f"parquet.bloom.filter.enabled#{cluster_by}", "true")
    if rows_per_group:
        writer = writer.option("parquet.block.row.count.limit", rows_per_group)
    if keys:
        mode = "dynamic" if keep_other_partitions else "static"
        writer = writer.option("partitionOverwriteMode", mode).partitionBy(*keys)
    writer.parquet(path)


def write_bucketed(
    df: DataFrame, table: str, buckets: int, cols: Columns = DEFAULT, path: str | None = None
) -> DataFrame:
    """Save the latest state of a version as a table bucketed by record id, and return it.

    Two versions with the same number of buckets are collated without any shuffle: both the
    choice of the latest row and the join use the buckets. Worth it when a version is
    compared more than once, such as the released version A against every candidate B.
    """
    # one row per id first, in the map tasks, so that no bucket gets a hot id whole; then one
    # task per bucket writes its file
    df = latest_state(df, cols, drop_deleted=False)
    writer = (
        df.repartition(buckets, cols.id).write.mode("overwrite")
        .bucketBy(buckets, cols.id).sortBy(cols.id)
    )
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def dataset_files(spark: SparkSession, path: str) -> DataFrame:
    """Data files of a dataset with their sizes, from the listing alone."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    )


def register_records(records: DataFrame, name: str = "records") -> DataFrame:
    """Temporary view over the final dataset."""
    records.createOrReplaceTempView(name)
    return records


def query_matrix(
    records: DataFrame,
    query: str,
    parameters: list | dict | None = None,
    cols: Columns = DEFAULT,
    view: str = "record_diff_matrix",
) -> DataFrame:
    """Run a caller's SQL, which may use the view of the matrix columns."""
    records.drop(*cols.payloads).createOrReplaceTempView(view)
    return records.sparkSession.sql(query, args=parameters)
