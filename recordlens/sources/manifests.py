"""Manifests of input files: listing, reading and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir


_LISTED = "path string, key string, is_folder boolean"

#: Schemes that the listing client knows, and its names for those that Spark users write.
_SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs",
            "viewfs": "viewfs", "abfs": "abfs", "abfss": "abfss"}


def _client_address(root: str) -> str:
    """The folder's address as the listing client takes it."""
    scheme, found, rest = root.partition("://")
    if not found:
        return root
    if scheme.lower() not in _SCHEMES:
        raise ValueError(f"no client lists {scheme}:// folders, give an inventory of them to "
                         f"listed_files: {root}")
    return f"{_SCHEMES[scheme.lower()]}://{rest}"


def listed_files(inventory: DataFrame, root: str = "", path: str = "path") -> DataFrame:
    """The files below ``root`` that an inventory table names, as ``list_files`` gives them.

    For stores that write inventories, or that no client here lists. Any columns may stand
    beside the paths. Rows without a path, folders (paths that end with a slash) and files
    elsewhere are left out; a file named twice counts once. The root is literal text.
    """
    top = root.rstrip("/") + "/" if root else ""
    name = F.col(path)
    found = inventory.where(F.startswith(name, F.lit(top)) & ~F.endswith(name, F.lit("/")))
    return found.select(
        name.alias("path"), F.substring(name, F.lit(len(top) + 1), F.length(name)).alias("key")
    ).distinct()


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``: their ``path``, and their ``key`` below ``root``.

    Every name counts, empty files and names that begin with ``_`` or ``.`` too. One job lists
    the folders of a level, spread over the executors, and finds those of the next one. The
    root is a folder's address, not a pattern. Files are not opened.
    """
    if any(sign in root for sign in "*?[]{}"):
        raise ValueError(f"a folder is needed, not a pattern: {root}")
    top = root.rstrip("/")
    top = top if "://" in top else top.removeprefix("file:")
    address = _client_address(top)

    def children(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(address)
        base = base.rstrip("/")
        for batch in batches:
            for key in batch.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(f"{base}/{key}".rstrip("/")))
                keys = [f.path[len(base) + 1:] for f in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{top}/{k}" for k in keys], pa.string()),
                    pa.array(keys, pa.string()),
                    pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_())],
                    ["path", "key", "is_folder"])

    scratch = scratch_dir(spark, "listing")
    folders, level, levels = spark.range(1).select(F.lit("").alias("key")), 0, []
    while True:
        place = f"{scratch}/level{level}"
        folders.mapInArrow(children, _LISTED).write.parquet(place)
        levels.append(place)
        found = spark.read.schema(_LISTED).parquet(place)
        folders = found.where("is_folder").select("key")
        n = folders.count()
        if not n:
            return spark.read.schema(_LISTED).parquet(*levels).where("NOT is_folder") \
                .select("path", "key")
        folders = folders.repartition(min(n, spark.sparkContext.defaultParallelism * 4), "key")
        level += 1


def read_manifest(spark: SparkSession, value: str, column: str = "path") -> DataFrame:
    """Manifest rows in order: the first column of a ``.csv``, else a comma-separated list.

    Sort by ``position`` where order matters; it grows along a file and, for a manifest of
    several part files, along their names.
    """
    if value.endswith(".csv"):
        # quoted empty fields stay; the lines are read in splits, numbered within each
        rows = spark.read.option("header", "false").csv(value)
        return rows.select(
            F.col("_c0").alias(column),
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line"),
            ).alias("position"))
    items = spark.range(1).select(F.posexplode(F.split(F.lit(value), ",")))
    return items.select(
        F.trim("col").alias(column),
        F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"),
                 F.col("pos").cast("long").alias("line")).alias("position"))


def write_manifest(
    manifest: DataFrame, path: str, order_by: list[str], column: str = "path"
) -> None:
    """One column, no header, rows in order.

    The order runs along the part files by name. A small manifest ends up in one part, as
    AQE merges small range partitions; a large one is not forced through a single task.
    """
    (
        manifest.orderBy(*order_by).select(column)
        .write.mode("overwrite").option("header", "false").csv(path)
    )
