"""Choice of extract files: newest full extract and the daily ones since."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.filenames import first_date, parse_filename


def parse_filenames(df: DataFrame, path: str = "path", strict: bool = True) -> DataFrame:
    """Add the seven parts of each extract file name; null parts if lenient and invalid."""
    return df.select("*", F.inline(parse_filename(F.col(path), strict)))


def extracted_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Extract files only, folders left out."""
    return files.filter(
        ~F.col(path).endswith("/") & F.col(path).contains(fixed.EXTRACTED_MARK))


def requested_sources(
    files: DataFrame, sources: list[str] | str | None = None, key: str | None = None
) -> DataFrame:
    """Add ``source`` and its ``ordinal`` in the request.

    The request is a list or a comma-separated text. A file belongs to every requested
    source its ``key`` starts with: by default the column ``key`` of a listing, where there is
    one, else ``path``. Without a request the default sources are used.
    """
    key = key or ("key" if "key" in files.columns else "path")
    if isinstance(sources, str):
        sources = [name.strip() for name in sources.split(",")]
    names = list(dict.fromkeys(sources or fixed.DEFAULT_SOURCES))
    asked = F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("source"))
        for i, name in enumerate(names)])
    matching = F.filter(asked, lambda s: F.col(key).startswith(s["source"]))
    return files.select("*", F.inline(matching))


def since_last_full(
    files: DataFrame, path: str = "path", source: str = "source"
) -> DataFrame:
    """Per source: files of the newest full extract, then daily files from that date on.

    A source without a full extract gives no rows. The newest date per source is aggregated
    before the shuffle and joined back, so no source is handled by one task; Spark
    broadcasts the dates if they turn out small and splits a hot source if not. Sort by
    ``ordinal`` (or source), ``daily`` and path for the order of processing.
    """
    is_full = F.col(path).contains(fixed.FULL_MARK)
    is_daily = F.col(path).contains(fixed.DAILY_MARK)
    kinds = F.array_compact(F.array(F.when(is_full, 0), F.when(is_daily, 1)))
    dated = (
        files.select("*", F.explode(kinds).alias("daily"))
        .withColumn("extract_date", first_date(F.col(path)))
    )
    newest = (
        dated.filter(F.col("daily") == 0)
        .groupBy(source).agg(F.max("extract_date").alias("full_date"))
    )
    chosen = dated.join(newest, source).filter(
        F.when(F.col("daily") == 0, F.col("extract_date") == F.col("full_date"))
        .otherwise(F.col("extract_date") >= F.col("full_date")))
    return chosen.select(*files.columns, "daily", "extract_date")


def input_manifest(
    files: DataFrame, sources: list[str] | str | None = None, path: str = "path",
    key: str | None = None,
) -> DataFrame:
    """Input files of all requested sources in processing order."""
    asked = requested_sources(extracted_files(files, path), sources, key)
    return since_last_full(asked, path, "ordinal").orderBy("ordinal", "daily", path)
