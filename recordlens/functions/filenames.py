"""Column expressions over file names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

_SEPARATOR = "\u0001"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parse_filename(path: Column, strict: bool = True) -> Column:
    """The seven parts of an extract file name, as an array of one struct.

    The pattern is applied once; the array binds its result for the parts (``inline`` it to
    get columns). A name that does not match fails the job in strict mode and gives a null
    struct otherwise.
    """
    name = basename(path)
    split_name = F.split(
        F.regexp_replace(
            name, fixed.EXTRACT_FILENAME_PATTERN,
            _SEPARATOR.join(f"${i + 1}" for i in range(len(fixed.EXTRACT_FILENAME_PARTS)))),
        _SEPARATOR)

    def as_struct(parts: Column) -> Column:
        fields = F.struct(*[
            F.nullif(parts[i], F.lit("")).alias(part)
            for i, part in enumerate(fixed.EXTRACT_FILENAME_PARTS)])
        matched = F.when(F.size(parts) == len(fixed.EXTRACT_FILENAME_PARTS), fields)
        if not strict:
            return matched
        return matched.otherwise(F.raise_error(F.concat(
            F.lit(fixed.INVALID_FILENAME),
            F.coalesce(name, F.lit("null")), F.lit("."))))

    return F.transform(F.array(split_name), as_struct)


def version_label(path: Column, strict: bool = True) -> Column:
    """Version (``a`` or ``b``) named by the path of a transformed file."""
    label = F.regexp_extract(path, fixed.VERSION_PATH_PATTERN, 1)
    matched = F.coalesce(path.rlike("^" + fixed.VERSION_PATH_PATTERN), F.lit(False))
    if strict:
        return F.when(matched, label).otherwise(F.raise_error(F.concat(
            F.lit(fixed.INVALID_VERSION_PATH),
            F.coalesce(path, F.lit("null")), F.lit("."))))
    return F.when(matched, label)


def first_date(path: Column) -> Column:
    """First date in a path, after at least one character."""
    return F.to_date(F.regexp_extract(path, fixed.EXTRACT_DATE_PATTERN, 1), fixed.DATE_FORMAT)


def run_time(timestamp: Column) -> Column:
    return F.to_timestamp(timestamp, fixed.RUN_TIMESTAMP_FORMAT)
