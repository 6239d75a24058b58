"""Column names and schemas. Names are parameters; every operator takes a ``Columns``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Columns:
    """Names of the columns the operators read and produce."""

    id: str = "record_id"
    source: str = "source"
    run_date: str = "run_date"
    run_type: str = "run_type"
    action: str = "action"
    payload: str = "transformed_record"
    row_key: str = "row_key"
    record_a: str = "record_a"
    record_b: str = "record_b"
    document: str = "ab_diff"
    fields: str = "modified_fields"
    has_diff: str = "has_diff"
    missing: str = "a_or_b_missing"

    @property
    def version(self) -> list[str]:
        """Columns read from the dataset of one version."""
        return [self.id, self.source, self.run_date, self.run_type, self.action, self.payload]

    @property
    def matrix_fixed(self) -> list[str]:
        """Matrix columns that are not changed fields."""
        return [self.id, self.source, self.has_diff, self.missing]

    @property
    def final_fixed(self) -> list[str]:
        """Columns of the final records that are not changed fields."""
        return [self.id, self.source, self.record_a, self.record_b, self.document,
                self.fields, self.has_diff, self.missing]

    @property
    def payloads(self) -> list[str]:
        """Columns left out of the queryable matrix view."""
        return [self.record_a, self.record_b, self.document, self.fields, self.has_diff]


DEFAULT = Columns()


def version_schema(cols: Columns = DEFAULT) -> T.StructType:
    return T.StructType([
        T.StructField(cols.id, T.StringType()),
        T.StructField(cols.source, T.StringType()),
        T.StructField(cols.run_date, T.DateType()),
        T.StructField(cols.run_type, T.StringType()),
        T.StructField(cols.action, T.StringType()),
        T.StructField(cols.payload, T.BinaryType()),
    ])


def collated_schema(cols: Columns = DEFAULT) -> T.StructType:
    return T.StructType([
        T.StructField(cols.row_key, T.StringType()),
        T.StructField(cols.id, T.StringType()),
        T.StructField(cols.source, T.StringType()),
        T.StructField(cols.run_date, T.DateType()),
        T.StructField(cols.run_type, T.StringType()),
        T.StructField(cols.action, T.StringType()),
        T.StructField(cols.record_a, T.BinaryType()),
        T.StructField(cols.record_b, T.BinaryType()),
    ])


def diffs_schema(cols: Columns = DEFAULT) -> T.StructType:
    return T.StructType([
        T.StructField(cols.id, T.StringType()),
        T.StructField(cols.source, T.StringType()),
        T.StructField(cols.record_a, T.BinaryType()),
        T.StructField(cols.record_b, T.BinaryType()),
        T.StructField(cols.document, T.StringType()),
        T.StructField(cols.fields, T.ArrayType(T.StringType())),
        T.StructField(cols.has_diff, T.StringType()),
    ])


def final_schema(fields: list[str], cols: Columns = DEFAULT) -> T.StructType:
    """Diffs columns, the missing-side flag and one long column per changed field."""
    schema = diffs_schema(cols).add(cols.missing, T.IntegerType())
    for name in fields:
        schema = schema.add(name, T.LongType())
    return schema
