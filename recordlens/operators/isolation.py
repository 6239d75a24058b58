"""Transforms that go on where some of their input fails."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..columns import DEFAULT, Columns, version_schema

# The helpers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Column beside a version's own: null, or what went wrong with a row of the input.
ERROR = "_error"
ERROR_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("part", "row", "message")])
_PART, _ROW = "_isolated_part", "_isolated_row"


class Isolated:
    """A transform of a function over Arrow tables, called piece by piece in the tasks.

    A piece is a run of up to ``rows_per_call`` rows of one part. If the function raises, or what
    it returns doesn't fit the schema, the piece is halved, down to the rows that fail by
    themselves; each becomes a row with nothing but the ``_error`` column: its part, its label
    and the message. Every other row is transformed as if these weren't there. A piece without a
    failing row is one call. With ``by_row`` the function takes one row as a dict and returns
    one dict, a list of them, or None for no row; each row is then one call, failing or not.

    ``part`` names the unit that counts as failed when a row of it fails, the input file by
    default; ``row`` labels the row in the error.
    """

    def __init__(self, function: Callable, schema: T.StructType | None = None,
                 part: Column | None = None, row: Column | None = None, by_row: bool = False,
                 rows_per_call: int = 1000, cols: Columns = DEFAULT):
        self.function, self.by_row, self.rows_per_call = function, by_row, rows_per_call
        self.schema = schema or version_schema(cols)
        self.part = F.coalesce((F.input_file_name() if part is None else part).cast("string"),
                               F.lit(""))
        self.row = F.lit(None).cast("string") if row is None else row.cast("string")

    def __call__(self, inputs: DataFrame) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(ERROR, ERROR_TYPE)])
        arrow = to_arrow_schema(schema)
        function, by_row, most = self.function, self.by_row, self.rows_per_call

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in _pieces(batch, 1 if by_row else most):
                    yield from _attempt(function, piece, by_row, arrow)

        return inputs.select("*", self.part.alias(_PART), self.row.alias(_ROW)) \
            .mapInArrow(work, schema)

    def count_parts(self, inputs: DataFrame) -> int:
        return inputs.select(self.part.alias(_PART)).distinct().count()


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of the same part."""
    parts, start = batch.column(_PART).to_pylist(), 0
    for i in range(1, len(parts) + 1):
        if i == len(parts) or parts[i] != parts[start] or i - start == most:
            yield batch.slice(start, i - start)
            start = i


def _attempt(function: Callable, piece: pa.RecordBatch, by_row: bool,
             schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    try:
        rows = pa.Table.from_batches([piece]).drop_columns([_PART, _ROW])
        if by_row:
            made = function(rows.to_pylist()[0])
            made = [] if made is None else made if isinstance(made, list) else [made]
            made = pa.Table.from_pylist(made, pa.schema(list(schema)[:-1]))
        else:
            made = function(rows)
        columns = [made.column(f.name).cast(f.type) for f in list(schema)[:-1]]
        good = pa.table([*columns, pa.nulls(made.num_rows, schema.field(ERROR).type)],
                        schema=schema)
        found = good.to_batches()
    except Exception as error:  # whatever the function raises is its row's error
        half = piece.num_rows // 2
        if half:
            for part in (piece.slice(0, half), piece.slice(half)):
                yield from _attempt(function, part, by_row, schema)
            return
        told = {"part": piece.column(_PART)[0].as_py(), "row": piece.column(_ROW)[0].as_py(),
                "message": f"{type(error).__name__}: {error}"}
        found = [pa.RecordBatch.from_pylist([{ERROR: told}], schema)]
    yield from found
