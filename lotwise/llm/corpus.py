"""Whole texts inside tasks, and tables written once in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lotwise.session import scratch_path

# Text bytes worked on at a time, so that memory does not follow the rows of an Arrow batch.
SLICE_BYTES = 16 << 20

# A new column: its name, Spark type and Arrow type.
Field = tuple[str, T.DataType, pa.DataType]
LONG = (T.LongType(), pa.int64())
INT = (T.IntegerType(), pa.int32())
DOUBLE = (T.DoubleType(), pa.float64())
STRING = (T.StringType(), pa.string())
BOOL = (T.BooleanType(), pa.bool_())
BINARY = (T.BinaryType(), pa.binary())
LONGS = (T.ArrayType(T.LongType()), pa.list_(pa.int64()))
STRINGS = (T.ArrayType(T.StringType()), pa.list_(pa.string()))
INTS = (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; NULL is the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The rows of a batch, in order, with at most ``most`` text bytes (or one row) at a time."""
    column = batch.column(batch.schema.get_field_index(text))
    lengths = [n or 0 for n in pa.compute.binary_length(column).to_pylist()]
    start = size = 0
    for row, length in enumerate(lengths):
        if row > start and size + length > most:
            yield batch.slice(start, row - start), texts(column.slice(start, row - start))
            start, size = row, 0
        size += length
    if batch.num_rows > start:
        yield batch.slice(start), texts(column.slice(start))


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return tuple(out)


def with_text_columns(
    df: DataFrame,
    text: str,
    fields: list[Field],
    prepare: Callable[[], Callable[[list[bytes]], list]],
    most: int = SLICE_BYTES,
) -> DataFrame:
    """``df`` plus columns worked out from its texts, row by row and without a shuffle.

    ``prepare`` runs once in each task and gives a function from texts to one list per field. The names
    of ``fields`` replace columns of ``df`` that have them already.
    """
    names = [f[0] for f in fields]
    kept = df.select(*[f"`{c}`" for c in df.columns if c not in names or c == text])
    if text in names:
        raise ValueError(f"{text} holds the texts and cannot be a new column")
    schema = T.StructType([*kept.schema.fields, *[T.StructField(f[0], f[1]) for f in fields]])
    kinds = [f[2] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepare()
        for batch in batches:
            for part, found in slices(batch, text, most):
                made = [pa.array(v, k) for v, k in zip(work(found), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    return kept.mapInArrow(run, schema)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write the rows as Parquet in the shared folder and go on from there: the lineage ends here."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
