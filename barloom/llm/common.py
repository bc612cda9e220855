"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows a Python task holds at a time; a text has a few thousand characters on average.
SLICE_ROWS = 256


def append_columns(df: DataFrame, fn: Callable[[list], list[list]], text: str, fields: list[T.StructField]) -> DataFrame:
    """df with further columns that fn computes from the texts of a slice of rows.

    fn takes the list of values of column `text` and returns one list per field.
    Rows stay in their task: no exchange, and memory is bounded by a slice.
    """
    if {f.name for f in fields} & set(df.columns):
        raise ValueError("a new column has the name of one that exists")
    schema = T.StructType([*df.schema.fields, *fields])
    types = [_arrow(f.dataType) for f in fields]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                new = [pa.array(v, t) for v, t in zip(fn(part.column(at).to_pylist()), types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)

    return df.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(),
        T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary(),
    }[type(kind)]


def crc_of(col: str):
    """crc32 of a key written as text, as the contracts of held-out rows define it."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def hash_sample(df: DataFrame, group: str, key: str, text: str, per_group: int) -> DataFrame:
    """About per_group rows of each value of a column with few values, chosen by a hash of key and text.

    Counts come first, then a row decides for itself: nothing is sorted or moved.
    The number of rows is per_group in expectation, with the spread of a binomial count.
    """
    counts = {r[0]: r[1] for r in df.groupBy(group).count().collect()}
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit(7)), F.lit(1 << 30))
    chosen = F.lit(False)
    for value, n in sorted(counts.items(), key=str):
        if value is not None:
            chosen = chosen | ((F.col(group) == value) & (draw < int((1 << 30) * min(1.0, per_group / n))))
    return df.where(chosen)


def literal_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small frame of literals that needs no Python worker."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores appended to those that a column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
