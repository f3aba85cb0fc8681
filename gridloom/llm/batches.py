"""Arrow helpers: run a function over whole texts, slice by slice, beside the input row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES, SLICE_ROWS = 2 << 20, 2000
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> None:
    """Arrow batches of the session end at BATCH_BYTES instead of 64 MB, which a task holds in the JVM and in Python; a limit set by the user stays."""
    conf = df.sparkSession.conf
    if BATCH_SETTING not in conf.getAll:
        conf.set(BATCH_SETTING, BATCH_BYTES)


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the borders between them; a null is an empty text."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    borders = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[borders[0] : borders[-1]], borders - borders[0]


def raw(texts: pa.Array) -> list[bytes]:
    """The texts as UTF-8; a null is an empty text."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with about SLICE_BYTES of text each (one row at least, SLICE_ROWS at most): (first, number)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first, done = 0, 0
    while first < len(sizes):
        last = max(first + 1, min(first + SLICE_ROWS, int(np.searchsorted(sizes, done + SLICE_BYTES, side="right"))))
        yield first, last - first
        first, done = last, int(sizes[last - 1])


def over_texts(
    df: DataFrame,
    function: Callable[[pa.Array], list],
    fields: str,
    keep: list[str],
    text: str = "text",
) -> DataFrame:
    """One output row per row: `row` (struct of the columns in `keep`) and the fields the function returns.

    The input row is nested, so its column names never clash with the new ones.
    """
    bounded(df)
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    source = df.select(row) if text in keep else df.select(row, F.col(f"`{text}`").alias("text"))
    added = T._parse_datatype_string(fields) if isinstance(fields, str) else fields
    schema = T.StructType([source.schema["row"], *added.fields])
    names = schema.names
    at = keep.index(text) if text in keep else None

    def run(batches):
        for batch in batches:
            own = batch.column(0)
            texts = own.field(at) if at is not None else batch.column(1)
            for first, n in slices(batch, texts):
                yield pa.RecordBatch.from_arrays([own.slice(first, n), *function(texts.slice(first, n))], names=names)

    return source.mapInArrow(run, schema)


def rows_from_texts(
    df: DataFrame,
    function: Callable[[pa.RecordBatch, pa.Array], list],
    schema: str,
    keep: list[str],
    text: str = "text",
) -> DataFrame:
    """Any number of output rows per slice: the function gets the slice and its texts and returns the columns."""
    bounded(df)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    names = T._parse_datatype_string(schema).names

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for first, n in slices(batch, texts):
                yield pa.RecordBatch.from_arrays(function(batch.slice(first, n), texts.slice(first, n)), names=names)

    return source.mapInArrow(run, schema)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from its values laid end to end and the length of each list."""
    borders = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=borders[1:])
    return pa.ListArray.from_arrays(pa.array(borders), pa.array(values, kind))
