"""Running numpy or Python code over slices of rows inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from tideline.session import Scratch
from tideline.session import stage as stage_table

#: Bytes of the first input column that a task works on at once; a longer value is a slice alone.
SLICE_BYTES = 2 << 20
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Send rows to Python a few MB at a time, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Drop the shuffle files of what is written inside, once it is written."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def staged(df: DataFrame, name: str, scratch: Scratch | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; a table in ``scratch`` goes with it."""
    with cleaning(df.sparkSession):
        return scratch.stage(df, name) if scratch else stage_table(df, name)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def others(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns of ``df`` that none of the result columns ``names`` replaces."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string or binary column without copying them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        empty = "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""
        column = column.fill_null(empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n, (_, at, data) = len(column), column.buffers()
    if not n:
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    offsets = np.frombuffer(at, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0]:offsets[-1]]


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` whose values in ``column`` have about ``size`` bytes together."""
    if not batch.num_rows:
        return
    ends = spans(batch.column(column))[0]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def with_results(
    df: DataFrame,
    inputs: Sequence[str],
    keep: Sequence[str],
    result: Sequence[StructField],
    make: Callable[[], Callable[..., Sequence[pa.Array]]],
    size: int = SLICE_BYTES,
) -> DataFrame:
    """``keep`` columns of every row and the columns that a function makes from its ``inputs``.

    ``make`` runs once per task; its function gets the input columns of a slice as Arrow arrays
    and returns one array per result column. The first input is a string, and a slice has about ``size`` bytes of it.
    A kept column named like a result column gives way to it.
    """
    prepare(df.sparkSession)
    keep = [c for c in keep if c.lower() not in {f.name.lower() for f in result}]
    n_in, n_keep = len(inputs), len(keep)
    source = df.select(
        *[F.col(quoted(c)).alias(f"i{k}") for k, c in enumerate(inputs)],
        *[F.col(quoted(c)).alias(f"k{k}") for k, c in enumerate(keep)])
    schema = StructType([
        *[StructField(f"k{k}", source.schema[n_in + k].dataType) for k in range(n_keep)],
        *[StructField(f"r{k}", f.dataType) for k, f in enumerate(result)]])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            for part in slices(batch, 0, size):
                made = work(*[part.column(k) for k in range(n_in)])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(n_in + k) for k in range(n_keep)], *made], names=names)

    out = source.mapInArrow(run, schema)
    return out.select(
        *[F.col(f"k{k}").alias(c) for k, c in enumerate(keep)],
        *[F.col(f"r{k}").alias(f.name) for k, f in enumerate(result)])


#: A block of a long vector of doubles that a task adds to the sum.
BLOCKS = StructType([
    StructField("block", IntegerType()), StructField("part", IntegerType()), StructField("sums", BinaryType())])
_BLOCK = 8192


def blocks_of(vector: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
    """``vector`` as rows of ``BLOCKS``; blocks of zeros are left out."""
    for k in range(0, len(vector), _BLOCK):
        block = vector[k:k + _BLOCK]
        if block.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k // _BLOCK], pa.int32()), pa.array([part % 256], pa.int32()),
                 pa.array([np.ascontiguousarray(block, np.float64).tobytes()])], names=BLOCKS.names)


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b) for b in sorted(table.column("sums").to_pylist()))
    return pa.table([table.column("block").slice(0, 1), table.column("part").slice(0, 1),
                     pa.array([total.tobytes()])], names=BLOCKS.names)


def sum_blocks(blocks: DataFrame, length: int) -> np.ndarray:
    """The sum of the vectors of all tasks, added up in two steps, so that no group is large."""
    added = blocks.groupBy("block", "part").applyInArrow(_add, BLOCKS).groupBy("block").applyInArrow(_add, BLOCKS)
    total = np.zeros(length)
    for r in added.toLocalIterator():
        total[r["block"] * _BLOCK:(r["block"] + 1) * _BLOCK] = np.frombuffer(r["sums"])
    return total
