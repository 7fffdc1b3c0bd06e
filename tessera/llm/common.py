"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker takes from an Arrow batch at once.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch while a table is written.
BATCH_ROWS = 2000
#: Narrow rows that one task takes where a table's greatest size is known, and the tasks that such a table has at least.
TASK_ROWS, LEAST_TASKS = 100_000, 12


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``; where that is unset and all runs in one process (tests), one of our own."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        there = spark.conf.get("spark.checkpoint.dir", None)
        if not there and not jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(there or tempfile.mkdtemp(prefix="tessera-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again, so that lost executors cost no recomputation.

    A table is written, not a checkpoint: that one keeps what the optimizer knows about its columns, which over
    the rounds of a loop grows without bound.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most so many narrow rows, in tasks as its size asks for: steps that only hand on little cost a task each otherwise for every shuffle partition."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS)))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile at most ``BATCH_ROWS`` rows go to a worker at once: whole texts make large Arrow buffers, which no heap limit holds."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_table(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """A few rows of the driver as a table, through Arrow: rows as Python objects would start workers of another kind on every executor."""
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table({name: pa.array(values, kind) for (name, kind), values in zip(kinds.items(), columns, strict=True)}))


def slices(batches: Iterable[pa.RecordBatch], text_column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about ``size`` bytes of text (a longer text stands alone)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_column)), 0))
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < n:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Free memory that this process still holds goes back to the machine."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a worker that gives free memory back after each batch: it stays idle beside other workers later."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from run(watched())
        give_back()

    return wrapped


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text_column: str = "text", size: int = SLICE_BYTES) -> DataFrame:
    """``work`` on every slice of ``df``; memory is bounded by a slice and the longest text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_column, size):
            out = work(part)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(frugal(run), schema)


def joined_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of bytes, and where each starts (with the end as a last item)."""
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), starts
