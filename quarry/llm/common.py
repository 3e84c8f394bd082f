"""What the operators share: written tables, Arrow batches, id columns."""

from __future__ import annotations

import ctypes
import functools
import inspect
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import forget, shared_dir, written

__all__ = ["doc_texts", "forget", "give_back", "lean", "map_steps", "prepare", "put_column", "shared_dir", "steps", "text_bytes", "written"]

#: Bytes of text that one step of a Python operator holds as working arrays.
STEP_BYTES = 2 << 20
#: Rows in an Arrow batch between the JVM and Python; documents can be long.
BATCH_ROWS = 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package and keeps Arrow batches small."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (null: empty) of every row; other columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``limit`` bytes of ``column``; one row at least."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_null(col.type):
        yield batch
        return
    lengths = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    first, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    yield batch.slice(first)


def map_steps(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | dict]], schema: str, column: str = "text") -> DataFrame:
    """Runs ``make()`` once in a task and applies what it returns to each run of rows.

    ``schema`` is a DDL string; results are dicts of columns or record batches.
    """
    def task(batches):
        work = make()
        for batch in batches:
            for part in steps(batch, column):
                out = work(part)
                if out is None:
                    continue
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(task, schema)


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def lean(work: Callable) -> Callable:
    """The task of a Python worker (over batches, a group or two), after which freed memory goes back: workers stay between tasks, beside their executor's JVM."""
    if inspect.isgeneratorfunction(work):

        def batches(x):
            yield from work(x)
            give_back()

        return batches

    def group(x):
        out = work(x)
        give_back()
        return out

    def pair(x, y):
        out = work(x, y)
        give_back()
        return out

    return pair if len(inspect.signature(work).parameters) == 2 else group


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def put_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with one column's values replaced."""
    i = batch.schema.get_field_index(name)
    columns = list(batch.columns)
    columns[i] = values.cast(batch.schema.field(i).type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)
