"""Running a function over Arrow batches and keeping only what it needs of a table."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fallline.runtime import ship


def trim() -> None:
    """Give freed memory back to the system; the worker process lives on for other tasks."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Rows of texts, and bytes of them, that travel to Python at once; a session's smaller settings stay.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20
#: Rows that travel back at once: the JVM holds a whole batch.
OUT_ROWS = 32_768

_held: dict[str, Callable[[], None]] = {}


def hold(module: str, drop: Callable[[], None]) -> None:
    """Note what a module keeps in a worker between tasks, and how to drop it; a task of another module does."""
    _held[module] = drop


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limits.  They are read when a query runs, long after this, so they can't be put back here."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(name).removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(name, most)


def schema_fields(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)


def per_batch(df: DataFrame, function: Callable[[pa.RecordBatch], dict | pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` for a function of one batch that returns columns by name (or nothing)."""
    return per_partition(df, lambda batches: (function(b) for b in batches), schema, function.__module__)


def per_partition(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator], schema: T.StructType | str, owner: str | None = None) -> DataFrame:
    """``mapInArrow`` for a function of a partition's batches; it yields dicts of columns or batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    fields = schema_fields(schema)
    arrow = to_arrow_schema(fields)
    owner = owner or function.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between batches
        for module, drop in _held.items():
            if module != owner:
                drop()
        for out in function(batches):
            if out is None:
                continue
            if isinstance(out, dict):
                out = pa.RecordBatch.from_arrays(
                    [out[f.name].cast(f.type) if isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(out[f.name], type=f.type) for f in arrow],
                    schema=arrow,
                )
            for first in range(0, out.num_rows, OUT_ROWS):
                yield out.slice(first, OUT_ROWS)
        trim()

    return df.mapInArrow(run, fields)
