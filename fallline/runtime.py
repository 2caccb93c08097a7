"""What every operator needs from the session: code on the executors, a shared folder, lineage cuts.

Nothing here keeps data on a machine's own disk.  Intermediate tables go below the folder that the
session names in ``spark.checkpoint.dir``; only in local mode, where that setting may be absent (tests, a
laptop), is a local folder chosen, and then it is set on the session so that every later reader agrees on it.
"""

from __future__ import annotations

import contextlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Row groups of intermediate tables: a task buffers one while it writes.
ROW_GROUP_BYTES = 16 << 20
PACKAGE = Path(__file__).resolve().parent

#: Largest table, in rows and in bytes of its values, that :func:`broadcast_if_small` hands to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that do not have it installed (once a session)."""
    sc = spark.sparkContext
    if getattr(sc, "_fallline_shipped", False):
        return
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, str(Path(PACKAGE.name) / path.relative_to(PACKAGE)))
    folder = tempfile.mkdtemp(prefix="fallline-code-")
    target = os.path.join(folder, "fallline.zip")
    Path(target).write_bytes(body.getvalue())
    sc.addPyFile(os.path.abspath(target))
    sc._fallline_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fallline-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/fallline/{name}-{uuid.uuid4().hex}"


_made: list[list[str]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that outlives any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    for paths in _made:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fallline_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table that :func:`cut` returned and that nothing reads any more."""
    path = getattr(df, "_fallline_path", None)
    if path is not None:
        delete(df.sparkSession, path)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that are cut inside, all but those that the given function was called with."""
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._fallline_path)
        return df

    _made.append(made)
    try:
        yield keep
    finally:
        # by identity: lists of nested scopes can be equal
        _made[:] = [m for m in _made if m is not made]
        for path in made:
            if path not in kept:
                delete(spark, path)


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def free_bytes(spark: SparkSession) -> int:
    """Space that the shared folder's file system has left."""
    there = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).getStatus().getRemaining()


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], *, restart: bool = False) -> DataFrame:
    """The table at ``path``: read where an earlier run finished writing it, else built and written."""
    if restart or not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _bytes(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + 8 + _bytes(x, kind.elementType)), F.lit(0).cast("long"))
        return F.coalesce(F.array_size(value), F.lit(0)).cast("long") * 8
    if isinstance(kind, T.MapType):
        return _bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + _bytes(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    return F.lit(8).cast("long")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when a count proves that it has at most ``rows`` rows of ``size`` bytes in all.

    Beyond that the frame comes back unmarked and the join shuffles both sides instead.  ``df`` is computed for
    the count, so give it a table or what is cheap.
    """
    total = sum((_bytes(df[f.name], f.dataType) for f in df.schema.fields), F.lit(8).cast("long"))
    got = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(total), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if got["n"] <= rows and got["size"] <= size else df


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of ``df``'s, whatever those are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
