"""What the operators of this subpackage share: shared-folder tables and size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes by the planner's estimate, that a side may have to be broadcast; beyond either the callers take their other way.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in one process only, a folder of our own where it is unset."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/vellum/{label}-{uuid.uuid4().hex}"


#: Paths made under each settled() that is going on, the innermost last.
_made: list[list[str]] = []


def made(path: str) -> str:
    """Tells settled() of files that it may delete when its result stands."""
    if _made:
        _made[-1].append(path)
    return path


def table(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read back: later plans start from files, not from its lineage."""
    path = made(scratch(df.sparkSession, label))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """table(make(), label), after which every other table that make() wrote is deleted: nothing reads them any more."""
    _made.append([])
    spark, kept = None, None
    try:
        df = make()
        spark = df.sparkSession
        kept = table(df, label)
        return kept
    finally:
        paths = _made.pop()
        if kept is not None and _made:
            _made[-1].append(paths[-1])
        for path in (paths[:-1] if kept is not None else paths) if spark is not None else ():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Deletes the files of a frame made by table() that nothing reads any more."""
    for root in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, root)


def release() -> None:
    """Gives memory that a worker no longer uses back to the system: idle workers stay for the next stage's tasks and count beside its executor."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def text_key(text: str | Column = "text") -> Column:
    """A second part for a row's key, so that rows which share an id but not a text stay apart."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def is_small(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Whether df may be broadcast: few bytes by the planner's estimate, which reads file sizes and, where it must guess, guesses high; and few counted rows."""
    rows, size = BROADCAST_ROWS if rows is None else rows, BROADCAST_BYTES if size is None else size
    said = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return said <= size and df.limit(rows + 1).count() <= rows


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small."""
    return F.broadcast(df) if is_small(df) else df


def join_small(df: DataFrame, side: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """df joined with a side that is broadcast only if it is small; else a shuffled join, which AQE splits where a key is hot."""
    return df.join(F.broadcast(side) if is_small(side) else side, on, how)
