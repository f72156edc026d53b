"""Tables between the stages of a run, written once to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def place(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/vellum/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, read back from where it was written. What Python parsed is parsed once, and later plans start from a scan: a lost executor costs its own tasks only."""
    spark = df.sparkSession
    path = place(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(what: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Deletes a path, or the files of a frame made by stored(), that nothing reads any more."""
    spark = spark or what.sparkSession
    for root in [what] if isinstance(what, str) else {f.rpartition("/")[0] for f in what.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
