"""An extension: manuscripts as a stream of files, reviewed batch by batch. Reviews are keyed by paper and content, so a batch that runs again writes nothing twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators.tex import first_seen

SCHEMA = "paper_id string, tex_text string, bib_text string, checklist_text string"


def watch(spark: SparkSession, source: str, target: str, checkpoint: str, review: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Parquet files of manuscripts that arrive in source -> review(batch) with content_hash, appended to target."""

    def batch(rows: DataFrame, number: int) -> None:
        key = F.sha2(F.concat_ws("\x00", *[F.coalesce(c, F.lit("")) for c in ("tex_text", "bib_text", "checklist_text")]), 256)
        # of several versions of a paper in one batch always the same one
        rows = first_seen(rows.withColumn("content_hash", key), ["paper_id"], ["content_hash"])
        out = review(rows.drop("content_hash")).join(rows.select("paper_id", "content_hash"), "paper_id")
        out.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def error_streaks(events: DataFrame, delay: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Per source and window the number of failed requests, with late ones up to delay: source, ts, failed."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "source").agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))
