"""The one tall table that every detector returns rows of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEXTS = ["severity", "section", "question", "response", "detail", "evidence"]


def finding(rows: DataFrame, family: str, kind: str | Column, order: list, **texts: Column) -> DataFrame:
    """rows (with paper_id) as findings; order: numbers that place them within their family."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    place = F.array(*[(F.lit(x) if isinstance(x, int) else x).cast("int") for x in order])
    return rows.select("paper_id", F.lit(family).alias("family"), kind.alias("kind"), place.alias("place"), *[texts.get(c, F.lit(None)).cast("string").alias(c) for c in TEXTS])


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def numbered(found: DataFrame) -> DataFrame:
    """finding_ord: the place within the paper and family, from 0."""
    order = F.row_number().over(Window.partitionBy("paper_id", "family").orderBy("place", "kind", "detail")) - 1
    return found.withColumn("finding_ord", order).drop("place")
