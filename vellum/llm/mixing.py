"""Mixing sources to target weights.

Tokens are summed per source, each source gets a target by weight under a cap on repetition, and
every document is emitted floor(rate) times plus one more with the probability of the remaining
fraction. The coin is a hash of (seed, doc_id, size), so reruns agree. Each source takes, among
SEEDS seeds, the one whose coins bring its words nearest to its target.

Only DataFrame functions are used. Sums per source are pre-aggregated before the shuffle, so a
source that holds a third of the rows is no hot key; the table of sources is broadcast after its
rows are counted.

Defined cases: a null text has size 0; a very long text is one document, taken whole or not at all, so a
source of few such texts comes as near to its target as they allow; a null source is a source of its own,
last in order; a source of size 0 has target and rate 0; sources whose sizes tie by weight are in order of their
names; a null id has a coin like others; rows that repeat an id and size share their coin; an empty table
gives an empty result. Other columns pass through `mix` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEEDS = 16


def size_of(text: str = "text") -> Column:
    """Number of runs of characters other than space, tab, line feed, vertical tab, form feed and return."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def coin(seed: Column, doc_id: Column, size: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5."""
    said = F.concat_ws(":", seed.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"))
    return F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(src, source_size) -> with target: min(cap * size, level * weight), the level chosen so that all targets make share * total.

    That level is where handing the excess of capped sources to the others by weight comes to rest.
    One row per source: the windows see the aggregated sources, never the documents.
    """
    order = Window.orderBy(F.col("src").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rising = Window.orderBy(F.col("source_size") / F.col("w"), F.col("src").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.withColumn("w", w)
    s = s.withColumn("total", F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    s = s.withColumn("below", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(cap))
    s = s.withColumn("below_w", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.col("total") * F.lit(share) - F.col("below")) / (F.col("all_w") - F.col("below_w")))
    fits = F.col("level") * F.col("w") <= F.col("source_size") * F.lit(cap)
    s = s.withColumn("level", F.min(F.when(fits, F.struct(F.col("source_size") / F.col("w"), F.col("level")))).over(every)["level"])
    target = F.least(F.col("source_size") * F.lit(cap), F.coalesce(F.col("level") * F.col("w"), F.col("source_size") * F.lit(cap)))
    return s.select("src", "source_size", target.cast("double").alias("target"))


def plan(sized: DataFrame, seeds: int = SEEDS, **how) -> DataFrame:
    """(doc_id, src, size) -> per source: src, source_size, target, rate, seed."""
    t = targets(sized.groupBy("src").agg(F.sum("size").alias("source_size")), **how)
    t = t.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    t = common.table(t, "mix-targets")
    rates = t.select(F.col("src").alias("r_src"), "rate")
    joined = common.join_small(sized, rates, F.col("src").eqNullSafe(F.col("r_src")))
    part = F.col("rate") - F.floor("rate")
    sums = joined.groupBy("src").agg(*[F.sum(F.when(coin(F.lit(k), F.col("doc_id"), F.col("size")) < part, F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(seeds)]).withColumnRenamed("src", "s_src")
    wanted = F.col("target") - F.floor("rate") * F.col("source_size")
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{k}") - wanted).alias("off"), F.lit(k).alias("seed")) for k in range(seeds)]))["seed"]
    return common.table(t.join(sums, F.col("src").eqNullSafe(F.col("s_src"))).select("src", "source_size", "target", "rate", best.alias("seed")), "mix-plan")


def copies() -> Column:
    return (F.floor("rate") + (coin(F.col("seed"), F.col("doc_id"), F.col("size")) < F.col("rate") - F.floor("rate")).cast("int")).cast("int")


def measure(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").alias("src"), size_of().alias("size"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The documents, each as many times as the mix takes it, with their own columns and no others."""
    chosen = common.settled("mix-chosen", lambda: plan(common.table(measure(docs), "mix-sizes"), **how))
    inner = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(inner.alias("row"), "doc_id", F.col("source").alias("d_src"), size_of().alias("size"))
    rows = common.join_small(rows, chosen, F.col("d_src").eqNullSafe(F.col("src")))
    n = copies()
    return rows.withColumn("n", n).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = common.table(measure(common.read(spark, sf_dir, "documents")), "mix-sizes")
    chosen = plan(sized)
    rows = common.join_small(sized.withColumnRenamed("src", "d_src"), chosen, F.col("d_src").eqNullSafe(F.col("src")))
    return rows.select("doc_id", "size", "source_size", "target", (copies() * F.col("size")).cast("long").alias("taken"))


_PICK = ", ".join(f"sum(CASE WHEN coin{k} < rate - floor(rate) THEN size ELSE 0 END) AS s{k}" for k in range(SEEDS))
_COIN = "(('0x' || substr(md5({k} || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0)"
OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM s),
l AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
   coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE AS below,
   coalesce(sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_w FROM w),
m AS (SELECT *, (total * 1.5::DOUBLE - below) / (all_w - below_w) AS lev FROM l),
v AS (SELECT *, (SELECT arg_min(lev, source_size / w) FROM m WHERE lev * w <= source_size * 2.0::DOUBLE) AS level FROM m),
t AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, coalesce(level * w, source_size * 2.0::DOUBLE)) AS target FROM v),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM t),
c AS (SELECT d.doc_id, d.size, r.*, {", ".join(_COIN.format(k=k) + f" AS coin{k}" for k in range(SEEDS))}
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
p AS (SELECT source, {_PICK} FROM c GROUP BY source),
b AS (SELECT r.*, list_min([{", ".join(f"{{'off': abs(s{k} - (target - floor(rate) * source_size)), 'seed': {k}}}" for k in range(SEEDS))}]).seed AS seed
  FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, d.size, b.source_size, b.target,
  CAST(d.size * (floor(rate) + CASE WHEN {_COIN.format(k="seed")} < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM (SELECT doc_id, source AS d_source, size FROM d) d JOIN b ON d.d_source IS NOT DISTINCT FROM b.source
"""
