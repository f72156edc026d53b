"""Grouping, ranking and counting of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import match as M
from vellum.functions import text as T

# How grave a verdict is, and which verdicts speak of the entry itself.
SEVERITY = {"target_unavailable": 0, "metadata_mismatch": 1, "does_not_support": 2, "partially_supports": 3, "abstract_too_thin": 4, "verification_unavailable": 4, "supports": 5}
PROBLEMS = ["does_not_support", "partially_supports", "target_unavailable", "metadata_mismatch"]
ENTRY_LEVEL = ["metadata_mismatch", "target_unavailable"]
MAJOR = ["target_unavailable", "metadata_mismatch", "does_not_support"]
BUCKETS = ["critical", "major", "minor"]
REVIEW_SEVERITIES = BUCKETS


def severity(verdict: Column) -> Column:
    out = F.lit(None).cast("int")
    for v, n in SEVERITY.items():
        out = F.when(verdict == v, n).otherwise(out)
    return out


def is_problem(verdict: Column, role: Column, abstract_only: Column) -> Column:
    method = role.eqNullSafe(F.lit("method_attribution"))
    thin = (verdict == "abstract_too_thin") | ((verdict == "supports") & abstract_only)
    return verdict.isin(PROBLEMS) | (thin & ~method)


def problems(verifications: DataFrame) -> DataFrame:
    return verifications.where(is_problem(F.col("verdict"), F.col("role"), F.col("abstract_only")))


def groups(verifications: DataFrame) -> DataFrame:
    """Flagged sites by reference: sites in order, headline (the gravest, first on ties), whether the entry itself is at fault, rank within the paper."""
    rows = problems(verifications).withColumn("sev", severity(F.col("verdict")))
    site = F.struct("cite_ord", "sev", "verdict", "rationale", "sentence", "abstract_only")
    g = rows.groupBy("paper_id", "ref_id").agg(F.array_sort(F.collect_list(site)).alias("sites"), F.min_by("verdict", F.struct("sev", "cite_ord")).alias("headline"), F.bool_or(F.col("verdict").isin(ENTRY_LEVEL)).alias("entry_level"), F.count("*").alias("n_sites"))
    rank = F.row_number().over(Window.partitionBy("paper_id").orderBy(severity(F.col("headline")), "ref_id"))
    return g.withColumn("rank", rank)


def flagged_records(verifications: DataFrame) -> DataFrame:
    """paper_id, ref_id, n_sites and which of retracted, weak, outdated apply to the resolved record."""
    outdated = F.col("published_version").isNotNull() & M.cites_arxiv(F.col("doi"), M.arxiv_id_of(F.col("arxiv_id"), F.col("doi"), F.col("ref_url"), F.col("raw_text")), F.col("venue"), F.col("ref_url"))
    rows = verifications.where("record IS NOT NULL").groupBy("paper_id", "ref_id").agg(F.count("*").alias("n_sites"), F.bool_or("is_retracted").alias("retracted"), F.bool_or(F.col("match_note").isNotNull()).alias("weak"), F.bool_or(outdated).alias("outdated"))
    return rows.where("retracted OR weak OR outdated")


def coverage(verifications: DataFrame) -> DataFrame:
    """Per paper, each site in the first class that applies."""
    kind = F.when(F.col("status") == "degraded", "resolution_degraded").when(F.col("verdict") == "verification_unavailable", "verification_degraded").when(F.col("verdict") == "target_unavailable", "ghost_unresolved").otherwise("resolved")
    rows = verifications.withColumn("class", kind)
    counts = [F.count_if(F.col("class") == k).alias(k) for k in ("resolved", "ghost_unresolved", "resolution_degraded", "verification_degraded")]
    full = F.count_if(~F.col("abstract_only") & (F.col("verdict") != "target_unavailable")).alias("fetched_full_text_count")
    out = rows.groupBy("paper_id").agg(F.count("*").alias("citations_checked"), *counts, F.count_if("abstract_only").alias("abstract_only_count"), full)
    return out.withColumn("has_coverage_gap", F.col("resolution_degraded") + F.col("verification_degraded") > 0)


def reviewer_findings(raw: DataFrame) -> DataFrame:
    """paper_id, n, dimension, severity, issue, evidence, suggested_fix of an adversarial review: known severities with an issue, nothing else."""
    clean = lambda c: T.strip(F.coalesce(c, F.lit("")))
    rows = raw.select("paper_id", "n", F.lower(clean("dimension")).alias("dimension"), F.lower(clean("severity")).alias("severity"), clean("issue").alias("issue"), clean("evidence").alias("evidence"), clean("suggested_fix").alias("suggested_fix"))
    return rows.where(F.col("severity").isin(REVIEW_SEVERITIES) & (F.col("issue") != ""))


def assessment(review: DataFrame, submission: DataFrame, grouped: DataFrame) -> DataFrame:
    """Per paper the number of critical, major and minor points. One quoted element counts once, at its gravest; points that quote nothing count each."""
    a = review.select("paper_id", "severity", F.coalesce(T.blank_to_null(F.col("evidence")), F.col("issue")).alias("quoted"))
    b = submission.select("paper_id", F.when(F.col("severity") == "blocker", "critical").otherwise("minor").alias("severity"), F.coalesce(T.blank_to_null(F.col("evidence")), F.col("detail")).alias("quoted"))
    c = grouped.select("paper_id", F.when(F.col("headline").isin(MAJOR), "major").otherwise("minor").alias("severity"), F.col("ref_id").alias("quoted"))
    rows = a.unionByName(b).unionByName(c).withColumn("key", F.lower(T.squeeze(F.coalesce("quoted", F.lit("")))))
    rank = F.array_position(F.array(*[F.lit(x) for x in BUCKETS]), F.col("severity"))
    named = rows.where("key <> ''").groupBy("paper_id", "key").agg(F.min(rank).alias("rank")).select("paper_id", "rank")
    every = named.unionByName(rows.where("key = ''").select("paper_id", rank.alias("rank")))
    return every.groupBy("paper_id").agg(*[F.count_if(F.col("rank") == i + 1).alias(b) for i, b in enumerate(BUCKETS)])


def link_ratio(links: DataFrame) -> DataFrame:
    return links.groupBy("paper_id").agg(F.count_if(~F.col("ok")).alias("n_bad"), F.count("*").alias("n_total"))


def exit_code(coverage: DataFrame, blockers: DataFrame, gate: bool, degraded: DataFrame | None = None) -> DataFrame:
    """4 for blockers at the gate, else 3 for a gap or a part that could not be written (degraded: paper_id), else 0."""
    rows = coverage.join(blockers, "paper_id", "full_outer")
    missing = F.lit(False)
    if degraded is not None:
        rows = rows.join(degraded.withColumn("_missing", F.lit(True)), "paper_id", "full_outer")
        missing = F.coalesce("_missing", F.lit(False))
    blocked = F.lit(gate) & F.col("blockers").isNotNull()
    return rows.select("paper_id", F.when(blocked, 4).when(F.coalesce("has_coverage_gap", F.lit(False)) | missing, 3).otherwise(0).alias("exit_code"))
