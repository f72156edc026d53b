"""What a venue returns without review: length, stubs, a changed abstract, colour in tables, an incomplete checklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T

from .findings import finding, union

FAMILY = "submission"
VENUE_SCHEMA = "venue_id string, page_limit_technical int, references_excluded boolean, requires_abstract boolean, min_abstract_words int, checklist_required boolean, placeholder_markers array<string>, color_table_macros array<string>"
CHANGED = 0.20


def venues(spark: SparkSession, rows=()) -> DataFrame:
    """The venue table; none is configured by default."""
    return spark.createDataFrame([*rows], VENUE_SCHEMA)


def with_rules(papers: DataFrame, venue_rules: DataFrame) -> DataFrame:
    """Papers with the rules of their venue_id; those without a venue have none. An unknown venue is an error of the caller."""
    unknown = papers.where("venue_id IS NOT NULL").select("venue_id").distinct().join(venue_rules, "venue_id", "left_anti").take(1)
    if unknown:
        raise ValueError(f"unknown venue {unknown[0][0]!r}")
    return papers.join(venue_rules, "venue_id")


def marker(text: Column) -> Column:
    """The first placeholder marker in a text, or null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.get(F.filter("placeholder_markers", lambda m: F.contains(low, m)), F.lit(0))


def _blank(c: str) -> Column:
    return T.strip(F.coalesce(F.col(c), F.lit(""))) == ""


def length(ruled: DataFrame) -> DataFrame:
    """Pages up to the one where references start, or all of them where that page is not known."""
    known = F.col("references_start_page").isNotNull()
    technical = F.coalesce("references_start_page", "page_count")
    rows = ruled.where(F.col("page_count").isNotNull() & (technical > F.col("page_limit_technical")))
    pages = technical.cast("string")
    detail = F.when(known, F.concat(F.lit("about "), pages, F.lit(" technical pages, over the limit of "), F.col("page_limit_technical").cast("string"), F.lit("; check the compiled PDF")))
    detail = detail.otherwise(F.concat(pages, F.lit(" pages in all, and where references start is not known; the limit is "), F.col("page_limit_technical").cast("string"), F.lit("; check the compiled PDF")))
    return finding(rows, FAMILY, "over_length", [0], severity=F.when(known, "blocker").otherwise("warning"), detail=detail)


def title(ruled: DataFrame, strict: bool) -> DataFrame:
    m = marker(F.col("title"))
    empty = _blank("title")
    detail = F.when(empty, F.lit("the title is empty")).otherwise(F.concat(F.lit('the title holds a placeholder ("'), m, F.lit('")')))
    rows = ruled.where((empty & strict) | (~empty & m.isNotNull()))
    return finding(rows, FAMILY, "placeholder_title", [1], severity=F.lit("blocker"), detail=detail, evidence=F.when(~empty, T.strip(F.col("title"))))


def abstract(ruled: DataFrame, strict: bool = True) -> DataFrame:
    m, empty = marker(F.col("abstract")), _blank("abstract")
    words = F.size(F.split(T.squeeze(F.coalesce("abstract", F.lit(""))), " "))
    detail = F.when(empty, F.when(F.lit(strict) & F.col("requires_abstract"), "the abstract is empty or missing"))
    detail = detail.when(m.isNotNull(), F.concat(F.lit('the abstract holds a placeholder ("'), m, F.lit('")')))
    detail = detail.when(F.lit(strict) & (words < F.col("min_abstract_words")), F.concat(F.lit("the abstract has only "), words.cast("string"), F.lit(" words")))
    rows = ruled.withColumn("why", detail).where("why IS NOT NULL")
    return finding(rows, FAMILY, "placeholder_abstract", [2], severity=F.lit("blocker"), detail=F.col("why"), evidence=F.when(~empty, F.substring(T.strip(F.col("abstract")), 1, 200)))


def numbers_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))


def changed(old: Column, new: Column) -> Column:
    """Other numbers, or more than a fifth of the words."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)))
    a, b = tokens(old), tokens(new)
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return (numbers_of(old) != numbers_of(new)) | ((either > 0) & (1 - both / F.greatest(either, F.lit(1)) > CHANGED))


def changed_abstract(papers: DataFrame, baseline: DataFrame) -> DataFrame:
    """papers ⋈ baseline (paper_id, baseline_abstract), the abstracts that an earlier run recorded."""
    rows = papers.where("abstract IS NOT NULL").join(baseline, "paper_id").where(changed(F.col("baseline_abstract"), F.col("abstract")))
    return finding(rows, FAMILY, "changed_abstract", [5], severity=F.lit("blocker"), detail=F.lit("the abstract is no longer the recorded one; venues that register abstracts may return the paper"), evidence=F.substring(T.strip(F.col("abstract")), 1, 200))


def new_baselines(papers: DataFrame, baseline: DataFrame) -> DataFrame:
    """What to append to the recorded abstracts after this run."""
    return papers.where("abstract IS NOT NULL").join(baseline, "paper_id", "left_anti").select("paper_id", F.col("abstract").alias("baseline_abstract"))


def color_tables(ruled: DataFrame) -> DataFrame:
    macros = F.array_distinct(F.flatten(F.transform(T.table_bodies(F.coalesce("tex_text", F.lit(""))), lambda b: F.filter("color_table_macros", lambda m: F.contains(b, m)))))
    rows = ruled.withColumn("macros", macros).where(F.size("macros") > 0)
    detail = F.concat(F.lit("colour macros ("), F.array_join(F.transform("macros", lambda m: F.concat(F.lit("`"), m, F.lit("`"))), ", "), F.lit(") inside a table, which "), F.col("venue_id"), F.lit(" rejects"))
    return finding(rows, FAMILY, "color_table", [3], severity=F.lit("blocker"), detail=detail, evidence=F.get("macros", F.lit(0)))


def incomplete_checklist(ruled: DataFrame, findings: DataFrame) -> DataFrame:
    left = findings.where("family = 'checklist' AND kind = 'unanswered'").groupBy("paper_id").agg(F.count("*").alias("left_open"))
    rows = ruled.where("checklist_required AND checklist_found").join(left, "paper_id")
    detail = F.concat(F.col("left_open").cast("string"), F.lit(" checklist item(s) are unanswered; "), F.col("venue_id"), F.lit(" returns such papers"))
    return finding(rows, FAMILY, "checklist_incomplete", [4], severity=F.lit("blocker"), detail=detail)


def audit_tex(papers: DataFrame, venue_rules: DataFrame, checklist_findings: DataFrame, baseline: DataFrame) -> DataFrame:
    ruled = with_rules(papers, venue_rules)
    return union([title(ruled, True), abstract(ruled), color_tables(ruled), incomplete_checklist(ruled, checklist_findings), changed_abstract(papers, baseline)])


def audit_pages(papers: DataFrame, venue_rules: DataFrame) -> DataFrame:
    ruled = with_rules(papers, venue_rules)
    return length(ruled).unionByName(title(ruled, False))


def gate_blockers(findings: DataFrame) -> DataFrame:
    """paper_id, blockers: residual identity and blocking submission findings, in order."""
    rows = findings.where("(family = 'anonymization' AND kind = 'residual_identity') OR (family = 'submission' AND severity = 'blocker')")
    said = F.when(F.col("family") == "anonymization", F.concat(F.lit("residual author identity ("), F.col("evidence"), F.lit(")"))).otherwise(F.col("detail"))
    each = F.struct((F.col("family") == "submission").alias("later"), F.col("finding_ord").alias("n"), said.alias("said"))
    return rows.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["said"]).alias("blockers"))
