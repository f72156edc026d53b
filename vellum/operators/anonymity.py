"""What can tell a blind reviewer who the authors are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import match as M
from vellum.functions import text as T

from . import grammar
from .findings import finding, union
from .tex import author_blocks, first_seen

# Marks of an anonymised field, commands that carry identity, telling phrases.
ANONYMOUS = ["anonymous", "anonymized", "anonymised", "redacted", "double-blind", "blind review", "author names", "removed for review", "omitted for review", "withheld", "for review"]
IDENTITY_COMMANDS = ["thanks", "affiliation", "affil", "institute", "email", "address"]
REVEALING = [
    r"(?i)\bin our (?:previous|prior|earlier|recent|past) work\b",
    r"(?i)\bwe (?:previously|earlier|recently) (?:showed|proposed|introduced|developed|presented|demonstrated|published)\b",
    r"(?i)\bour (?:previous|prior|earlier|recent) (?:paper|work|study|approach|method|model)\b",
    r"(?i)\bas we (?:showed|proposed|argued|demonstrated) in\b",
    r"(?i)\b(?:builds?|building) (?:up)?on our (?:previous|prior|earlier)\b",
    r"(?i)\bextends? our (?:previous|prior|earlier)\b",
]
ELSEWHERE = [
    r"(?i)\b(?:submitted|under review|under submission|in submission)\s+(?:to|at)\b",
    r"(?i)\bcurrently under review\b",
    r"(?i)\bsimultaneously submitted\b",
]

FAMILY = "anonymization"
EVIDENCE = 240
identity_arguments = grammar.braced(r"\\(" + "|".join(IDENTITY_COMMANDS) + r")\b\s*(?:\[[^\]]*\])?\s*(?=\{)")


def is_anonymous(s: Column) -> Column:
    """Blank, or marked as anonymised."""
    return (T.strip(F.coalesce(s, F.lit(""))) == "") | M.contains_any(s, ANONYMOUS)


def residual_identity(papers: DataFrame) -> DataFrame:
    """The author block, and identity commands that stand outside of every author block."""
    block = finding(papers.where(~is_anonymous(F.col("author_block"))), FAMILY, "residual_identity", [0, 0, 0], evidence=T.shorten(F.col("author_block"), EVIDENCE), detail=F.lit("the \\author block names authors; check that the build for submission is anonymous"))
    t = T.strip_comments(F.coalesce("tex_text", F.lit("")))
    rows = papers.select("paper_id", author_blocks(t).alias("own"), F.explode(identity_arguments(t)).alias("x"))
    outside = ~F.exists("own", lambda s: (s["start"] <= F.col("x.start")) & (F.col("x.start") < s["end"]))
    rows = rows.where(outside).withColumn("said", T.flatten_tex(F.col("x.inner"))).where(~is_anonymous(F.col("said")))
    command = F.array_position(F.array(*[F.lit(c) for c in IDENTITY_COMMANDS]), F.col("x.name"))
    detail = F.concat(F.lit("a \\"), F.col("x.name"), F.lit("{...} outside the author block names someone; check that it goes for review"))
    return block.unionByName(finding(rows, FAMILY, "residual_identity", [0, command, F.col("x.start")], evidence=T.shorten(F.col("said"), EVIDENCE), detail=detail))


def clean_sentence(s: Column) -> Column:
    return T.squeeze(F.regexp_replace(s, T.CITE_MARK, ""))


def phrases(papers: DataFrame, patterns: list[str], vector: int, kind: str, detail: str) -> DataFrame:
    """Each sentence with one of the phrases once: by the first pattern, then the first place."""
    each = F.array(*[F.struct(F.lit(i).alias("p"), T.spans(F.col("body"), x).alias("s")) for i, x in enumerate(patterns)])
    rows = papers.select("paper_id", "body", F.explode(each).alias("e")).select("paper_id", "body", F.col("e.p").alias("p"), F.explode("e.s").alias("s"))
    rows = rows.select("paper_id", "p", F.col("s.start").alias("at"), clean_sentence(T.sentence_around(F.col("body"), F.col("s.start"), F.col("s.end"))).alias("sentence")).where("sentence <> ''")
    rows = first_seen(rows.withColumn("key", F.lower("sentence")), ["paper_id", "key"], ["p", "at"])
    return finding(rows, FAMILY, kind, [vector, F.col("p"), F.col("at")], evidence=T.shorten(F.col("sentence"), EVIDENCE), detail=F.lit(detail))


def identity_urls(links: DataFrame) -> DataFrame:
    rows = first_seen(links.where(M.is_identity_url(F.col("url"))), ["paper_id", "url"], ["part", "at"])
    return finding(rows, FAMILY, "identity_url", [2, F.col("part"), F.col("at")], evidence=F.col("url"), detail=F.lit("a code host or personal page can name the authors, and some venues allow no such links; check it"))


def acknowledgments(papers: DataFrame) -> DataFrame:
    rows = papers.where(~is_anonymous(F.col("acknowledgments")))
    return finding(rows, FAMILY, "acknowledgments_present", [3, 0, 0], evidence=T.shorten(F.col("acknowledgments"), EVIDENCE), detail=F.lit("acknowledgments tend to name funders and colleagues; check that they go for review"))


def surnames_given(authors: Column) -> Column:
    """'Ann Roe; poe' -> Roe, Poe."""
    names = F.transform(F.split(F.coalesce(authors, F.lit("")), "[,;]"), lambda c: F.element_at(F.split(T.strip(c), r"(?U)\s+"), -1))
    return F.filter(F.transform(names, lambda n: F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, 2, 1000))), lambda n: n != "")


def author_names(papers: DataFrame) -> DataFrame:
    """Given surnames in prose: whole words, outside of citation marks, not parts of hyphenated names."""
    rows = papers.where("authors IS NOT NULL").select("paper_id", "body", F.posexplode(surnames_given(F.col("authors"))).alias("p", "name"))
    rows = rows.withColumn("marks", T.spans(F.col("body"), T.CITE_MARK)).withColumn("offsets", F.transform(F.split(F.col("body"), F.concat(F.lit("\\Q"), F.col("name"), F.lit("\\E")), -1), F.length))
    ends = F.transform(F.sequence(F.lit(1), F.size("offsets") - 1), lambda k: F.aggregate(F.slice("offsets", F.lit(1), k), F.lit(0), lambda a, b: a + b) + (k - 1) * F.length("name"))
    rows = rows.where(F.size("offsets") > 1).withColumn("at", F.explode(ends)).withColumn("end", F.col("at") + F.length("name"))
    before, after, next_ = F.when(F.col("at") > 0, F.substring("body", F.col("at"), F.lit(1))).otherwise(""), F.substring("body", F.col("end") + 1, F.lit(1)), F.substring("body", F.col("end") + 2, F.lit(1))
    word = lambda c: c.rlike(r"(?U)^\w$")
    inside = F.exists("marks", lambda m: (m["start"] <= F.col("at")) & (F.col("at") < m["end"]))
    rows = rows.where(~word(before) & ~word(after) & ~inside & (before != "-") & ~((after == "-") & next_.rlike(r"^\p{L}$")))
    rows = rows.select("paper_id", "p", "name", "at", clean_sentence(T.sentence_around(F.col("body"), F.col("at"), F.col("end"))).alias("sentence"))
    rows = first_seen(rows.withColumn("key", F.lower("sentence")), ["paper_id", "name", "key"], ["p", "at"])
    return finding(rows, FAMILY, "author_name_in_body", [4, F.col("p"), F.col("at")], evidence=T.shorten(F.col("sentence"), EVIDENCE), detail=F.concat(F.lit('the surname "'), F.col("name"), F.lit('" stands in running prose; check that it does not tell who you are')))


def audit(papers: DataFrame, links: DataFrame) -> DataFrame:
    """Every vector, in fixed order. papers: with authors, the surnames to look for, or null."""
    return union([
        residual_identity(papers),
        phrases(papers, REVEALING, 1, "self_revealing_phrase", "prior work in the first person can tell who wrote this; check that it is not your own"),
        identity_urls(links),
        acknowledgments(papers),
        author_names(papers),
        phrases(papers, ELSEWHERE, 5, "dual_submission_tell", "naming another venue can mean a second submission; check the policy on that"),
    ])
