"""The review of each paper as Markdown: lines with a place, gathered once per paper at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import match as M
from vellum.functions import text as T

from . import coverage as C

# The order of sections, and the order and names of finding kinds.
SECTIONS = ["title", "coverage", "anonymization", "submission", "assessment", "summary", "strengths", "weaknesses", "reviewer2", "citations", "hygiene", "checklist", "numeric", "artifacts", "openreview", "questions", "methodology"]
KINDS = {
    "anonymization": {"residual_identity": "Residual identity", "self_revealing_phrase": "Self-revealing phrases", "identity_url": "URLs that name someone", "acknowledgments_present": "Acknowledgments", "author_name_in_body": "Author names in prose", "dual_submission_tell": "Signs of a second submission"},
    "submission": {"over_length": "Length", "placeholder_title": "Title", "placeholder_abstract": "Abstract", "changed_abstract": "Changed abstract", "color_table": "Colour in tables", "checklist_incomplete": "Checklist"},
    "checklist": {"unanswered": "Unanswered items", "invalid_response": "Invalid answers", "gate_inconsistency": "Inconsistent gates", "claim_unsupported": "Answers without evidence in the paper"},
    "numeric": {"bounded_metric": "Metrics out of bounds", "split_mismatch": "Splits that do not add up", "mean_std_range": "Means out of range", "hyperparam_drift": "Hyperparameters that differ", "abstract_table_delta": "Gains that no table shows"},
}
TITLES = {"coverage": "Coverage and reliability", "anonymization": "Anonymization", "submission": "Submission readiness", "assessment": "Overall assessment", "summary": "Summary", "strengths": "Strengths", "weaknesses": "Weaknesses", "reviewer2": "Reviewer 2", "citations": "Citation issues", "hygiene": "Hygiene", "checklist": "Reproducibility checklist", "numeric": "Numerical sanity", "artifacts": "Artifacts", "openreview": "OpenReview decisions", "questions": "Questions", "methodology": "Methodology"}
LABELS = {"supports": "Supports (by its abstract only; verify)", "partially_supports": "Supports in part", "does_not_support": "Does not support", "abstract_too_thin": "Abstract too thin to tell", "target_unavailable": "Unresolved (possibly no such work)", "metadata_mismatch": "Entry and record differ", "verification_unavailable": "Could not be verified (run again)"}
DIMENSIONS = ["novelty", "baselines", "claims", "reproducibility", "clarity"]


def lines(rows: DataFrame, section: str, place: list, line: Column) -> DataFrame:
    """A line each, in its section, at a place within it."""
    at = F.array(*[(F.lit(p) if isinstance(p, int) else p).cast("long") for p in place])
    return rows.select("paper_id", F.lit(SECTIONS.index(section)).alias("section_ord"), at.alias("place"), line.alias("line"))


def heading(rows: DataFrame, section: str, note: str | Column = "") -> DataFrame:
    note = F.lit(note) if isinstance(note, str) else note
    ids = rows.withColumn("_note", note).groupBy("paper_id").agg(F.max("_note").alias("_note"))
    return lines(ids, section, [0, 0], F.concat(F.lit(f"## {TITLES[section]}\n"), F.when(F.col("_note") != "", F.concat(F.lit("\n"), F.col("_note"), F.lit("\n"))).otherwise("")))


def quote(s: Column) -> Column:
    flat = F.replace(T.strip(F.coalesce(s, F.lit(""))), F.lit("\n"), F.lit(" "))
    return F.when(flat == "", "_(empty)_").otherwise(F.concat(F.lit("> "), flat))


def bullets(items: Column) -> Column:
    kept = F.filter(F.transform(F.coalesce(items, F.array()), lambda x: T.strip(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.when(F.size(kept) == 0, "- _(none provided)_").otherwise(F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), x)), "\n"))


def label(verdict: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[verdict]


def rating(low: Column, high: Column, why: Column) -> Column:
    """Clamped to 1..10 and put in order; 5 to 7 if either is no number."""
    lo, hi = low.try_cast("int"), high.try_cast("int")
    fine = lo.isNotNull() & hi.isNotNull()
    clamp = lambda v: F.greatest(F.lit(1), F.least(F.lit(10), v))
    a, b = clamp(F.when(fine, lo).otherwise(5)), clamp(F.when(fine, hi).otherwise(7))
    a, b = F.least(a, b), F.greatest(a, b)
    scale = F.when(a == b, F.concat(F.lit("**"), a.cast("string"), F.lit("/10**"))).otherwise(F.concat(F.lit("**"), a.cast("string"), F.lit("–"), b.cast("string"), F.lit("/10**")))
    return F.concat(scale, F.lit("\n\n"), T.strip(why))


def finding_sections(findings: DataFrame, checked: DataFrame) -> DataFrame:
    """The four families of findings, by kind in fixed order. checked: paper_id, family of the audits that ran; one without findings says so."""
    out = None
    for family, kinds in KINDS.items():
        ran = checked.where(F.col("family") == family).select("paper_id").distinct()
        own = findings.where(F.col("family") == family)
        names = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
        number = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
        clean = ran.join(own, "paper_id", "left_anti")
        ids = ran.union(own.select("paper_id")).distinct()
        counted = own.groupBy("paper_id", "kind").count()
        said = F.concat_ws(" — ", F.concat(F.when(F.col("section").isNotNull(), F.concat(F.lit("_"), F.col("section"), F.lit("_: "))).otherwise(""), F.when(F.col("question").isNotNull(), F.concat(F.lit('"'), F.col("question"), F.lit('"')))), F.when(F.coalesce("response", F.lit("")) != "", F.concat(F.lit('answered "'), F.col("response"), F.lit('"'))), F.when(F.col("severity").isNotNull(), F.concat(F.lit("**"), F.col("severity"), F.lit("**"))), F.col("detail"), T.blank_to_null(F.col("evidence")))
        parts = [heading(ids, family), lines(clean, family, [0, 1], F.lit("Checked; nothing to report.\n"))]
        parts.append(lines(counted, family, [number, -1], F.concat(F.lit("### "), names[F.col("kind")], F.lit(" ("), F.col("count").cast("string"), F.lit(")\n"))))
        parts.append(lines(own, family, [number, F.col("finding_ord")], F.concat(F.lit("- "), said)))
        for p in parts:
            out = p if out is None else out.unionByName(p)
    return out


def citation_section(papers: DataFrame, verifications: DataFrame, refs: DataFrame) -> DataFrame:
    """Flagged references by gravity: the entry as written, its record, and its sites."""
    g = C.groups(verifications).join(refs.select("paper_id", "ref_id", "raw_text"), ["paper_id", "ref_id"])
    r = verifications.groupBy("paper_id", "ref_id").agg(F.min_by("record", "cite_ord").alias("record"))
    g = g.join(r, ["paper_id", "ref_id"])
    none = papers.join(g, "paper_id", "left_anti")
    total = g.groupBy("paper_id").agg(F.count("*").alias("n"), F.sum("n_sites").alias("s"), F.count_if("entry_level").alias("e"))
    top = lines(total, "citations", [0, 1], F.concat(F.lit("**"), F.col("n").cast("string"), F.lit(" reference(s) flagged at "), F.col("s").cast("string"), F.lit(" site(s)**, "), F.col("e").cast("string"), F.lit(" of them for the entry itself.\n")))
    name = F.when(F.col("entry_level") | (F.col("n_sites") == 1), label(F.col("headline"))).otherwise(F.concat(F.col("n_sites").cast("string"), F.lit(" sites flagged (worst: "), label(F.col("headline")), F.lit(")")))
    head = lines(g, "citations", [F.col("rank"), 0], F.concat(F.lit("### "), F.col("rank").cast("string"), F.lit(". `"), F.col("ref_id"), F.lit("` — "), name, F.lit("\n\n**Entry:** "), quote(F.col("raw_text")), F.lit("\n")))
    rec = F.col("record")
    fields = [F.concat(F.lit("- Source: `"), rec["source"], F.lit("`")), F.concat(F.lit("- Title: "), F.coalesce(T.blank_to_null(rec["title"]), F.lit("_(unknown)_"))), F.when(F.size(F.coalesce(rec["authors"], F.array())) > 0, F.concat(F.lit("- Authors: "), F.array_join(F.slice(rec["authors"], 1, 8), ", "))), F.concat(F.lit("- Year: "), rec["year"].cast("string")), F.concat(F.lit("- Venue: "), T.blank_to_null(rec["venue"])), F.concat(F.lit("- DOI: "), T.blank_to_null(rec["doi"]))]
    resolved = F.when(rec.isNull(), "**Record:** _none_\n").otherwise(F.concat(F.lit("**Record:**\n\n"), F.concat_ws("\n", *fields), F.lit("\n")))
    body = lines(g, "citations", [F.col("rank"), 1], resolved)
    # where the entry is at fault its reason stands once; else sites come by gravity
    why = F.coalesce(F.get(F.filter("sites", lambda s: s["verdict"].isin(C.ENTRY_LEVEL)), F.lit(0)), F.get("sites", F.lit(0)))
    entry = g.where("entry_level")
    reason = lines(entry, "citations", [F.col("rank"), 2], F.concat(F.lit("**Verdict:** "), label(why["verdict"]), F.lit("\n\n**Reason:** "), why["rationale"], F.lit("\n\n**Cited at:**\n")))
    ordered = F.array_sort(F.transform("sites", lambda s: F.struct(F.when(F.col("entry_level"), 0).otherwise(s["sev"]).alias("k"), s["cite_ord"].alias("o"), s.alias("s"))))
    sites = g.select("paper_id", "rank", "entry_level", F.posexplode(ordered).alias("k", "x"))
    s = F.col("x.s")
    tag = F.when(s["abstract_only"], "abstract only").otherwise("full text")
    line = F.when(F.col("entry_level"), F.concat((F.col("k") + 1).cast("string"), F.lit(". "), quote(s["sentence"]))).otherwise(F.concat(F.lit("**Site "), (F.col("k") + 1).cast("string"), F.lit(" — "), label(s["verdict"]), F.lit("** _("), tag, F.lit(")_\n\n- Sentence: "), quote(s["sentence"]), F.lit("\n- Reason: "), s["rationale"], F.lit("\n")))
    each = lines(sites, "citations", [F.col("rank"), 3, F.col("k")], line)
    parts = [heading(papers, "citations"), lines(none, "citations", [0, 1], F.lit("_No citation issues found._\n")), top, head, body, reason, each]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hygiene_section(verifications: DataFrame, broken: DataFrame, unused: DataFrame, links: DataFrame) -> DataFrame:
    """Retracted, weakly matched and outdated records, broken references, unused entries, unreachable URLs; only where there is any."""
    flags = C.flagged_records(verifications)
    first = verifications.groupBy("paper_id", "ref_id").agg(F.min_by(F.struct("record", "published_version", "ref_year"), "cite_ord").alias("v"))
    flags = flags.join(first, ["paper_id", "ref_id"])
    year = lambda c: F.coalesce(c.cast("string"), F.lit("no year"))
    key = F.concat(F.lit("- `"), F.col("ref_id"), F.lit("` "))
    parts = [
        (0, "Retracted works", flags.where("retracted"), F.concat(key, F.lit("("), F.col("n_sites").cast("string"), F.lit(" site(s)) "), F.coalesce("v.record.doi", F.lit("")))),
        (1, "Matched by title and authors, other year", flags.where("weak"), F.concat(key, F.lit("bibliography: "), year(F.col("v.ref_year")), F.lit(", record: "), year(F.col("v.record.year")))),
        (2, "Preprints with a published version", flags.where("outdated"), F.concat(key, F.lit("published: "), F.coalesce("v.published_version.venue", "v.published_version.doi", F.lit("a venue version")))),
        (3, "Broken cross-references", broken, F.concat(F.lit("- `\\"), F.col("command"), F.lit("{"), F.col("target"), F.lit("}` — "), F.col("surrounding"))),
        (4, "Unused bibliography entries", unused, F.concat(F.lit("- `"), F.col("ref_id"), F.lit("`"))),
        (5, "Unreachable URLs", links.where("NOT ok"), F.concat(F.lit("- "), F.col("url"), F.lit(" — "), F.coalesce("error", F.concat(F.lit("HTTP "), F.col("status").cast("string")), F.lit("no response")), F.lit(" (from "), F.col("source"), F.lit(")"))),
    ]
    out = None
    for n, title, rows, line in parts:
        order = {3: "at", 5: "at"}.get(n)
        said = rows.withColumn("_line", line)
        said = said.withColumn("_n", F.row_number().over(Window.partitionBy("paper_id").orderBy(*([order] if order else []), "_line")))
        count = said.groupBy("paper_id").count()
        both = lines(count, "hygiene", [n + 1, 0], F.concat(F.lit(f"### {title} ("), F.col("count").cast("string"), F.lit(")\n"))).unionByName(lines(said, "hygiene", [n + 1, F.col("_n")], F.col("_line")))
        out = both if out is None else out.unionByName(both)
    return out.unionByName(heading(out.select("paper_id"), "hygiene"))


def coverage_section(coverage: DataFrame) -> DataFrame:
    """Only where something could not be told."""
    rows = coverage.where("has_coverage_gap")
    line = F.concat(F.lit("- "), F.col("resolution_degraded").cast("string"), F.lit(" site(s) not resolved because a source failed; "), F.col("verification_degraded").cast("string"), F.lit(" not verified because the judge failed. None of them is called absent.\n"))
    return heading(rows, "coverage").unionByName(lines(rows, "coverage", [0, 1], line))


def assessment_section(papers: DataFrame, counts: DataFrame, rated: DataFrame | None = None) -> DataFrame:
    """rated: paper_id, rating_low, rating_high, rating_justification, for a rating beside the counts."""
    rows = papers.select("paper_id").join(counts, "paper_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    out = heading(papers, "assessment").unionByName(lines(rows, "assessment", [0, 1], F.concat(*[x for c in C.BUCKETS for x in (F.lit(f"- {c}: "), n(F.col(c)), F.lit("\n"))])))
    if rated is not None:
        rows = rated.where("rating_low IS NOT NULL OR rating_high IS NOT NULL")
        out = out.unionByName(lines(rows, "assessment", [0, 2], F.concat(rating(F.col("rating_low"), F.col("rating_high"), F.coalesce("rating_justification", F.lit(""))), F.lit("\n"))))
    return out


def prose_sections(prose: DataFrame) -> DataFrame:
    """paper_id, summary, strengths, weaknesses, questions[, error] from a model; blanks are dropped, an empty list says so. Where the call failed, only the summary's place tells of it."""
    failed = F.col("error").isNotNull() if "error" in prose.columns else F.lit(False)
    said = F.when(failed, "_The prose could not be written this time; the rest stands by itself. Run again for it._").otherwise(T.strip(F.coalesce("summary", F.lit("_(none provided)_"))))
    out = heading(prose, "summary").unionByName(lines(prose, "summary", [0, 1], F.concat(said, F.lit("\n"))))
    written = prose.where(~failed)
    for s in ("strengths", "weaknesses", "questions"):
        out = out.unionByName(heading(written, s)).unionByName(lines(written, s, [0, 1], F.concat(bullets(F.col(s)), F.lit("\n"))))
    return out


def reviewer_section(review: DataFrame, asked: DataFrame) -> DataFrame:
    """Objections by dimension, the gravest first; a dimension without any says so. asked: paper_id[, failed]; a call that failed is told of."""
    failed = asked.where("failed").select("paper_id").distinct() if "failed" in asked.columns else asked.limit(0).select("paper_id")
    told = heading(failed, "reviewer2").unionByName(lines(failed, "reviewer2", [0, 1], F.lit("_The adversarial review could not be had this time; the rest stands by itself. Run again for it._\n")))
    asked = (asked.where("NOT failed") if "failed" in asked.columns else asked).select("paper_id").distinct()
    rank = F.array_position(F.array(*[F.lit(x) for x in C.REVIEW_SEVERITIES]), F.col("severity"))
    number = F.array_position(F.array(*[F.lit(d) for d in DIMENSIONS]), F.col("dimension"))
    own = review.where(F.col("dimension").isin(DIMENSIONS))
    every = asked.select("paper_id", F.explode(F.array(*[F.lit(d) for d in DIMENSIONS])).alias("dimension"))
    empty = every.join(own, ["paper_id", "dimension"], "left_anti")
    line = F.concat(F.lit("- **"), F.col("severity"), F.lit("** — "), F.col("issue"), F.when(F.col("evidence") != "", F.concat(F.lit("\n  > "), F.col("evidence"))).otherwise(""), F.when(F.col("suggested_fix") != "", F.concat(F.lit("\n  _Fix:_ "), F.col("suggested_fix"))).otherwise(""))
    return told.unionByName(heading(asked, "reviewer2")).unionByName(lines(every, "reviewer2", [number, -1], F.concat(F.lit("### "), F.initcap("dimension"), F.lit("\n")))).unionByName(lines(own, "reviewer2", [number, rank, F.col("n")], line)).unionByName(lines(empty, "reviewer2", [number, 0], F.lit("- _No issue found._")))


def artifact_section(artifacts: DataFrame) -> DataFrame:
    gone = artifacts.where("status = 'terminal_miss'")
    order = F.row_number().over(Window.partitionBy("paper_id").orderBy("artifact_kind", "identifier"))
    return heading(gone, "artifacts").unionByName(lines(gone.withColumn("_n", order), "artifacts", [0, F.col("_n")], F.concat(F.lit("- "), F.col("url"), F.lit(" does not resolve; check the link"))))


def openreview_section(verifications: DataFrame, decisions: DataFrame) -> DataFrame:
    """One line per reference, at its first site."""
    first = verifications.groupBy("paper_id", "ref_id").agg(F.min("cite_ord").alias("at")).join(decisions, ["paper_id", "ref_id"])
    line = F.concat(F.lit("- `"), F.col("ref_id"), F.lit("` — "), F.coalesce("decision", F.lit("no decision")), F.when(F.col("rating_avg").isNotNull(), F.concat(F.lit(", mean rating "), F.col("rating_avg").cast("string"), F.lit(" of "), F.col("rating_count").cast("string"))).otherwise(""))
    return heading(first, "openreview").unionByName(lines(first, "openreview", [0, F.col("at")], line))


def methodology_section(coverage: DataFrame, model: str, counted=None, skipped: int = 0) -> DataFrame:
    """counted: a row of lookups.counters, if sources were asked in this run; skipped: look-ups of open copies for which there was no e-mail."""
    n = lambda c: F.col(c).cast("string")
    line = F.concat(n("citations_checked"), F.lit(" citation site(s) checked: "), n("resolved"), F.lit(" resolved, "), n("ghost_unresolved"), F.lit(" without a record; "), n("abstract_only_count"), F.lit(" judged by less than the full text, "), n("fetched_full_text_count"), F.lit(f" by the full text. Judge: `{model}`.\n"))
    out = heading(coverage, "methodology").unionByName(lines(coverage, "methodology", [0, 1], line))
    if counted is not None and (counted.recovered or counted.skipped or counted.unchecked):
        down = f" ({', '.join(counted.broken_sources)})" if counted.broken_sources else ""
        said = f"Look-ups of this run: {counted.recovered} answered after a retry, {counted.skipped} left out as their source was down{down}, {counted.unchecked} published version(s) not told.\n"
        out = out.unionByName(lines(coverage, "methodology", [0, 2], F.lit(said)))
    if skipped:
        out = out.unionByName(lines(coverage, "methodology", [0, 3], F.lit(f"{skipped} look-up(s) of open copies were left out for want of an e-mail address.\n")))
    return out


def title_section(papers: DataFrame) -> DataFrame:
    return lines(papers, "title", [0], F.concat(F.lit("# Review: "), F.coalesce("title", F.lit("(untitled)")), F.lit("\n")))


def stitch(parts: list[DataFrame]) -> DataFrame:
    """paper_id, markdown: sections in order. They are gathered first, so a paper with many sites moves its lines once."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    gather = lambda order, line, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), sep)
    sections = every.groupBy("paper_id", "section_ord").agg(gather("place", "line", "\n").alias("text"))
    return sections.groupBy("paper_id").agg(gather("section_ord", "text", "\n\n").alias("markdown"))
