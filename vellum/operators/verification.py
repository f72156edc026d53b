"""Whether a cited work supports its sentence. What needs no judge is decided first; only the rest reaches one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import match as M
from vellum.functions import text as T

KEY = ["paper_id", "ref_id"]
# The answers a judge may give, and the marker that keys stored verdicts.
JUDGED = ["supports", "partially_supports", "does_not_support", "abstract_too_thin"]
ROLES = ["method_attribution", "claim_support", "background"]
PROMPT_VERSION = "v2-roles"
EVIDENCE_CHARS = 80_000
NO_EVIDENCE = "(no abstract or full text was retrievable for this paper)"

Judge = Callable[[DataFrame], DataFrame]


def mismatch(authors: Column, record: Column, title: Column) -> Column:
    """Why an entry and its record cannot be one work, or null."""
    a, b = M.surnames(authors), M.surnames(record["authors"])
    listed = lambda s: F.array_join(F.array_sort(s), ", ")
    titles = F.when((F.coalesce(title, F.lit("")) != "") & (F.coalesce(record["title"], F.lit("")) != ""), F.concat(F.lit(' The record is titled "'), record["title"], F.lit('" (bibliography: "'), title, F.lit('").'))).otherwise("")
    return F.when(M.surname_mismatch(authors, record["authors"]), F.concat(F.lit("No surname in common between the bibliography ("), listed(a), F.lit(") and the resolved record ("), listed(b), F.lit("): a wrong attribution or a wrong DOI."), titles))


def short_circuit(citations: DataFrame, refs: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Citation sites with their reference and resolution; verdict and rationale are set where no judge is needed."""
    r = refs.select(*KEY, "raw_text", "title", "authors", F.col("year").alias("ref_year"), "venue", "doi", "arxiv_id", F.col("url").alias("ref_url"))
    rows = citations.join(r, KEY).join(resolutions, KEY)
    why = mismatch(F.col("authors"), F.col("record"), F.col("title"))
    shown = F.array_join(F.slice("near_misses", 1, 3), "; ")
    absent = F.concat(F.lit("No record in Crossref, Semantic Scholar, arXiv or OpenAlex."), F.when(F.size("near_misses") > 0, F.concat(F.lit(" Title searches gave "), shown, F.lit(", turned down for the year and the authors; if one of them is meant, the entry is wrong."))).otherwise(""))
    verdict = F.when(F.col("status") == "degraded", "verification_unavailable").when(F.col("record").isNull(), "target_unavailable").when(why.isNotNull(), "metadata_mismatch")
    rationale = F.when(F.col("status") == "degraded", "A source failed after retries, so the entry could not be resolved; it is not known to be absent.").when(F.col("record").isNull(), absent).otherwise(why)
    return rows.withColumn("verdict", verdict).withColumn("rationale", rationale)


def with_evidence(rows: DataFrame, full_texts: DataFrame) -> DataFrame:
    """evidence and abstract_only: the full text up to EVIDENCE_CHARS, else the abstract, else a remark. full_texts: KEY, full_text."""
    rows = rows.join(full_texts, KEY, "left")
    full = T.blank_to_null(F.substring("full_text", 1, EVIDENCE_CHARS))
    text = F.coalesce(full, F.col("record.abstract"))
    blank = T.strip(F.coalesce(text, F.lit(""))) == ""
    return rows.withColumn("evidence", F.when(blank, NO_EVIDENCE).otherwise(text)).withColumn("abstract_only", full.isNull() | blank).drop("full_text")


def evidence_marker(abstract_only: Column, evidence: Column) -> Column:
    return F.concat(F.lit(f"prompt={PROMPT_VERSION}|abstract_only="), abstract_only.cast("int").cast("string"), F.lit("|evlen="), F.length(evidence).cast("string"))


QUESTION = """Does the cited work support the sentence? First say what the citation is for, then judge it by that.

Sentence: {sentence}
Bibliography entry: {entry}
Cited work ({source}): {title}; {authors}; {year}; {venue}
Evidence ({kind}): {evidence}

Roles, the first that fits: method_attribution (the sentence uses or names a method, tool or dataset: is this the work that defines it?), claim_support (a specific claim: does the evidence bear it out?), background (related work: is it on the topic?).
Verdicts: supports, partially_supports, does_not_support, abstract_too_thin (the evidence cannot tell).
A work that defines a method need not hold the results of papers that use it. Say nothing that the evidence does not.
Answer in JSON: {{"role": ..., "verdict": ..., "rationale": one sentence}}"""


def question(rows: DataFrame) -> DataFrame:
    """Adds question, what a judge that reads is asked about a site."""
    r = F.col("record")
    parts = {"sentence": F.col("sentence"), "entry": F.coalesce("raw_text", F.lit("(not extracted)")), "source": r["source"], "title": r["title"], "authors": F.coalesce(T.blank_to_null(F.array_join(F.slice(r["authors"], 1, 5), ", ")), F.lit("(unknown)")), "year": F.coalesce(r["year"].cast("string"), F.lit("(unknown)")), "venue": F.coalesce(T.blank_to_null(r["venue"]), F.lit("(unknown)")), "kind": F.when(F.col("abstract_only"), "abstract").otherwise("from the full text"), "evidence": F.col("evidence")}
    text = []
    for piece in QUESTION.replace("{{", "\x00").replace("}}", "\x01").replace("{", "\x02").replace("}", "\x02").split("\x02"):
        text.append(F.coalesce(parts[piece], F.lit("")) if piece in parts else F.lit(piece.replace("\x00", "{").replace("\x01", "}")))
    return rows.withColumn("question", F.concat(*text))


def coerce(answers: DataFrame) -> DataFrame:
    """raw_verdict, raw_role, raw_rationale, error -> verdict, role, rationale. A failed call is no verdict on the paper."""
    low = lambda c: F.lower(T.strip(F.coalesce(c, F.lit(""))))
    verdict = F.when(F.col("error").isNotNull(), "verification_unavailable").when(low("raw_verdict").isin(JUDGED), low("raw_verdict")).otherwise("abstract_too_thin")
    role = F.when(F.col("error").isNull() & low("raw_role").isin(ROLES), low("raw_role"))
    rationale = F.when(F.col("error").isNotNull(), "The judge could not be reached, so the citation was not checked.").otherwise(F.coalesce(T.blank_to_null(T.strip(F.col("raw_rationale"))), F.lit("(no rationale returned)")))
    return answers.withColumn("verdict", verdict).withColumn("role", role).withColumn("rationale", rationale).drop("raw_verdict", "raw_role", "raw_rationale", "error")


def table_judge(answers: DataFrame) -> Judge:
    """A judge that looks answers up: answers has paper_id, cite_ord, raw_verdict, raw_role, raw_rationale, error. A site without a row counts as a failed call."""
    return lambda sites: sites.join(answers.withColumn("_answered", F.lit(True)), ["paper_id", "cite_ord"], "left").withColumn("error", F.when(F.col("_answered").isNull(), "no answer").otherwise(F.col("error"))).drop("_answered")


def verify(citations: DataFrame, refs: DataFrame, resolutions: DataFrame, full_texts: DataFrame, judge: Judge, model: str = "table", stored: DataFrame | None = None) -> DataFrame:
    """A verdict per citation site. Only sites that the ladder leaves, and that no stored verdict answers, reach the judge.

    stored: verification_key, verdict, role, rationale of earlier runs.
    """
    rows = short_circuit(citations, refs, resolutions)
    done = rows.where("verdict IS NOT NULL").withColumn("abstract_only", F.lit(True)).withColumn("role", F.lit(None).cast("string")).withColumn("verification_key", F.lit(None).cast("string"))
    rest = with_evidence(rows.where("verdict IS NULL").drop("verdict", "rationale"), full_texts)
    rest = rest.withColumn("verification_key", M.verification_key(F.lit(model), F.col("ref_id"), F.col("sentence"), evidence_marker(F.col("abstract_only"), F.col("evidence"))))
    parts = [done]
    if stored is not None:
        parts.append(rest.join(stored, "verification_key").drop("evidence"))
        rest = rest.join(stored, "verification_key", "left_anti")
    parts.append(coerce(judge(rest)).drop("evidence"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def new_verdicts(verifications: DataFrame) -> DataFrame:
    """verification_key, verdict, role, rationale of what was judged, for later runs; a failed call is none."""
    rows = verifications.where("verification_key IS NOT NULL AND verdict <> 'verification_unavailable'")
    return rows.groupBy("verification_key").agg(F.min_by(F.struct("verdict", "role", "rationale"), F.struct("paper_id", "cite_ord")).alias("x")).select("verification_key", "x.*")


def open_access_candidates(record_url: Column, ref_url: Column, unpaywall: Column, openalex: Column) -> Column:
    """Where a full text may be, in the order to try, each once."""
    bib = F.when(F.lower(ref_url).endswith(".pdf") | M.is_open_access(ref_url), ref_url)
    return F.array_distinct(F.array_compact(F.array(*[T.blank_to_null(u) for u in (record_url, bib, unpaywall, openalex)])))


def first_full_text(fetched: DataFrame) -> DataFrame:
    """fetched: KEY, pos, status, content_type, body -> the body of the first that is a PDF."""
    pdf = (F.col("status") == 200) & (F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("pdf")) | (F.substring("body", 1, 4) == F.lit(b"%PDF")))
    return fetched.where(pdf).groupBy(*KEY).agg(F.min_by("body", "pos").alias("body"))


def venue_decisions(replies: DataFrame) -> DataFrame:
    """replies: KEY, reply_ord, decision, rating -> first decision, mean of numeric ratings (half to even), their number; none if there is neither."""
    number = F.regexp_extract("rating", r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    rows = replies.withColumn("number", number).groupBy(*KEY).agg(F.min_by("decision", F.when(T.blank_to_null(F.col("decision")).isNotNull(), F.col("reply_ord"))).alias("decision"), F.avg("number").alias("mean"), F.count("number").cast("int").alias("rating_count"))
    return rows.where("decision IS NOT NULL OR mean IS NOT NULL").select(*KEY, "decision", F.bround("mean", 2).alias("rating_avg"), "rating_count")
