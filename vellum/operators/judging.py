"""Models as judges and reviewers: prompts with their limits, answers as loose JSON with one more try, failures as rows.

A model is a function from (prompt, temperature) to text; it may raise. Its calls are tasks of
their own, so a model that is down costs verdicts, never the run.
"""

from __future__ import annotations

import json
import subprocess
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.sources import payloads

from . import report, verification

# Tries of a call, seconds it may take, and how much of a paper a prompt holds.
TRIES, TIMEOUT = 4, 120.0
BODY_LIMIT, BODY_HEAD, BODY_TAIL = 200_000, 120_000, 60_000
BIB_LIMIT, BIB_HEAD, BIB_TAIL = 60_000, 30_000, 30_000
FLAGS, REFERENCES = 30, 60

#: (prompt, temperature; None for the model's own) -> text
Model = Callable[[str, float | None], str]


class Rejected(ValueError):
    """The model does not take a temperature."""


def command(argv: list[str], timeout: float = TIMEOUT) -> Model:
    """A model behind a command: the prompt on its input, the answer on its output. It has no temperature."""

    def call(prompt: str, temperature: float | None) -> str:
        if temperature is not None:
            raise Rejected
        return subprocess.run(argv, input=prompt, capture_output=True, text=True, timeout=timeout, check=True).stdout

    return call


def patient(model: Model, tries: int = TRIES, wait: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """Calls again after a failure; after a refusal of the temperature, without one."""

    def call(prompt: str) -> str:
        temperature: float | None = 0.0
        for n in range(tries):
            try:
                return model(prompt, temperature)
            except Rejected:
                temperature = None
            except Exception:
                if n == tries - 1:
                    raise
                wait(min(8.0, 0.75 * 2**n))
        return model(prompt, temperature)

    return call


def loose(text: str) -> dict | None:
    """The JSON object in an answer: all of it, in a fence, or from the first brace to the last."""
    parts = [text, *text.split("```")[1::2]]
    parts = [p.removeprefix("json") for p in parts] + [text[text.find("{") : text.rfind("}") + 1]]
    for p in parts:
        try:
            found = json.loads(p)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def answers(rows: DataFrame, prompt: str, key: list[str], model: Model, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """key -> answer (JSON text, null if there is none after a second try), error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = patient(model, wait=wait)
        for pdf in batches:
            out = []
            for said in pdf[prompt]:
                found, error = None, None
                try:
                    found = loose(call(said))
                    if found is None:
                        found = loose(call(said))
                    error = None if found is not None else "the answer is no JSON object"
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                out.append((None if found is None else json.dumps(found), error))
            yield pdf[key].assign(answer=[a for a, _ in out], error=[e for _, e in out])

    kinds = dict(rows.dtypes)
    return rows.select(*key, prompt).mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in key), "answer string", "error string"]))


def model_judge(model: Model, wait: Callable[[float], None] = time.sleep) -> verification.Judge:
    """A judge that asks a model about each site."""

    def judge(sites: DataFrame) -> DataFrame:
        asked = verification.question(sites)
        found = answers(asked, "question", ["paper_id", "cite_ord"], model, wait)
        get = lambda k: F.get_json_object("answer", f"$.{k}").alias(f"raw_{k}")
        found = found.select("paper_id", "cite_ord", get("verdict"), get("role"), get("rationale"), "error")
        return sites.join(found, ["paper_id", "cite_ord"])

    return judge


# ---- what a reviewer is told ----


def head_and_tail(text: Column, limit: int = BODY_LIMIT, head: int = BODY_HEAD, tail: int = BODY_TAIL) -> Column:
    """A text longer than limit without its middle."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, head), F.lit("\n\n[... middle left out ...]\n\n"), F.right(text, F.lit(tail)))).otherwise(text)


def first_lines(rows: DataFrame, line: Column, order: list, most: int, none: str) -> DataFrame:
    """paper_id, said: the first lines in order, one of how many more there are, or what stands for none.

    The rank is kept only as far as `most`, and the number of all comes from an aggregate, so nothing is gathered
    that a prompt does not hold.
    """
    rows = rows.withColumn("_line", line)
    total = rows.groupBy("paper_id").agg(F.count("*").alias("_all"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("paper_id").orderBy(*order))).where(F.col("_n") <= most)
    said = rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("_n", "_line"))).alias("x")).join(total, "paper_id")
    more = F.when(F.col("_all") > most, F.concat(F.lit("\n- ... and "), (F.col("_all") - most).cast("string"), F.lit(" more"))).otherwise("")
    text = F.concat(F.array_join(F.transform("x", lambda r: r["_line"]), "\n"), more)
    return said.select("paper_id", F.coalesce(T.blank_to_null(text), F.lit(none)).alias("said"))


def flag_list(groups: DataFrame) -> DataFrame:
    """The gravest flagged references, at most FLAGS, and how many more."""
    why = F.coalesce(F.get(F.filter("sites", lambda s: s["verdict"].isin("metadata_mismatch", "target_unavailable")), F.lit(0))["rationale"], F.get("sites", F.lit(0))["rationale"], F.lit(""))
    line = F.concat(F.lit("- `"), F.col("ref_id"), F.lit("` ("), report.label(F.col("headline")), F.lit(", "), F.col("n_sites").cast("string"), F.lit(" site(s)): "), why)
    return first_lines(groups, line, ["rank"], FLAGS, "- (no citation is flagged)")


def reference_list(refs: DataFrame) -> DataFrame:
    """The first REFERENCES entries, and how many more."""
    year = F.coalesce(F.concat(F.lit(", "), F.col("year").cast("string")), F.lit(""))
    line = F.concat(F.lit("- ["), F.col("ref_id"), F.lit("] "), F.coalesce(T.blank_to_null(T.strip(F.col("title"))), F.lit("(no title)")), year)
    return first_lines(refs, line, ["ordinal", "ref_id"], REFERENCES, "(no references)")


def flag_summary(findings: DataFrame, groups: DataFrame) -> DataFrame:
    """paper_id, said: the numbers of findings of each family and of flagged references."""
    rows = findings.select("paper_id", "family").unionByName(groups.select("paper_id", F.lit("citations").alias("family")))
    rows = rows.groupBy("paper_id", "family").count()
    line = F.concat(F.lit("- "), F.col("family"), F.lit(": "), F.col("count").cast("string"))
    return first_lines(rows, line, ["family"], 10, "(nothing is flagged)")


PROSE = """Review this draft. The citation issues and the method of checking are added by others; weigh them, do not list them.
Title: {title}
Abstract: {abstract}
Flagged citations:
{flags}
Text:
{body}
Answer with one JSON object: {{"summary": string, "strengths": [string], "weaknesses": [string], "questions": [string], "rating_low": 1 to 10, "rating_high": 1 to 10, "rating_justification": string}}. Be specific to this paper; say that the rating is a model's."""
ADVERSARY = """Name what a hard reviewer would object to in this draft, by dimension: {dimensions}.
Title: {title}
Abstract: {abstract}
What it cites:
{references}
What checks found:
{summary}
Text:
{body}
Answer with one JSON object: {{"findings": [{{"dimension": string, "severity": "critical" or "major" or "minor" or "none", "issue": string, "evidence": string, "suggested_fix": string}}]}}. Ground each objection in something that stands in the paper. No score, no decision."""


def _filled(template: str, parts: dict[str, Column]) -> Column:
    out = []
    for k, piece in enumerate(template.replace("{{", "\x00").replace("}}", "\x01").replace("}", "{").split("{")):
        out.append(F.coalesce(parts[piece], F.lit("")) if k % 2 else F.lit(piece.replace("\x00", "{").replace("\x01", "}")))
    return F.concat(*out)


def review_prompts(papers: DataFrame, refs: DataFrame, findings: DataFrame, groups: DataFrame) -> DataFrame:
    """paper_id, prose_prompt, adversary_prompt."""
    rows = papers.select("paper_id", "title", "abstract", "body")
    for name, said in (("flags", flag_list(groups)), ("references", reference_list(refs)), ("summary", flag_summary(findings, groups))):
        rows = rows.join(said.withColumnRenamed("said", name), "paper_id", "left")
    said = lambda c, none: F.coalesce(T.blank_to_null(F.col(c)), F.lit(none))
    parts = {"title": said("title", "(unknown)"), "abstract": said("abstract", "(not found)"), "body": head_and_tail(F.coalesce("body", F.lit(""))), "flags": said("flags", "- (no citation is flagged)"), "references": said("references", "(no references)"), "summary": said("summary", "(nothing is flagged)"), "dimensions": F.lit(", ".join(report.DIMENSIONS))}
    return rows.select("paper_id", _filled(PROSE, parts).alias("prose_prompt"), _filled(ADVERSARY, parts).alias("adversary_prompt"))


def reviewed(prompts: DataFrame, model: Model, wait: Callable[[float], None] = time.sleep) -> tuple[DataFrame, DataFrame]:
    """prose (paper_id, summary, strengths, ..., error) and adversary (paper_id, n, dimension, ..., and failed): two calls, each of which may fail alone."""
    prose = answers(prompts, "prose_prompt", ["paper_id"], model, wait)
    schema = "summary string, strengths array<string>, weaknesses array<string>, questions array<string>, rating_low string, rating_high string, rating_justification string"
    prose = prose.select("paper_id", F.from_json("answer", schema).alias("a"), "error").select("paper_id", "a.*", "error")
    each = "findings array<struct<dimension:string,severity:string,issue:string,evidence:string,suggested_fix:string>>"
    found = answers(prompts, "adversary_prompt", ["paper_id"], model, wait)
    found = found.select("paper_id", F.from_json("answer", each)["findings"].alias("f"), F.col("error").isNotNull().alias("failed"))
    return prose, found.select("paper_id", "failed", F.posexplode_outer("f").alias("n", "x")).select("paper_id", "failed", "n", "x.*")


def bibliography_prompt(section: Column) -> Column:
    """What a model that reads a bibliography is given of it."""
    return head_and_tail(section, BIB_LIMIT, BIB_HEAD, BIB_TAIL)


BIBLIOGRAPHY = """List the entries of this bibliography, each as it stands.
{section}
Answer with one JSON object: {{"entries": [{{"ref_id": string (its number or key), "raw_text": string, "authors": [string], "title": string, "year": number or null, "venue": string or null, "doi": string or null, "arxiv_id": string or null, "url": string or null}}]}}."""


def read_bibliography(papers: DataFrame, model: Model, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """papers: paper_id, references_text -> entries that a model read off it, less those whose text does not stand in it."""
    from . import pages

    asked = papers.where("coalesce(references_text, '') <> ''").select("paper_id", "references_text", _filled(BIBLIOGRAPHY, {"section": bibliography_prompt(F.col("references_text"))}).alias("prompt"))
    found = answers(asked, "prompt", ["paper_id"], model, wait).where("answer IS NOT NULL")
    each = "entries array<struct<ref_id:string,raw_text:string,authors:array<string>,title:string,year:int,venue:string,doi:string,arxiv_id:string,url:string>>"
    found = found.select("paper_id", F.posexplode(F.from_json("answer", each)["entries"]).alias("ordinal", "e")).select("paper_id", "ordinal", "e.*")
    rows = pages.grounded_entries(found.join(asked.select("paper_id", "references_text"), "paper_id")).drop("references_text")
    return rows.withColumn("authors", F.coalesce("authors", F.array().cast("array<string>"))).withColumn("is_synthetic", F.lit(False))


def parsed(text: Column) -> Column:
    """The same reading of loose JSON as a Column."""
    return payloads.loose_json(text)
