"""One review run over many manuscripts: every table of it as a DataFrame. Stages are written to the shared folder once and read from there."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import anonymity, checklist, coverage, findings, judging, lookups, numbers, pages, report, resolution, submission, tex, verification
from vellum.functions import match as M
from vellum.sources import pdf, probing, tables
from vellum.sources.scratch import stored

EMPTY = {
    "responses": "paper_id string, ref_id string, mode string, source string, tag string",
    "candidates": "paper_id string, ref_id string, mode string, source string, item_rank int, title string, authors array<string>, year int, venue string, doi string, url string, abstract string, open_access_pdf_url string, is_retracted boolean",
    "retracted": "doi string, is_retracted boolean",
    "published": "paper_id string, ref_id string, published_version struct<venue:string,year:int,doi:string,url:string,source:string>",
    "full_texts": "paper_id string, ref_id string, full_text string",
    "answers": "paper_id string, cite_ord int, raw_verdict string, raw_role string, raw_rationale string, error string",
    "probes": "url string, head_status int, get_status int, error string",
    "baseline": "paper_id string, baseline_abstract string",
    "entries": "paper_id string, ordinal int, ref_id string, raw_text string, authors array<string>, title string, year int, venue string, doi string, arxiv_id string, url string",
    "artifact_probes": "artifact_kind string, identifier string, status_code int, parseable boolean",
    "replies": "paper_id string, ref_id string, reply_ord int, decision string, rating string",
    "prose": "paper_id string, summary string, strengths array<string>, weaknesses array<string>, questions array<string>, rating_low string, rating_high string, rating_justification string, error string",
    "adversary": "paper_id string, failed boolean, n int, dimension string, severity string, issue string, evidence string, suggested_fix string",
}


@dataclass
class Inputs:
    """Tables that connectors fill, and functions that fill them. A table that is left out is empty: nothing was asked, so nothing is known."""

    given: dict[str, DataFrame] = field(default_factory=dict)
    judge: verification.Judge | None = None
    venue_rules: DataFrame | None = None
    gate: bool = False
    model: str = "table"
    #: Families of findings that are not looked for.
    skip: list[str] = field(default_factory=list)
    #: Asks the scholarly sources; without it resolutions come from the given responses and candidates.
    ask: lookups.Ask | None = None
    #: Records and verdicts of earlier runs.
    store: DataFrame | None = None
    verdicts: DataFrame | None = None
    #: A model that writes prose and objections, and reads bibliographies of page texts.
    writer: judging.Model | None = None
    show_rating: bool = False
    #: Sends probes of links and artifacts, and fetches cited works; extract reads their PDF files, of which pdfs (cache_key, body) were fetched before.
    send: probing.Send | None = None
    extract: pdf.Extract = pdf.page_texts
    email: str | None = None
    pdfs: DataFrame | None = None

    def get(self, spark: SparkSession, name: str) -> DataFrame:
        found = self.given.get(name)
        return spark.createDataFrame([], EMPTY[name]) if found is None else found


def read_pages(manuscripts: DataFrame, inputs: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers, entries and citations of manuscripts that are page texts. Where every entry is a number, citations are numbers in brackets, else authors and years."""
    spark = manuscripts.sparkSession
    papers = stored(pages.papers(manuscripts), "page-papers")
    entries = inputs.get(spark, "entries") if inputs.writer is None or "entries" in inputs.given else judging.read_bibliography(papers, inputs.writer).drop("is_synthetic")
    entries = stored(entries.join(papers.select("paper_id"), "paper_id").withColumn("is_synthetic", F.lit(False)), "page-entries")
    numbered = entries.groupBy("paper_id").agg(F.bool_and(F.col("ref_id").rlike(r"^\d+$")).alias("numbered"))
    kind = lambda is_: papers.join(numbered.where(F.col("numbered") == is_), "paper_id", "left_semi")
    cites = pages.numeric_citations(kind(True), entries).unionByName(pages.author_year_citations(kind(False), entries))
    return papers, entries, cites.withColumn("section", F.lit(None).cast("string"))


def cited_texts(refs: DataFrame, resolved: DataFrame, inputs: Inputs) -> tuple[DataFrame, DataFrame, int]:
    """Full texts of cited works (KEY, full_text), the files fetched for them (cache_key, body), and how often there was no e-mail to ask with."""
    first = F.get("record.authors", F.lit(0))
    keyed = resolved.where("record IS NOT NULL").select(*resolution.KEY, M.cache_key(F.col("record.doi"), F.lit(None).cast("string"), F.col("record.title"), first).alias("cache_key"))
    keyed = stored(keyed, "cited-keys")
    known = keyed.join(inputs.pdfs.select("cache_key", "body"), "cache_key") if inputs.pdfs is not None else None
    places = stored(lookups.open_access_urls(resolved, refs, inputs.ask, inputs.email), "cited-places")
    wanted = places if known is None else places.join(known.select(*resolution.KEY), resolution.KEY, "left_anti")
    bodies = verification.first_full_text(probing.fetch_pdfs(wanted, inputs.send)).join(keyed, resolution.KEY)
    bodies = stored(bodies.select(*resolution.KEY, "cache_key", "body"), "cited-bodies")
    every = bodies if known is None else bodies.unionByName(known.select(*resolution.KEY, "cache_key", "body"))
    texts = every.select(*resolution.KEY, pdf.full_text(F.col("body"), inputs.extract).alias("full_text")).where("full_text IS NOT NULL")
    new = bodies.groupBy("cache_key").agg(F.min_by("body", F.struct(*resolution.KEY)).alias("body"))
    return stored(texts, "cited-texts"), new, places.where("unpaywall_skipped").count()


def run(manuscripts: DataFrame, inputs: Inputs | None = None) -> dict[str, DataFrame]:
    """manuscripts: paper_id, tex_text, bib_text, checklist_text[, pages, venue_id, authors] -> the tables of a review, among them reviews (paper_id, markdown) and exit_codes.

    A manuscript with pages (array<string>) and no tex_text is read by its pages: the checks that need a
    source are not run on it.
    """
    inputs, spark = inputs or Inputs(), manuscripts.sparkSession
    for c, kind in (("tex_text", "string"), ("bib_text", "string"), ("checklist_text", "string"), ("pages", "array<string>"), ("venue_id", "string"), ("authors", "string")):
        if c not in manuscripts.columns:
            manuscripts = manuscripts.withColumn(c, F.lit(None).cast(kind))
    by_pages = F.col("pages").isNotNull() & F.col("tex_text").isNull()
    has_pages = "pages" in manuscripts.columns and bool(manuscripts.where(by_pages).take(1))
    sources = manuscripts.where(~by_pages) if has_pages else manuscripts
    about = manuscripts.select("paper_id", "venue_id", "authors", (F.coalesce("checklist_text", F.lit("")) != "").alias("checklist_found"))
    papers = stored(tex.papers(sources).join(about, "paper_id"), "papers")
    entries = stored(tex.refs(sources), "entries")
    cites = stored(tex.citations(papers), "citations")
    refs = stored(entries.unionByName(tex.ghosts(cites, entries)), "refs")
    every = papers
    if has_pages:
        page_papers, page_entries, page_cites = read_pages(manuscripts.where(by_pages), inputs)
        page_papers = stored(page_papers.join(about, "paper_id"), "page-papers-about")
        refs = stored(refs.unionByName(page_entries), "refs-all")
        cites_all = stored(cites.unionByName(page_cites), "citations-all")
        every = stored(papers.unionByName(page_papers, allowMissingColumns=True), "papers-all")
    else:
        page_papers, cites_all = None, cites
    named = stored(tex.links(sources, entries), "links-named")
    probes = probing.probe_links(named, inputs.send) if inputs.send is not None and "probes" not in inputs.given else inputs.get(spark, "probes")
    links = stored(tables.link_outcomes(named.join(probes, "url", "left")), "links")
    broken, unused = stored(tex.broken_refs(sources), "broken"), stored(tex.unused_keys(entries, cites), "unused")
    items = stored(checklist.items(sources), "checklist")
    checked = stored(checklist.audit(items, papers, links), "checked")
    rules = inputs.venue_rules if inputs.venue_rules is not None else submission.venues(spark)
    baseline = inputs.get(spark, "baseline")
    audits = {"anonymization": lambda: anonymity.audit(papers, links), "submission": lambda: submission.audit_tex(papers, rules, checked, baseline), "numeric": lambda: numbers.audit(papers)}
    found = [checked, *[make() for family, make in audits.items() if family not in inputs.skip]]
    if page_papers is not None and "submission" not in inputs.skip:
        found.append(submission.audit_pages(page_papers, rules))
    found = stored(findings.numbered(findings.union(found)), "findings")

    counted, new_records = None, None
    if inputs.ask is not None:
        looked = lookups.resolve_all(refs, inputs.ask, inputs.store)
        resolved, new_records = looked["resolutions"], looked["new_records"]
        counted = lookups.counters(looked["responses"], resolved).first()  # one row
    else:
        resolved = resolution.resolve(refs, inputs.get(spark, "responses"), inputs.get(spark, "candidates"))
        resolved = resolution.with_retractions(resolved, inputs.get(spark, "retracted")).join(inputs.get(spark, "published"), ["paper_id", "ref_id"], "left")
    judge = inputs.judge or (judging.model_judge(inputs.writer) if inputs.writer is not None and "answers" not in inputs.given else verification.table_judge(inputs.get(spark, "answers")))
    resolved = stored(resolved, "resolutions")
    texts, new_pdfs, skipped = inputs.get(spark, "full_texts"), None, 0
    if inputs.ask is not None and inputs.send is not None and "full_texts" not in inputs.given:
        texts, new_pdfs, skipped = cited_texts(refs, resolved, inputs)
    verified = stored(verification.verify(cites_all, refs, resolved, texts, judge, inputs.model, inputs.verdicts), "verifications")
    covered = stored(coverage.coverage(verified), "coverage")
    grouped = stored(coverage.groups(verified), "groups")
    blockers = submission.gate_blockers(found)
    artifacts = stored(tables.artifacts(every, links), "artifacts")
    probed = probing.probe_artifacts(artifacts, inputs.send) if inputs.send is not None and "artifact_probes" not in inputs.given else inputs.get(spark, "artifact_probes")
    claimed = stored(tables.artifact_outcomes(artifacts.join(probed, ["artifact_kind", "identifier"])), "artifact-outcomes")
    decisions = stored(verification.venue_decisions(inputs.get(spark, "replies")), "decisions")
    if inputs.writer is not None and not {"prose", "adversary"} & {*inputs.given}:
        prompts = stored(judging.review_prompts(every, refs, found, grouped), "prompts")
        prose, adversary = (stored(x, n) for x, n in zip(judging.reviewed(prompts, inputs.writer), ("prose", "adversary")))
    else:
        prose, adversary = inputs.get(spark, "prose"), inputs.get(spark, "adversary")
    objections = stored(coverage.reviewer_findings(adversary.where("n IS NOT NULL")), "objections")
    counts = coverage.assessment(objections, found.where("family = 'submission'"), grouped)
    ran = F.array_compact(F.array(F.lit(None if "anonymization" in inputs.skip else "anonymization"), F.when(F.col("checklist_found"), "checklist")))
    ran = papers.select("paper_id", F.explode(ran).alias("family"))
    degraded = prose.where("error IS NOT NULL").select("paper_id").union(adversary.where("failed").select("paper_id")).distinct()
    reviews = report.stitch([
        report.title_section(every), report.coverage_section(covered), report.finding_sections(found, ran), report.assessment_section(every, counts, prose if inputs.show_rating else None),
        report.prose_sections(prose), report.reviewer_section(objections, adversary),
        report.citation_section(every, verified, refs), report.hygiene_section(verified, broken, unused, links),
        report.artifact_section(claimed), report.openreview_section(verified, decisions), report.methodology_section(covered, inputs.model, counted, skipped),
    ])
    out = {
        "papers": every, "refs": refs, "citations": cites_all, "broken_refs": broken, "unused": unused, "links": links, "checklist_items": items, "findings": found,
        "resolutions": resolved, "verifications": verified, "coverage": covered, "citation_groups": grouped, "gate_blockers": blockers, "artifacts": artifacts, "artifact_outcomes": claimed, "decisions": decisions,
        "reviews": reviews, "exit_codes": coverage.exit_code(covered, blockers, inputs.gate, degraded), "new_baselines": submission.new_baselines(papers, baseline),
        "new_verdicts": verification.new_verdicts(verified),
    }
    extra = {"new_records": new_records, "new_pdfs": new_pdfs}
    return out | {k: v for k, v in extra.items() if v is not None}


def register(result: dict[str, DataFrame], prefix: str = "review_") -> None:
    """Every table as a temporary view."""
    for name, df in result.items():
        df.createOrReplaceTempView(prefix + name)
