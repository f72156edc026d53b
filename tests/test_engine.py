import pytest
from pyspark.sql import functions as F

from vellum.operators import anonymity, coverage, report, tex, verification
from vellum.plans import engine, sources
from vellum.sources import payloads, tables
from vellum.streaming import incremental


@pytest.fixture(scope="module")
def run(spark):
    m = sources.manuscripts(spark).withColumn("venue_id", F.when(F.col("paper_id") == "p1", "v")).withColumn("authors", F.lit("Ann Roe, bob"))
    rules = spark.createDataFrame([("v", 7, True, True, 20, True, ["lorem"], ["\\textcolor"])], "venue_id string, page_limit_technical int, references_excluded boolean, requires_abstract boolean, min_abstract_words int, checklist_required boolean, placeholder_markers array<string>, color_table_macros array<string>")
    cands = spark.createDataFrame([("p1", "k1", "id", "crossref", 0, "On Graphs", ["Ann Roe"], 2020, "J", "10.1/x", None, "An abstract.", None, False)], engine.EMPTY["candidates"])
    asked = spark.createDataFrame([("p1", "k1", "id", "crossref", "ok"), ("p1", "nokey", "search", "crossref", "terminal")], engine.EMPTY["responses"])
    answers = spark.createDataFrame([("p1", 0, "Supports ", "background", " fine ", None), ("p1", 1, "nonsense", "x", "", None)], engine.EMPTY["answers"])
    probes = spark.createDataFrame([("http://x.y", 200, None, None), ("https://e.org/a", 404, None, None)], engine.EMPTY["probes"])
    return engine.run(m, engine.Inputs({"candidates": cands, "responses": asked, "answers": answers, "probes": probes}, venue_rules=rules, gate=True))


def test_tables(run):
    refs = {(r.paper_id, r.ref_id): r for r in run["refs"].collect()}
    assert refs["p1", "k1"].authors == ["Ann Roe", "Ben Poe"] and refs["p1", "k1"].title == "On Graphs" and refs["p1", "k2"].arxiv_id == "2101.00001" and refs["p1", "nokey"].is_synthetic
    cites = sorted((r.cite_ord, r.ref_id, r.sentence) for r in run["citations"].collect())
    assert [c[:2] for c in cites] == [(0, "k1"), (1, "k1"), (2, "nokey")] and "[CITE" not in cites[1][2]
    assert [(r.ref_id) for r in run["unused"].collect()] == ["k2"]
    assert [(r.command, r.target) for r in run["broken_refs"].collect()] == [("ref", "missing")]
    assert {(r.source, r.url, r.ok) for r in run["links"].collect()} == {("tex_url", "https://github.com/roe/x", False), ("tex_href", "https://e.org/a", False), ("bib_url", "http://x.y", True)}
    assert [tuple(r) for r in run["artifacts"].collect()] == [("p1", "github_repo", "roe/x", "https://github.com/roe/x")]


def test_findings(run):
    kinds = {}
    for r in run["findings"].collect():
        assert r.paper_id == "p1"
        kinds.setdefault(r.family, []).append((r.finding_ord, r.kind))
    kinds = {k: [x for _, x in sorted(v)] for k, v in kinds.items()}
    assert kinds == {
        "anonymization": ["residual_identity", "residual_identity", "self_revealing_phrase", "identity_url", "acknowledgments_present", "author_name_in_body", "dual_submission_tell"],
        "checklist": ["unanswered", "invalid_response", "claim_unsupported"],
        "submission": ["placeholder_abstract", "color_table", "checklist_incomplete"],
        "numeric": ["bounded_metric", "split_mismatch", "hyperparam_drift", "abstract_table_delta"],
    }


def test_verdicts_and_review(run):
    got = {r.cite_ord: (r.verdict, r.role, r.rationale, r.abstract_only) for r in run["verifications"].collect()}
    assert got[0] == ("supports", "background", "fine", True) and got[1] == ("abstract_too_thin", None, "(no rationale returned)", True) and got[2][0] == "target_unavailable"
    c = run["coverage"].collect()
    assert [(r.citations_checked, r.resolved, r.ghost_unresolved, r.has_coverage_gap) for r in c] == [(3, 2, 1, False)]
    assert [(r.ref_id, r.rank, r.entry_level) for r in run["citation_groups"].orderBy("rank").collect()] == [("nokey", 1, True), ("k1", 2, False)]
    assert {r.paper_id: r.exit_code for r in run["exit_codes"].collect()} == {"p1": 4}
    reviews = {r.paper_id: r.markdown for r in run["reviews"].collect()}
    heads = [x for x in reviews["p1"].split("\n") if x.startswith("## ")]
    assert heads == ["## Anonymization", "## Submission readiness", "## Overall assessment", "## Citation issues", "## Hygiene", "## Reproducibility checklist", "## Numerical sanity", "## Methodology"]
    assert reviews["p1"].startswith("# Review: A Nice Title") and "nothing to report" in reviews["p2"] and set(reviews) == {"p1", "p2", "p3"}


def test_names_in_prose(spark):
    rows = [("a", "Roe said so. Smith-Waterman and Roe-X. [CITE:Roe] Pre-Roe. Monroe Roes. A [Roe] x.", "roe; Ann Smith"), ("b", "", "Roe"), ("c", "Roe", None)]
    df = spark.createDataFrame([(p, b, b, s, None, None) for p, b, s in rows], "paper_id string, body string, tex_text string, authors string, author_block string, acknowledgments string")
    assert sorted((r.paper_id, r.evidence) for r in anonymity.author_names(df).collect()) == [("a", "A [Roe] x."), ("a", "Roe said so.")]


def test_sites_that_need_no_judge(spark):
    seen = []

    def judge(rows):
        seen.extend(r.cite_ord for r in rows.collect())
        return rows.select("*", F.lit("supports").alias("raw_verdict"), F.lit(None).cast("string").alias("raw_role"), F.lit("x").alias("raw_rationale"), F.lit(None).cast("string").alias("error"))

    rec = "struct<source:string,title:string,authors:array<string>,year:int,venue:string,doi:string,abstract:string>"
    r = lambda a: ("s", "T", a, 2000, None, None, "abs")
    refs = spark.createDataFrame([("p", k, "raw", "T", ["Ann Roe"], 2000, None, None, None, None) for k in "abcd"], "paper_id string, ref_id string, raw_text string, title string, authors array<string>, year int, venue string, doi string, arxiv_id string, url string")
    res = spark.createDataFrame([("p", "a", "degraded", None, None, []), ("p", "b", "unresolved", None, None, ["n1", "n2", "n3", "n4"]), ("p", "c", "resolved", r(["Bo Poe"]), None, []), ("p", "d", "resolved", r(["A. Roe"]), None, [])], f"paper_id string, ref_id string, status string, record {rec}, match_note string, near_misses array<string>")
    cites = spark.createDataFrame([("p", i, k, "s", None) for i, k in enumerate("abcd")], "paper_id string, cite_ord int, ref_id string, sentence string, section string")
    out = {x.ref_id: x for x in verification.verify(cites, refs, res, spark.createDataFrame([], "paper_id string, ref_id string, full_text string"), judge).collect()}
    assert [out[k].verdict for k in "abcd"] == ["verification_unavailable", "target_unavailable", "metadata_mismatch", "supports"] and set(seen) == {3}
    assert "n3" in out["b"].rationale and "n4" not in out["b"].rationale and all(out[k].abstract_only for k in "abcd")


def test_records(spark):
    from vellum.plans.registry import QUERIES

    got = {r.n: r for r in QUERIES["payload_records"](spark, "").collect()}
    assert (got[0].title, got[0].authors, got[0].year, got[0].venue, got[0].doi, got[0].abstract) == ("On Widgets", "Ann Roe; Poe", 2020, "J. Tests", "10.1/ab", "Short.")
    assert (got[1].url, got[1].authors) == ("https://arxiv.org/abs/2001.00001", "Ann Roe") and got[2].abstract == "a b a" and got[2].doi == "10.1/ab"
    assert (got[3].title, got[3].year, got[3].abstract) == ("On Widgets", 2020, "S & T") and 4 not in got and (got[5].title, got[5].venue) == ("", "Press")
    df = spark.createDataFrame([('{"text":"Zhe Li 0030"}',), ('[{"text":"A B"},{"text":"C D"}]',), ('["E F"]',), ("G H",)], "x string")
    assert [r[0] for r in df.select(payloads.dblp_authors(F.col("x"))).collect()] == [["Zhe Li"], ["A B", "C D"], ["E F"], ["G H"]]
    df = spark.createDataFrame([('{"a":1}',), ('so: ```json\n{"b":2}\n``` ok',), ('see {"c":3} there',), ("list [1,2] x",), ("none",)], "x string")
    assert [r[0] for r in df.select(payloads.loose_json(F.col("x"))).collect()] == ['{"a":1}', '{"b":2}', '{"c":3}', "[1,2]", None]
    s2 = ['{"externalIds":{"DOI":"10.48550/x"},"venue":"arXiv"}', '{"externalIds":{"DBLP":"journals/corr/1"}}', '{"externalIds":{"DBLP":"conf/x"},"venue":"X"}', '{"publicationVenue":{"name":"J","type":"journal"}}']
    assert [r[0] and r[0].venue for r in spark.createDataFrame([(x,) for x in s2], "x string").select(payloads.s2_published(F.col("x"))).collect()] == [None, None, "X", "J"]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "main.tex").write_bytes(b"\\begin{document} \xff \\input{sec/my.checklist} \\bibliography{x, other} \\end{document}")
    (tmp_path / "a" / "other.bib").write_text("@misc{k, title={T}}")
    (tmp_path / "a" / "refs.bib").write_text("@misc{no, title={T}}")
    (tmp_path / "a" / "ReproducibilityChecklist.tex").write_text("\\question{q}{(yes)} yes")
    got = tables.manuscripts(spark, str(tmp_path)).collect()
    assert len(got) == 1 and "\ufffd" in got[0].tex_text and "{k," in got[0].bib_text and "question" in got[0].checklist_text


def test_stream_of_manuscripts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    sources.manuscripts(spark).coalesce(1).write.parquet(src)
    q = incremental.watch(spark, src, out, str(tmp_path / "cp"), lambda rows: tex.papers(rows).select("paper_id", "title"))
    q.awaitTermination()
    got = spark.read.parquet(out).collect()
    assert {(r.paper_id, r.title) for r in got} == {("p1", "A Nice Title"), ("p2", None), ("p3", None)} and all(r.content_hash for r in got)


def test_report_pieces(spark):
    df = spark.createDataFrame([("3", "8", " ok "), ("9", "2", "x"), ("x", "1", "y"), ("12", "12", "z")], "a string, b string, w string")
    assert [r[0] for r in df.select(report.rating(F.col("a"), F.col("b"), F.col("w"))).collect()] == ["**3–8/10**\n\nok", "**2–9/10**\n\nx", "**5–7/10**\n\ny", "**10/10**\n\nz"]
    df = spark.createDataFrame([([" a ", "", None],), ([],), (None,)], "x array<string>")
    assert [r[0] for r in df.select(report.bullets(F.col("x"))).collect()] == ["- a", "- _(none provided)_", "- _(none provided)_"]
    assert [r[0] for r in spark.createDataFrame([("a\nb ",), (" ",)], "x string").select(report.quote(F.col("x"))).collect()] == ["> a b", "_(empty)_"]
    review = coverage.reviewer_findings(spark.createDataFrame([("p", 0, "Claims", "minor", "i", None, "f"), ("p", 1, "claims", "critical", "j", "e", None), ("p", 2, "odd", "major", "k", None, None)], "paper_id string, n int, dimension string, severity string, issue string, evidence string, suggested_fix string"))
    text = report.stitch([report.reviewer_section(review, review.select("paper_id").distinct())]).first().markdown
    assert text.index("critical") < text.index("minor") and text.count("No issue found") == 4


def test_every_oracle_names_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
