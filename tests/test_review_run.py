"""A whole run with sources, pages, models, artifacts and notes, none of which needs a network."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from vellum.functions import match as M
from vellum.operators import judging, lookups, verification
from vellum.plans import engine, sources
from vellum.sources import pdf, probing, tables

from .test_lookups import ANSWER, answers, crossref


def writer(prompt, temperature):
    if temperature is not None:
        raise judging.Rejected
    if prompt.startswith("List the entries"):
        return json.dumps({"entries": [{"ref_id": "1", "raw_text": "[1] Roe. Sparse Widgets. 2020.", "authors": ["Ann Roe"], "title": "Sparse Widgets", "year": 2020}, {"ref_id": "2", "raw_text": "made up", "authors": [], "title": "No Such"}]})
    if prompt.startswith("Review this draft"):
        return 'Here: ```json\n{"summary": " fine ", "strengths": ["a", ""], "weaknesses": [], "questions": ["q?"], "rating_low": 9, "rating_high": "3", "rating_justification": "a model says so"}\n```'
    if prompt.startswith("Name what"):
        return '{"findings": [{"dimension": "Claims", "severity": "Major", "issue": "too bold", "evidence": "e", "verdict": "reject"}, {"dimension": "novelty", "severity": "none", "issue": "x"}]}'
    return '{"verdict": "supports", "role": "claim_support", "rationale": "it does"}'


@pytest.fixture(scope="module")
def run(spark):
    text = ["A Study of Widgets\nAbstract\nWe look.\n1 Introduction\nAs shown [1], it works. Code: https://github.com/roe/gone here.", "References\n[1] Roe. Sparse Widgets. 2020."]
    m = spark.createDataFrame([("t", sources.TEX, sources.BIB, sources.CHECKLIST, None), ("g", None, None, None, text)], "paper_id string, tex_text string, bib_text string, checklist_text string, pages array<string>")
    rows = [r for r in answers() if r[2] != "On Graphs"] + [("crossref", "search", "On Graphs", "ok", json.dumps({"message": {"items": [crossref("On Graphs", 2020, doi="10.1/g")]}}))]
    probes = spark.createDataFrame([("github_repo", "roe/gone", 404, True), ("github_repo", "roe/x", 200, True)], engine.EMPTY["artifact_probes"])
    replies = spark.createDataFrame([("t", "k1", 0, "Accept", "7: fine")], engine.EMPTY["replies"])
    return engine.run(m, engine.Inputs({"artifact_probes": probes, "replies": replies}, ask=lookups.recorded(spark.createDataFrame(rows, ANSWER)), writer=writer, show_rating=True))


def test_pages_are_read_resolved_and_judged(run):
    refs = {(r.paper_id, r.ref_id) for r in run["refs"].collect()}
    assert ("g", "1") in refs and ("g", "2") not in refs and ("t", "k1") in refs  # an entry that does not stand in the source goes
    got = {(r.paper_id, r.ref_id): r for r in run["verifications"].collect()}
    assert got["g", "1"].verdict == "supports" and got["g", "1"].record.doi == "10.1/s" and got["t", "k1"].record.doi == "10.1/g"
    assert run["new_verdicts"].count() >= 2 and run["new_records"].count() == 2
    assert {(r.paper_id, r.identifier, r.status) for r in run["artifact_outcomes"].collect()} == {("g", "roe/gone", "terminal_miss"), ("t", "roe/x", "hit")}


def test_every_section_is_stitched(run):
    reviews = {r.paper_id: r.markdown for r in run["reviews"].collect()}
    heads = [x[3:] for x in reviews["t"].split("\n") if x.startswith("## ")]
    assert heads == ["Anonymization", "Overall assessment", "Summary", "Strengths", "Weaknesses", "Reviewer 2", "Citation issues", "Hygiene", "Reproducibility checklist", "Numerical sanity", "OpenReview decisions", "Questions", "Methodology"]
    assert "**3–9/10**" in reviews["t"] and "too bold" in reviews["g"] and "reject" not in reviews["g"].lower() and "roe/gone does not resolve" in reviews["g"]
    assert "## Anonymization" not in reviews["g"]  # a check that needs the source


def test_cited_works_are_fetched_read_and_kept(spark, run):
    raw = small_pdf(b"BT (Full text of the widgets) Tj ET")

    def send(method, url, timeout):
        return (200, "application/pdf", raw) if url == "http://u" else (404, "", b"")

    rows = [("unpaywall", "open_access", "10.1/s", "ok", '{"best_oa_location": {"url_for_pdf": "http://u"}}')]
    inputs = engine.Inputs(ask=lookups.recorded(spark.createDataFrame(rows, ANSWER)), send=send, email="a@b.c")
    texts, new, skipped = engine.cited_texts(run["refs"], run["resolutions"], inputs)
    assert [(r.paper_id, r.ref_id, r.full_text) for r in texts.collect()] == [("g", "1", "Full text of the widgets")] and skipped == 0
    again = engine.Inputs(ask=inputs.ask, send=lambda *a: (404, "", b""), pdfs=new)
    texts, new, skipped = engine.cited_texts(run["refs"], run["resolutions"], again)
    assert texts.count() == 1 and new.count() == 0 and skipped == 2  # from the files kept; no e-mail to ask with


def test_stores_keep_the_latest_row_of_a_key(spark, tmp_path):
    path = str(tmp_path / "store")
    assert tables.read_store(spark, path, "k") is None
    for rows in ([("a", 1), ("b", 2)], [("a", 3)]):
        tables.append_store(spark.createDataFrame(rows, "k string, v int"), path)
    assert sorted(map(tuple, tables.read_store(spark, path, "k").collect())) == [("a", 3), ("b", 2)]


def test_a_model_that_fails_costs_its_parts_only(spark):
    def broken(prompt, temperature):
        raise RuntimeError("down")

    prompts = spark.createDataFrame([("p", "a", "b")], "paper_id string, prose_prompt string, adversary_prompt string")
    prose, found = judging.reviewed(prompts, broken, wait=lambda s: None)
    assert prose.first().error.startswith("RuntimeError") and found.first().failed
    asked = []

    def mumbles(prompt, temperature):
        asked.append(1)
        return "no json" if len(asked) % 2 else '{"x": 1}'

    got = judging.answers(prompts, "prose_prompt", ["paper_id"], mumbles, wait=lambda s: None).first()
    assert json.loads(got.answer) == {"x": 1} and got.error is None  # the second try
    assert judging.loose("x {\"a\": 1} y") == {"a": 1} and judging.loose("[1]") is None
    assert judging.patient(judging.command(["cat"]))("hello") == "hello"


def test_lists_in_prompts_end_somewhere(spark):
    refs = spark.createDataFrame([("p", f"r{k}", f"T{k}" if k else " ", 2000 if k % 2 else None, k) for k in range(70)] + [("q", "a", "T", None, 0)], "paper_id string, ref_id string, title string, year int, ordinal int")
    got = {r.paper_id: r.said.split("\n") for r in judging.reference_list(refs).collect()}
    assert len(got["p"]) == 61 and got["p"][0] == "- [r0] (no title)" and got["p"][1] == "- [r1] T1, 2000" and got["p"][-1] == "- ... and 10 more" and got["q"] == ["- [a] T"]
    long = spark.createDataFrame([("x" * 120_000 + "m" * 50_000 + "y" * 60_000,), ("short",)], "t string")
    a, b = [r[0] for r in long.select(judging.head_and_tail(F.col("t"))).collect()]
    assert a.startswith("x" * 120_000 + "\n") and a.endswith("\n" + "y" * 60_000) and "m" not in a.replace("middle", "") and b == "short"


def test_probes(spark):
    def send(method, url, timeout):
        if url == "http://slow":
            raise TimeoutError("slow")
        if "api" in url:
            return 200, "", b"{}" if "good" in url else b"<html>"
        if url.endswith(".pdf"):
            return 200, "application/pdf", b"%PDF-x"
        return {"HEAD": (405 if url == "http://get" else 200), "GET": 404}[method], "text/html", b"page"

    links = spark.createDataFrame([("http://a",), ("http://get",), ("http://slow",), ("http://a",)], "url string")
    assert {(r.url, r.head_status, r.get_status, r.error) for r in probing.probe_links(links, send).collect()} == {("http://a", 200, None, None), ("http://get", 405, 404, None), ("http://slow", None, None, "TimeoutError: slow")}
    a = spark.createDataFrame([("hf_model", "good/m"), ("github_repo", "bad/r")], "artifact_kind string, identifier string")
    assert {(r.identifier, r.status_code, r.parseable) for r in probing.probe_artifacts(a, send).collect()} == {("good/m", 200, True), ("bad/r", 200, False)}
    places = spark.createDataFrame([("p", "r", ["http://slow", "http://page", "http://x.pdf", "http://never"]), ("p", "s", [])], "paper_id string, ref_id string, urls array<string>")
    fetched = probing.fetch_pdfs(places, send)
    assert sorted((r.pos, r.status) for r in fetched.collect()) == [(1, 404), (2, 200)]
    assert [(r.ref_id, bytes(r.body)) for r in verification.first_full_text(fetched).collect()] == [("r", b"%PDF-x")]


def test_notes_of_both_api_versions(spark):
    notes = [("p", "a", 0, '{"rating": {"value": "8: good"}}'), ("p", "a", 1, '{"recommendation": "Accept"}'), ("p", "b", 0, '{"decision": {"value": "Reject"}, "rating": "3"}')]
    rows = probing.replies(spark.createDataFrame(notes, "paper_id string, ref_id string, reply_ord int, content string"))
    got = {r.ref_id: (r.decision, r.rating_avg, r.rating_count) for r in verification.venue_decisions(rows).collect()}
    assert got == {"a": ("Accept", 8.0, 1), "b": ("Reject", 3.0, 1)}


def test_env_files(tmp_path):
    for name, text in (("one", "# c\nA=1\nexport B='two'\nC=\"x\"\n"), ("two", "A=9\nD=4\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / ".env").write_text(text)
    environ = {"C": "set"}
    got = probing.load_env([str(tmp_path / "one"), str(tmp_path / "two"), str(tmp_path / "none")], ["A", "B", "C", "D"], environ)
    assert got == {"A": "1", "B": "two", "C": "set", "D": "4"}


def small_pdf(*contents, kids=None):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (3 + 2 * k) for k in range(len(contents))) + b"] >>"]
    for k, c in enumerate(contents):
        packed = zlib.compress(c) if c is not None else b"broken"
        objects += [b"<< /Type /Page /Contents %d 0 R >>" % (4 + 2 * k), b"<< /Filter /FlateDecode /Length %d >>\nstream\n" % len(packed) + packed + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % (i + 1) + o + b"\nendobj\n" for i, o in enumerate(objects))


def test_pdf_pages(spark):
    raw = small_pdf(b"BT /F1 12 Tf (Hello) Tj 0 -14 Td [(Wor) -20 (ld) -300 (again \\(1\\))] TJ ET", None, b"BT (caf\\351) Tj T* <41 42> Tj ET")
    assert pdf.page_texts(raw) == ["Hello\nWorld again (1)", "", "café\nAB"]
    assert pdf.page_texts(b"no pdf") == []
    df = spark.createDataFrame([(bytearray(raw),), (None,)], "b binary")
    assert [r[0] for r in df.select(pdf.pages_of(F.col("b"))).collect()] == [["Hello\nWorld again (1)", "", "café\nAB"], None]
    assert [r[0] for r in df.select(pdf.full_text(F.col("b"))).collect()][0].startswith("Hello")


def test_linked_titles_pair_classes_not_copies(spark):
    from vellum.operators import resolution

    rows = [(1, "a b c d e f g h i j"), (2, "j i h g f e d c b a"), (3, "a b c d e f g h i x"), (4, "q r s"), (5, "Q, R & S!"), (6, ""), (7, None)]
    df = spark.createDataFrame(rows, "id long, title string")
    assert sorted(map(tuple, resolution.linked_titles(df).collect())) == [(1, 3)]
    assert sorted(map(tuple, resolution.title_classes(df).collect())) == [(1, 1), (1, 2), (3, 3), (4, 4), (4, 5)]
    assert M.TITLE_JACCARD == 0.7
