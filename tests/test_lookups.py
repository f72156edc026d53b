import json

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import lookups
from vellum.sources import connectors

REF = "paper_id string, ref_id string, raw_text string, authors array<string>, title string, year int, venue string, doi string, arxiv_id string, url string, ordinal int, is_synthetic boolean"
ANSWER = "source string, mode string, lookup_key string, tag string, payload string"


def entry(paper, ref, title=None, authors=("Ann Roe",), year=2020, venue=None, doi=None, arxiv=None, n=0):
    return (paper, ref, "", list(authors), title, year, venue, doi, arxiv, None, n, False)


def crossref(title, year, family="Roe", doi="10.1/x", venue="J. Tests", kind="journal-article"):
    return {"DOI": doi, "title": [title], "author": [{"given": "Ann", "family": family}], "issued": {"date-parts": [[year]]}, "container-title": [venue] if venue else [], "type": kind}


def answers():
    found = lambda *items: json.dumps({"message": {"items": list(items)}})
    none = {"crossref": found(), "semanticscholar": '{"data": []}', "openalex": '{"results": []}', "arxiv": "<feed></feed>"}
    rows = [("crossref", "id", "10.1000/a", "ok", json.dumps({"message": crossref("By Its Doi", 1999)}))]
    for title in ("Sparse Widgets", "Weak One", "Ghost Paper", "Near Miss", "Half Down"):
        rows += [(s, "search", title, "ok", none[s]) for s in ("semanticscholar", "arxiv", "openalex") if (title, s) != ("Half Down", "openalex")]
    rows += [
        ("crossref", "search", "Sparse Widgets", "ok", found(crossref("Sparse widgets!", 2025, doi="10.1/late"), crossref("Sparse Widgets", 2021, doi="10.1/S"))),
        ("crossref", "search", "Weak One", "ok", found(crossref("Weak One", 2010, doi="10.1/w"), crossref("Weak One", 2012, doi="10.1/v"))),
        ("crossref", "search", "Ghost Paper", "ok", found(crossref("Something Else Entirely", 2020))),
        ("crossref", "search", "Near Miss", "ok", found(crossref("Near Miss", 1990, family="Other"))),
        ("crossref", "search", "Half Down", "terminal", None),
        ("openalex", "retraction", "10.1/s", "ok", '{"is_retracted": true}'),
        ("openalex", "retraction", "10.1/x", "terminal", None),
        ("arxiv", "id", "2001.00001", "ok", '<feed><entry><id>http://arxiv.org/abs/2001.00001v1</id><title>Preprint Cited</title><published>2020-01-01T00:00:00Z</published><author><name>Ann Roe</name></author></entry></feed>'),
        ("semanticscholar", "id", "2001.00001", "terminal", None),
        ("semanticscholar", "published", "2001.00001", "terminal", None),
        ("dblp", "search", "Preprint Cited roe", "ok", json.dumps({"result": {"hits": {"hit": [{"info": {"title": "Preprint Cited.", "year": "2021", "venue": "CoRR", "type": "Informal and Other Publications", "authors": {"author": {"text": "Ann Roe 0001"}}}}, {"info": {"title": "Preprint Cited", "year": "2021", "venue": "ICT", "type": "Conference and Workshop Papers", "ee": "http://e", "authors": {"author": [{"text": "Ann Roe 0001"}]}}}]}}})),
        ("semanticscholar", "published", "2002.00002", "transient", None),
        ("arxiv", "id", "2002.00002", "ok", '<feed><entry><id>http://arxiv.org/abs/2002.00002v1</id><title>Second Preprint</title><published>2020-01-01T00:00:00Z</published><author><name>Ann Roe</name></author></entry></feed>'),
        ("semanticscholar", "id", "2002.00002", "transient", None),
        ("dblp", "search", "Second Preprint roe", "ok", '{"result": {"hits": {}}}'),
        ("crossref", "search", "Second Preprint", "ok", found(crossref("Second Preprint", 2020, venue=None, doi="10.1/no"), crossref("Second Preprint", 2021, doi="10.1/yes", kind="posted-content"), crossref("Second Preprint", 2021, doi="10.1/yes", venue="ICT"))),
    ]
    return rows


REFS = [
    entry("p", "doi", "Other Title", doi="https://doi.org/10.1000/A"), entry("p", "sparse", "Sparse Widgets", n=1), entry("q", "sparse", "Sparse Widgets"), entry("p", "weak", "Weak One", n=2), entry("p", "ghost", "Ghost Paper", n=3),
    entry("p", "near", "Near Miss", n=4), entry("p", "half", "Half Down", n=5), entry("p", "pre", "Preprint Cited", venue="arXiv", arxiv="2001.00001", n=6), entry("p", "pre2", "Second Preprint", venue="arXiv", arxiv="2002.00002", n=7), entry("q", "blank", None, authors=(), year=None, n=1),
]


@pytest.fixture(scope="module")
def resolved(spark):
    asked = []

    def ask(rows):
        asked.extend((r.source, r.mode, r.lookup_key) for r in rows.collect())
        return lookups.recorded(spark.createDataFrame(answers(), ANSWER))(rows)

    out = lookups.resolve_all(spark.createDataFrame(REFS, REF), ask)
    return {k: v for k, v in out.items()}, asked


def test_from_entries_to_decisions(resolved):
    out, asked = resolved
    got = {(r.paper_id, r.ref_id): r for r in out["resolutions"].collect()}
    assert len(got) == len(REFS) and len(asked) == len(set(asked))
    assert got["p", "doi"].record.title == "By Its Doi"  # by identifier, whatever its title and year
    assert got["p", "sparse"].record.doi == "10.1/s" and got["p", "sparse"].is_retracted and got["q", "sparse"].is_retracted
    weak = got["p", "weak"]
    assert weak.status == "resolved" and weak.record.year == 2012 and "2020" in weak.match_note
    assert got["p", "ghost"].status == "unresolved" and got["p", "ghost"].near_misses == []
    assert got["p", "near"].status == "unresolved" and "Near Miss" in got["p", "near"].near_misses[0]
    assert got["p", "half"].status == "degraded" and got["q", "blank"].status == "unresolved"
    assert ("crossref", "search", "Other Title") not in asked and ("semanticscholar", "search", "Sparse Widgets") not in asked  # what is settled asks no more


def test_published_versions(resolved):
    out, asked = resolved
    got = {r.ref_id: r for r in out["resolutions"].collect()}
    assert got["pre"].published_version.venue == "ICT" and got["pre"].published_version.source == "dblp" and got["pre"].published_version_checked
    assert got["pre2"].published_version.doi == "10.1/yes" and got["pre2"].published_version.source == "crossref"
    assert got["doi"].published_version is None and not got["doi"].unchecked_now
    assert ("crossref", "search", "Preprint Cited") not in asked


def test_only_resolved_records_are_stored_and_found_again(spark, resolved):
    out, _ = resolved
    store = out["new_records"]
    assert store.count() == 5  # the entry of two papers once
    again = []

    def ask(rows):
        again.extend((r.source, r.mode, r.lookup_key) for r in rows.collect())
        return lookups.recorded(spark.createDataFrame(answers(), ANSWER))(rows)

    second = lookups.resolve_all(spark.createDataFrame(REFS, REF), ask, store)
    a = {(r.paper_id, r.ref_id): (r.status, r.record and r.record.title, r.is_retracted, r.published_version) for r in out["resolutions"].collect()}
    b = {(r.paper_id, r.ref_id): (r.status, r.record and r.record.title, r.is_retracted, r.published_version) for r in second["resolutions"].collect()}
    assert a == b and not {k for _, _, k in again} & {"Sparse Widgets", "10.1000/a", "Preprint Cited roe"} and second["new_records"].count() == 0


def test_a_source_that_is_down_degrades(spark):
    ask = lookups.recorded(spark.createDataFrame([], ANSWER))
    out = lookups.resolve_all(spark.createDataFrame(REFS, REF), ask)
    assert {r.ref_id: r.status for r in out["resolutions"].collect()} == {r[1]: "unresolved" if r[1] == "blank" else "degraded" for r in REFS} and out["new_records"].count() == 0
    c = lookups.counters(out["responses"], out["resolutions"]).first()
    assert c.recovered == 0 and c.skipped > 0 and "crossref" in c.broken_sources


def test_live_sources_run_in_lanes_of_their_own(spark):
    rows = spark.createDataFrame([(s, "id", str(k), f"u{k}") for s in ("a", "b", "c", "d", "e", "f") for k in range(3)], "source string, mode string, lookup_key string, url string")
    got = connectors.ask_all(rows, lambda url: (200, {}, "{}"), intervals={}).select("source", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(got) == 6 and len({r.p for r in got}) == 6


def test_full_text_places(spark, resolved):
    refs = spark.createDataFrame(REFS, REF)
    rows = [("openalex", "open_access", "10.1/s", "ok", '{"open_access": {"oa_url": ""}, "primary_location": {"pdf_url": "http://o"}}'), ("unpaywall", "open_access", "10.1/s", "ok", '{"best_oa_location": null, "oa_locations": [{"url_for_pdf": null, "url": "http://u"}]}')]
    ask = lookups.recorded(spark.createDataFrame(rows, ANSWER))
    got = {(r.paper_id, r.ref_id): r for r in lookups.open_access_urls(resolved[0]["resolutions"], refs, ask, "a@b.c").collect()}
    assert got["p", "sparse"].urls == ["http://u", "http://o"] and not got["p", "sparse"].unpaywall_skipped
    assert got["p", "doi"].urls == [] and lookups.open_access_urls(resolved[0]["resolutions"], refs, ask).where("unpaywall_skipped").count() == 4


def test_spans_of_many_matches(spark):
    text = "".join(f"{'x' * (k % 5)}[{k}]" for k in range(1000)) + "tail"
    df = spark.createDataFrame([(text,), ("none",), ("",), (None,)], "t string")
    got = [r.s for r in df.select(T.spans(F.col("t"), r"\[\d+\]").alias("s")).collect()]
    assert [text[m["start"] : m["end"]] for m in got[0]] == [f"[{k}]" for k in range(1000)] == [m["match"] for m in got[0]]
    assert got[1] == got[2] == [] and got[3] is None
