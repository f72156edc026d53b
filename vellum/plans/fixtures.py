"""Rows that a query and its SQL share: the same literals make a DataFrame here and a VALUES list there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    return repr(x)


@dataclass(frozen=True)
class Rows:
    name: str
    schema: str
    rows: tuple

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([*self.rows], self.schema)

    def cte(self) -> str:
        fields = [x.strip().split(" ", 1) for x in self.schema.split(",")]
        cols = ", ".join(f"CAST({n} AS {SQL_TYPES[t.strip()]}) AS {n}" for n, t in fields)
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        return f"{self.name} AS (SELECT {cols} FROM (VALUES {values}) AS v({', '.join(n for n, _ in fields)}))"


REFS = Rows("refs", "paper_id string, ref_id string, title string, authors array<string>, year int, venue string, doi string, arxiv_id string, url string, raw_text string, ordinal int", (
    ("p1", "a", "Sparse Widgets", ["Ann Roe"], 2020, "J. Tests", "https://doi.org/10.1234/AB.", None, None, "", 0),
    ("p1", "b", "Dense Widgets", ["Poe, Ben", "Cy Low"], 2019, "arXiv preprint", None, None, "https://arxiv.org/abs/2001.00001v2", "", 1),
    ("p1", "c", "Odd Gadgets", [], None, None, None, None, None, "arXiv:1901.12345", 2),
    ("p1", "unused", "Never Cited", ["Di Moe"], 2001, "CoRR", "10.48550/arXiv.2101.00009", None, None, "", 3),
    ("p2", "a", "Sparse Widgets", ["Ann Roe"], 2020, None, None, "2001.00001", None, "", 0),
    ("p2", "d", "Rare Sprockets", ["Ed Fox"], 2010, "Proc. X", None, None, "github.com/x/y).", "", 1),
    ("p3", "e", "", ["Flo Gee"], 2015, None, None, None, "mailto:a@b.c", "", 0),
))
CITATIONS = Rows("cites", "paper_id string, cite_ord int, ref_id string, sentence string", (
    ("p1", 0, "a", "Widgets are sparse."), ("p1", 1, "b", "Some are dense."), ("p1", 2, "a", "Again sparse."), ("p1", 3, "ghost", "Nobody wrote this."), ("p1", 4, "c", "Odd."),
    ("p2", 0, "a", "Sparse."), ("p2", 1, "d", "Rare."), ("p2", 2, "zed", "Unknown."), ("p2", 3, "zed", "Unknown again."), ("p3", 0, "e", "Fine."),
))
CANDIDATES = Rows("cands", "paper_id string, ref_id string, mode string, source string, item_rank int, title string, authors array<string>, year int, venue string, doi string", (
    ("p1", "a", "search", "crossref", 0, "Sparse Widgets", ["Ann Roe"], 2025, "Reprints", "10.9/z"),
    ("p1", "a", "search", "openalex", 0, "Sparse widgets!", ["A. Roe"], 2021, "J. Tests", "10.1234/ab"),
    ("p1", "b", "id", "arxiv", 0, "Anything At All", ["No One"], 1990, "arXiv", None),
    ("p1", "c", "search", "crossref", 0, "Odd Gadgets", ["Xi Yu"], None, None, None),
    ("p1", "unused", "search", "crossref", 0, "Never Cited", ["Di Moe"], 2011, "Late", None),
    ("p1", "unused", "search", "semanticscholar", 0, "Never Cited", ["Di Moe"], 2006, "Less Late", None),
    ("p2", "a", "search", "crossref", 0, "Sparse Widgets", ["Ann Roe"], 2029, None, None),
    ("p2", "d", "search", "crossref", 0, "Rare Sprockets", ["Other One"], 2020, "Elsewhere", "10.5/q"),
    ("p2", "d", "search", "openalex", 0, "Common Sprockets Entirely", ["Ed Fox"], 2010, None, None),
))
RESPONSES = Rows("resps", "paper_id string, ref_id string, mode string, source string, tag string", (
    ("p1", "a", "search", "crossref", "ok"), ("p1", "a", "search", "semanticscholar", "transient"), ("p1", "a", "search", "openalex", "ok"),
    ("p1", "b", "id", "arxiv", "ok"), ("p1", "c", "search", "crossref", "ok"), ("p1", "unused", "search", "crossref", "ok"), ("p1", "unused", "search", "semanticscholar", "ok"),
    ("p2", "a", "search", "crossref", "ok"), ("p2", "a", "search", "arxiv", "transient"), ("p2", "d", "search", "crossref", "ok"), ("p2", "d", "search", "openalex", "terminal"), ("p3", "e", "id", "crossref", "terminal"),
))
VERDICTS = Rows("verdicts", "paper_id string, cite_ord int, ref_id string, status string, verdict string, role string, abstract_only boolean, sentence string, rationale string", (
    ("p1", 0, "a", "resolved", "supports", "claim_support", True, "s0", "r0"), ("p1", 1, "a", "resolved", "does_not_support", "claim_support", False, "s1", "r1"),
    ("p1", 2, "b", "resolved", "supports", "method_attribution", True, "s2", "r2"), ("p1", 3, "c", "resolved", "abstract_too_thin", None, True, "s3", "r3"),
    ("p1", 4, "d", "unresolved", "target_unavailable", None, True, "s4", "r4"), ("p1", 5, "e", "resolved", "partially_supports", "background", False, "s5", "r5"),
    ("p2", 0, "a", "degraded", "verification_unavailable", None, True, "s6", "r6"), ("p2", 1, "b", "resolved", "verification_unavailable", None, False, "s7", "r7"),
    ("p2", 2, "c", "resolved", "metadata_mismatch", None, True, "s8", "r8"), ("p2", 3, "c", "resolved", "supports", None, False, "s9", "r9"),
    ("p3", 0, "x", "resolved", "supports", "claim_support", False, "s10", "r10"),
))
ITEMS = Rows("items", "paper_id string, item_ord int, section string, question string, options array<string>, response string, is_gate boolean, gate_question string", (
    ("p1", 0, "G", "Does this paper include code?", ["yes", "no"], "no", True, None), ("p1", 1, "G", "All source code is publicly available", ["yes", "no", "na"], "yes", False, "Does this paper include code?"),
    ("p1", 2, "G", "Runs are stated", ["yes", "no", "na"], "N/A", False, "Does this paper include code?"), ("p1", 3, "H", "Plain item", ["yes", "no"], "Type your response here", False, None),
    ("p1", 4, "H", "Other item", ["yes", "no"], "Perhaps.", False, None), ("p2", 0, None, "Does this paper rely on data?", ["yes", "no"], "Yes, see Sec. 3", True, None),
    ("p2", 1, None, "Data are described", ["yes", "no"], "", False, "Does this paper rely on data?"), ("p2", 2, None, "Data are shared", ["yes", "no"], " ", False, "Does this paper rely on data?"),
    ("p2", 3, None, "No options", [], "whatever", False, None),
))
PAPERS = Rows("papers", "paper_id string, venue_id string, title string, abstract string, baseline_abstract string, page_count int, references_start_page int, author_block string, acknowledgments string", (
    ("p1", "v", "Lorem ipsum", "Too short.", "Too short.", 12, 9, "Ann Roe", "We thank Bob."), ("p2", "v", "A Real Title", "We gain 5.0 points on every task that we tried in this long abstract of more than ten words.", "We gain 4.0 points on every task that we tried in this long abstract of more than ten words.", 12, None, "Anonymous Authors", None),
    ("p3", "v", " ", None, "x", 7, 7, None, "Withheld for review"), ("p4", None, "t", "same words here", "entirely other words stood", 50, 40, "", ""),
))
VENUES = Rows("venues", "venue_id string, page_limit_technical int, requires_abstract boolean, min_abstract_words int, placeholder_markers array<string>", (("v", 7, True, 10, ["lorem", "todo"]),))
URLS = Rows("urls", "n int, url string", (
    (0, "https://github.com/a/b.git"), (1, " notgithub.com/x. "), (2, "https://x.github.io/y"), (3, "http://uni.edu/~roe/"), (4, "mailto:a@b.c"), (5, "localhost/x"), (6, "https://huggingface.co/datasets/o/d/tree"), (7, "https://huggingface.co/bert"),
    (8, "https://github.com/features/x"), (9, "https://example.com/?to=github.com/a/b"), (10, "HTTPS://WWW.GitHub.com/A/B?x#y"), (11, ""), (12, None), (13, "https://arxiv.org/pdf/1"), (14, "data:text"), (15, "https://huggingface.co/spaces/x"),
))
PROBES = Rows("probes", "url string, head_status int, get_status int, error string", (("a", 200, None, None), ("b", 404, None, None), ("c", 405, 200, None), ("d", 403, 404, None), ("e", 500, None, None), ("f", None, None, "timeout"), ("g", 301, None, None), ("h", 501, 399, None)))
ARTIFACT_PROBES = Rows("aprobes", "artifact_kind string, status_code int, parseable boolean", (("hf_model", 401, True), ("hf_model", 200, True), ("hf_dataset", 404, True), ("github_repo", 404, True), ("github_repo", 403, True), ("github_repo", 200, False), ("hf_dataset", 500, True)))
REPLIES = Rows("replies", "paper_id string, ref_id string, reply_ord int, decision string, rating string", (("p1", "a", 0, None, "8: good"), ("p1", "a", 1, "Accept", None), ("p1", "a", 2, "Reject", "5"), ("p1", "b", 0, "", "none"), ("p2", "a", 0, None, "3.5 x"), ("p2", "c", 1, "Reject", None)))
REVIEW = Rows("review", "paper_id string, n int, dimension string, severity string, issue string, evidence string, suggested_fix string", (("p1", 0, "Novelty", " Major ", "Old idea", "Widgets  ARE sparse", ""), ("p1", 1, "clarity", "none", "x", "", ""), ("p1", 2, "clarity", "minor", "", "", ""), ("p1", 3, "soundness", "critical", "Wrong", "widgets are sparse", None), ("p2", 0, "soundness", "minor", "Small", None, None)))
POINTS = Rows("points", "paper_id string, severity string, detail string, evidence string", (("p1", "blocker", "too long", None), ("p1", "warning", "maybe", "Widgets are sparse"), ("p2", "blocker", "", "")))
