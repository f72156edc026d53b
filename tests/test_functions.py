import re
from math import isclose

import pytest
from pyspark.sql import functions as F

from vellum.functions import match as M
from vellum.functions import text as T
from vellum.operators import checklist, grammar, numbers, resolution, submission


def values(spark, column, inputs, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in inputs], schema).select(column).collect()]


def boundary_sentence(text, start, end):
    """The sentence around a span, told plainly."""
    first = max(0, start - 600)
    window = text[first : end + 600]
    at = start - first
    left, right = 0, len(window)
    for m in re.finditer(r"(?<=[.!?])\s+(?=[A-Z\[\(])|\n\s*\n", window):
        if m.end() <= at:
            left = m.end()
        elif m.start() >= at:
            right = m.start()
            break
    return " ".join(window[left:right].split())


def test_spans_and_sentences(spark):
    texts = ["We [1] and [22].", "none", "[3]", "é𝒳 [4] x. Next [5]!\n\nHead [6] (tail). [7]", "x " * 700 + "Hit [8] here. Then" + " y" * 700, "One. Two? [9]. three"]
    got = values(spark, T.spans(F.col("x"), r"\[\d+\]"), texts)
    for t, spans in zip(texts, got):
        assert [(s.start, s.end, s.match) for s in spans] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\[\d+\]", t)]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", F.explode(T.spans(F.col("x"), r"\[\d+\]")).alias("s"))
    for r in df.select("x", "s", T.sentence_around(F.col("x"), F.col("s.start"), F.col("s.end")).alias("said")).collect():
        assert r.said == boundary_sentence(r.x, r.s.start, r.s.end)


def test_tex_to_text(spark):
    tex = r"""pre % gone
\begin{document} A\% \textbf{b \emph{c}} \citep[see][p.~1]{k1, k2} $x^2$ \begin{figure} no \end{figure} \section{Head} d~e \foo{kept} \bar \label{q} \[ m \] end. % x
\end{document} post"""
    assert values(spark, T.tex_body(F.col("x")), [tex, "", "plain"]) == ["A\\% b c [CITE:k1,k2] \n\nHead\n d e kept end.", "", "plain"]
    assert values(spark, T.tex_title(F.col("x")), [r"\title{A {B {no}}}", r"\title{A \textbf{B} {C}}", "x"]) == [None, "A B C", None]
    assert values(spark, T.tex_sections(F.col("x")), [r"\section{A} \section*{B {c}} \subsection{n} % \section{Z}"]) == [["A", "B c"]]
    assert values(spark, T.tex_acknowledgments(F.col("x")), [r"\begin{acks}To \thanks{B}\end{acks}", r"\section*{Acknowledgements} Us. \section{N}", r"\section*{Acknowledgment} end", "none"]) == ["To B", "Us.", "end", None]
    assert values(spark, T.clean_bib_value(F.col("x")), [r"{\"o} \'{e}t \ss{} {\bf x}~y"]) == ["o et ss x y"]


def test_pages(spark):
    p = [["Title of it\nA\nAbstract\nshort text\nhere\n1 Introduction", "REFERENCES\n[1]"], ["References", "x", " 7. Bibliography "], [], None]
    df = spark.createDataFrame([(x,) for x in p], "x array<string>")
    got = df.select(T.references_page(F.col("x")), T.page_abstract(T.join_pages(F.col("x"))), T.page_title(T.join_pages(F.col("x"))), T.split_references(T.join_pages(F.col("x")))).collect()
    assert [r[0] for r in got] == [2, 3, None, None] and got[0][1] == "short text here" and got[0][2] == "Title of it"
    assert got[0][3].references == "\n[1]" and got[2][3].body == ""
    assert values(spark, T.expand_numbers(F.col("x")), ["1, 3-5", "7–9,2", "5-3", "1-200", "4-4", "x"]) == [["1", "3", "4", "5"], ["7", "8", "9", "2"], [], [], [], []]


def test_numbers(spark):
    assert values(spark, T.to_number(F.col("x")), ["1,000", "8k", "2.5M", "1e-3", ".5", "x", "", "1.2.3"]) == [1000, 8000, 2.5e6, 0.001, 0.5, None, None, None]
    assert values(spark, T.shorten(F.col("x"), 5), ["a  b", "abcdef", "abc  def", None]) == ["a b", "abcd…", "abc…", ""]
    assert values(spark, grammar.general_format(F.col("x")), [0.001, 1e-7, 100000.0, 1234567.0, 2.50, None], "x double") == ["0.001", "1e-07", "100000", "1.23457e+06", "2.5", None]


def test_identifiers_and_titles(spark):
    assert values(spark, M.normalize_doi(F.col("x")), ["https://doi.org/10.1234/AbC).", "see 10.5555/x y", "none", None]) == ["10.1234/abc", "10.5555/x", None, None]
    assert values(spark, M.normalize_arxiv_id(F.col("x")), ["arXiv:2001.00001v3", "https://arxiv.org/abs/hep-th/9901001", "cs.AI/0701001", "x"]) == ["2001.00001", "hep-th/9901001", "cs.AI/0701001", None]
    pairs = [("On Graphs", "on graphs!"), ("a b c d e f g", "a b c d e f h"), ("a b c d", "a b x y"), ("", "a"), ("--", "a"), (None, "a")]
    assert values(spark, M.title_like(F.col("x"), F.col("y")), pairs, "x string, y string") == [True, True, False, False, False, False]
    assert values(spark, M.year_compatible(F.col("x"), F.col("y")), [(2000, 2002), (2000, 2003), (None, 1)], "x int, y int") == [True, False, True]
    assert values(spark, M.surnames_overlap(F.col("x"), F.col("y")), [(["Roe, Ann"], ["A. Roe"]), (["x"], []), ([""], ["", None]), (["Ann\tRoe "], ["roe"])], "x array<string>, y array<string>") == [True, False, False, True]
    assert values(spark, M.normalize_url(F.col("x")), ["github.com/a).", " http://x.y, ", "mailto:a@b.c", "local/x", "", "ftp://q"]) == ["https://github.com/a", "http://x.y", None, None, None, "ftp://q"]


def test_bibliographies_and_checklists():
    bib = '@Article{k1 , title = {A {B} "c"}, note="x \\" y", year = 2020, } junk @string{s = "x"} @misc{nofields} @misc{,x=1} @book{k1, title={Second}} @book{k2, a = {open'
    got = grammar.entries(bib)
    assert [(k, t) for k, t, _ in got] == [("k1", "book"), ("k2", "book")] and got[0][2] == {"title": "Second"}
    assert grammar.entries('@a{k, title = {A {B} "c"}, note="x \\" y", year = 2020}')[0][2] == {"title": 'A {B} "c"', "note": 'x \\" y', "year": "2020"}
    text = r"\checksubsection{S} \question{Does this paper use {x}?}{(yes/no)} yes \ifyespoints{w} \begin{itemize} \question{in}{(a/b)} r1 \begin{itemize} \question{deep}{} r2 \end{itemize} \end{itemize} \question{out}{(yes/no)} no \begin{itemize} \question{free}{} \end{itemize} \string\question x"
    items = grammar.checklist_items(text, grammar.opens_points)
    assert [(i[1], i[4]) for i in items] == [("Does this paper use {x}?", None), ("in", 0), ("deep", 0), ("out", None), ("free", None)]
    assert [i[3].strip() for i in items] == ["yes", "r1", "r2", "no", ""]


def test_answers(spark):
    said = ["Yes.", "yes, see 3", "N/A", "no x", "Type your response here", " ", "12", "n a b c"]
    assert values(spark, checklist.answer(F.col("x")), said) == ["yes", "yes", "na", "no", None, None, None, "n"]


PLANTED = {"Our recall of 1.31 is high.": "bounded_metric", "An accuracy of 120.5% was seen.": "bounded_metric", "train 600 / val 100 / test 100 of 900 samples in total.": "split_mismatch", "accuracy 101.2 ± 0.3": "mean_std_range"}
BENIGN = [
    "Recall 1.31x better than before.", "train 700 / val 100 / test 100 of 900 samples in total.", "F1 improved by 1.5 points.", "recall computation took 1.5 seconds", "Accuracy is 99.5%.", "a precision of 0.93", "F1 of 0.95 ± 0.08", "The length was 120 ± 5 mm.",
    "120% of the baseline", "We trained on 8000 samples.", "BLEU of 31.2", "map 1.5 times larger", "recall 1.2 points", "train 10 and test 5", "precision of 1.0", "AUC of 2.5 is not between", "top-1 of 80%",
]


def test_numeric_detectors(spark):
    rows = [(s, s, s, None) for s in [*PLANTED, *BENIGN]]
    found = numbers.audit(spark.createDataFrame(rows, "paper_id string, body string, tex_text string, abstract string")).collect()
    kinds = {r.paper_id: r.kind for r in found}
    assert {s: kinds.get(s) for s in PLANTED} == PLANTED
    assert not set(kinds) & set(BENIGN)
    table = r"\begin{tabular}batch size & 32 and +1.0 and +0\end{tabular}"
    two = numbers.audit(spark.createDataFrame([("a", "A batch size of 256.", table, "a gain of 5%"), ("b", "batch size: 64", table, "gains by 1.1 points, +0%"), ("c", "batch size 256", "no table", "by 9%")], "paper_id string, body string, tex_text string, abstract string")).collect()
    assert sorted((r.paper_id, r.kind) for r in two) == [("a", "abstract_table_delta"), ("a", "hyperparam_drift")]
    assert "tables show +0, +1" in next(r.detail for r in two if r.kind == "abstract_table_delta")


DECISIONS = [
    ("strong", [("crossref", "Sparse Widgets", ["Ann Roe"], 2021)], False, "resolved", "crossref", False, 0),
    ("weak", [("crossref", "Sparse Widgets", ["Ann Roe"], 2025)], False, "resolved", "crossref", True, 0),
    ("later strong", [("crossref", "Sparse Widgets", ["Ann Roe"], 2025), ("openalex", "Sparse Widgets", ["Ann Roe"], 2019)], False, "resolved", "openalex", False, 0),
    ("weak but transient", [("crossref", "Sparse Widgets", ["Ann Roe"], 2025)], True, "degraded", None, False, 0),
    ("near miss", [("crossref", "Sparse Widgets", ["Ann Moe"], 2025)], False, "unresolved", None, False, 1),
    ("no year", [("crossref", "Sparse Widgets", ["Ann Moe"], None)], False, "resolved", "crossref", False, 0),
    ("nothing", [], False, "unresolved", None, False, 0),
    ("closest weak", [("crossref", "Sparse Widgets", ["Ann Roe"], 2030), ("openalex", "Sparse Widgets", ["Ann Roe"], 2025)], False, "resolved", "openalex", True, 0),
]


def test_resolution_decisions(spark):
    refs = spark.createDataFrame([(n, "r", "Sparse Widgets", ["Ann Roe"], 2020) for n, *_ in DECISIONS], "paper_id string, ref_id string, title string, authors array<string>, year int")
    cands = [(n, "r", "search", s, 0, t, a, y, None, None) for n, c, *_ in DECISIONS for s, t, a, y in c]
    cands = spark.createDataFrame(cands, "paper_id string, ref_id string, mode string, source string, item_rank int, title string, authors array<string>, year int, venue string, doi string")
    asked = spark.createDataFrame([(n, "r", "search", "arxiv", "transient" if d[2] else "terminal") for n, *_ in DECISIONS for d in [next(x for x in DECISIONS if x[0] == n)]], "paper_id string, ref_id string, mode string, source string, tag string")
    got = {r.paper_id: r for r in resolution.resolve(refs, asked, cands).collect()}
    for name, _, _, status, source, weak, near in DECISIONS:
        r = got[name]
        assert (r.status, r.record and r.record.source, r.match_note is not None, len(r.near_misses)) == (status, source, weak, near), name


def test_published_version_waterfall(spark):
    v = "struct<venue:string,year:int,doi:string,url:string,source:string>"
    one = lambda s: ("V", 2020, None, None, s)
    rows = [
        ("checked", True, True, one("r"), "ok", None, "ok", None, "ok", None), ("not arxiv", False, False, one("r"), "ok", None, "ok", None, "ok", None), ("record", False, True, one("r"), "transient", None, "ok", None, "ok", None),
        ("s2", False, True, None, "ok", one("s2"), "ok", one("d"), "ok", None), ("dblp", False, True, None, "ok", None, "ok", one("d"), "ok", one("c")), ("definitive none", False, True, None, "ok", None, "terminal", None, "ok", one("c")),
        ("crossref", False, True, None, "skip", None, "terminal", None, "ok", one("c")), ("unknown", False, True, None, "transient", None, "terminal", None, "terminal", None), ("silent", False, True, None, "skip", None, "terminal", None, "terminal", None),
    ]
    df = spark.createDataFrame(rows, f"n string, checked boolean, cites_arxiv boolean, by_record {v}, s2_tag string, s2 {v}, dblp_tag string, dblp {v}, crossref_tag string, crossref {v}")
    got = {r.n: (r.published_version and r.published_version.source, r.published_version_checked, r.unchecked_now) for r in resolution.published_version(df).collect()}
    assert got == {"checked": (None, True, False), "not arxiv": (None, False, False), "record": ("r", True, False), "s2": ("s2", True, False), "dblp": ("d", True, False), "definitive none": (None, True, False), "crossref": ("c", True, False), "unknown": (None, False, True), "silent": (None, False, False)}


def test_title_linkage_against_brute_force(spark):
    import random

    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    titles = [" ".join(r.choices(words[: r.choice([8, 20, 60])], k=r.randint(1, 9))) for _ in range(150)] + ["", "--", None]
    df = spark.createDataFrame([*enumerate(titles)], "id long, title string")
    sets = {i: set(re.sub("[^a-z0-9 ]+", " ", t.lower()).split()) for i, t in enumerate(titles) if t}
    want = {(a, b) for a in sets for b in sets if sets[a] and sets[b] and (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7 or isclose(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 0.7))}
    assert {(x.l_id, x.r_id) for x in resolution.fuzzy_pairs(df, df).collect()} == want


def test_changed_abstracts(spark):
    pairs = [("a b c d e", "a b c d e"), ("a b c d e", "a b c x y"), ("gain of 5%", "gain of 6%"), ("", ""), ("ä ö", "Ä Ö")]
    assert values(spark, submission.changed(F.col("x"), F.col("y")), pairs, "x string, y string") == [False, True, True, False, False]
