import random

from pyspark.sql import functions as F

from vellum.plans import cli
from vellum.plans import fixtures as X
from vellum.sources import connectors as C


def line(answers, **how):
    """A line over canned answers, with a clock of its own."""
    now, slept, left = [0.0], [], list(answers)

    def fetch(url):
        a = left.pop(0)
        if a is None:
            raise OSError
        return a if isinstance(a, tuple) else (a, {}, "{}")

    def sleep(s):
        slept.append(s)
        now[0] += s

    return C.Line("crossref", fetch, C.Policy(**how), 1.0, lambda: now[0], sleep, random.Random(1)), slept


def test_retries_and_answers():
    x, slept = line([200, 404, 503, 200, None, None, None, (429, {"Retry-After": "7"}, ""), 200])
    assert x.ask("u")[:3] == ("ok", 200, 1) and x.ask("u")[:3] == ("terminal", 404, 1)
    assert x.ask("u")[:3] == ("ok", 200, 2) and x.recovered == 1
    assert x.ask("u")[:3] == ("transient", None, 3) and x.streak == 1 and x.spent == 3
    assert x.ask("u")[:3] == ("ok", 200, 2) and slept[-1] == 7 and x.streak == 0
    assert max(slept) <= 8


def test_breaker_opens_at_a_failure():
    x, _ = line([503] * 30, attempts=1)
    assert [x.ask("u")[2] for _ in range(7)] == [1, 1, 1, 1, 1, 0, 0]
    x, _ = line([503, 503, 503] * 4)
    assert [x.ask("u")[2] for _ in range(5)] == [3, 3, 3, 3, 0]  # eight retries
    x, _ = line([200] * 3)
    assert [x.ask("u", lambda b: False)[0] for _ in range(2)] == ["transient"] * 2 and x.streak == 1


def test_retry_after():
    assert C.retry_after("5", 0) == 5 and C.retry_after("900", 0) == 60 and C.retry_after("-3", 0) == 0 and C.retry_after("soon", 0) is None and C.retry_after(None, 0) is None
    assert C.retry_after("Thu, 01 Jan 1970 00:00:30 GMT", 10) == 20


def test_requests_and_answers_as_rows(spark):
    asked = C.requests(X.REFS.df(spark))
    rows = {(r.source, r.mode, r.lookup_key): r.url for r in asked.collect()}
    assert rows["crossref", "id", "10.1234/ab"].endswith("10.1234%2Fab") and "per-page=5" in rows["openalex", "search", "Sparse Widgets"] and rows["arxiv", "id", "2001.00001"].endswith("id_list=2001.00001")
    assert "query.author=Ann+Roe" in rows["crossref", "search", "Sparse Widgets"] and len([k for k in rows if k[2] == "Sparse Widgets"]) == 5

    def fetch(url):
        return (404, {}, "") if "openalex" in url else (200, {}, "<a/>" if "arxiv.org/api" in url else "{}")

    got = C.ask_all(asked, fetch, intervals={}).groupBy("source", "tag").agg(F.count("*").alias("n")).collect()
    assert {(r.source, r.tag) for r in got} == {("crossref", "ok"), ("semanticscholar", "ok"), ("arxiv", "ok"), ("openalex", "terminal"), ("dblp", "ok")}


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.tex").write_text("\\title{T} \\author{Ann Roe} \\begin{document} Hello \\cite{x}. \\end{document}")
    (tmp_path / "in" / "refs.bib").write_text("@misc{x, title={Not Asked About}}")
    out = str(tmp_path / "out")
    assert cli.main([str(tmp_path / "in"), "--out", out, "--gate", "--no-numeric"], spark) == 4
    assert cli.main([str(tmp_path / "in"), "--out", out, "--no-anonymize", "--no-numeric"], spark) == 3
    assert spark.read.parquet(out).count() == 2
    assert cli.main([str(tmp_path / "nothing"), "--out", out], spark) == 1
