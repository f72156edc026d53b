"""Sample sources: what manuscripts, extracted pages and source answers look like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fixtures as X

TEX = r"""% \author{Hidden Person}
\title{A \textbf{Nice} {Title}} \author{Ann Roe \thanks{Univ. of {X}}}
\begin{document}\begin{abstract}We gain by 5.0 points \cite{k1}.\end{abstract}
\section{Intro} In our previous work we won \citep[see][p.~2]{k1, nokey}. F1 of 1.07 is high. See \ref{missing} and \cref{fig:a}. \label{fig:a}
Train 600 / val 100 / test 100 of 900 samples in total. We use a learning rate of 0.1 here. Code at \url{github.com/roe/x}, \href{https://e.org/a.}{y}.
\begin{table}lr & 0.001 and +1.0 \textcolor{red}{x}\end{table} \thanks{Funder} Currently under review at X.
\section*{Acknowledgements} We thank Bob. \end{document}"""
BIB = '@article{k1, author={Roe, Ann and Poe, Ben}, title={On {G}raphs}, year={2020}, journal={J. Tests}, url={http://x.y}}\n@misc{k2, title="Un{\\"u}sed", note={arXiv:2101.00001}}\n@comment{x} @string{y = "z"}'
CHECKLIST = r"""\checksubsection{General} \question{Does this paper include datasets?}{(yes/no)} yes
\ifyespoints{If yes:} \begin{itemize} \question{All datasets are publicly available}{(yes/partial/no/NA)} Type your response here
\question{Second}{(yes/no)} maybe \end{itemize} \question{The source code is publicly available}{(yes/partial/no)} yes \question{The computing infrastructure}{(yes/no)} Yes."""
PAGES = ["A Study of Widgets\nAbstract\nWe look at wid-\ngets.\n1 Introduction\nAs shown [1, 3-5], it works. (Roe 2020; Poe and Low, 2019) agree.", "Fox et al. (2010) differ. References are below.\nReferences\n[1] x"]


def manuscripts(spark: SparkSession) -> DataFrame:
    plain = r"\begin{document} Nothing here. \end{document}"
    return spark.createDataFrame([("p1", TEX, BIB, CHECKLIST), ("p2", plain, "", ""), ("p3", None, None, None)], "paper_id string, tex_text string, bib_text string, checklist_text string")


def page_manuscripts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("p1", PAGES), ("p2", ["Rare Sprockets by Fox\nFox (2010) said so. Roe (2020) too."]), ("p3", []), ("p4", None)], "paper_id string, pages array<string>")


def numbered_refs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("p1", str(i)) for i in range(1, 5)], "paper_id string, ref_id string")


PAYLOADS = X.Rows("payloads", "n int, source string, payload string", (
    (0, "crossref", '{"DOI":"10.1/AB","title":["On Widgets"],"author":[{"given":"Ann","family":"Roe"},{"family":"Poe"}],"issued":{"date-parts":[[2020,1]]},"container-title":["J. Tests"],"abstract":"<jats:p>Short.</jats:p>","type":"journal-article"}'),
    (1, "semanticscholar", '{"title":"On Widgets","year":2020,"venue":"ICT","externalIds":{"ArXiv":"2001.00001","DBLP":"conf/ict/1"},"authors":[{"name":"Ann Roe"},{"name":""}],"openAccessPdf":{"url":"http://p"},"publicationVenue":{"name":"ICT","type":"conference"}}'),
    (2, "openalex", '{"id":"W1","title":"On Widgets","authorships":[{"author":{"display_name":"Ann Roe"}}],"publication_year":2020,"doi":"https://doi.org/10.1/AB","abstract_inverted_index":{"b":[1],"a":[0,2]},"is_retracted":true}'),
    (3, "arxiv", '<entry><id>http://arxiv.org/abs/2001.00001v1</id><title>On\n Widgets</title><summary>S &amp; T</summary><published>2020-01-01T00:00:00Z</published><author><name>Ann Roe</name></author><link title="pdf" href="http://p"/></entry>'),
    (4, "arxiv", "<entry><id>http://arxiv.org/api/errors#x</id><title>Error</title></entry>"),
    (5, "crossref", '{"title":[],"publisher":"Press"}'),

))


ENTRY = "paper_id string, ref_id string, raw_text string, authors array<string>, title string, year int, venue string, doi string, arxiv_id string, url string, ordinal int, is_synthetic boolean"
ANSWER = "source string, mode string, lookup_key string, tag string, payload string"
GENRES = 12


def _entry(k: int) -> tuple:
    """The k-th sample entry; what its look-ups answer goes by k % GENRES (`recorded_answers`)."""
    kind = k % GENRES
    doi = f"10.1000/e{k}" if kind in (0, 1) else None
    arxiv = f"20{k % 90 + 10}.{k:05d}" if kind in (2, 3) else None
    return (f"p{k // 40}", f"r{k}", "", ["Ann Roe"], None if kind == 11 else f"Study Number {k} Of Widgets", 2015, "arXiv" if arxiv else None, doi, arxiv, None, k % 40, False)


def recorded_refs(spark: SparkSession, n: int = 480) -> DataFrame:
    return spark.createDataFrame([_entry(k) for k in range(n)], ENTRY)


def recorded_answers(spark: SparkSession, n: int = 480) -> DataFrame:
    """By genre: 0 found by DOI, 1 too and retracted, 2 a preprint that DBLP knows as published, 3 one that nobody does, 4 found by title, 5 only with another
    year (weak), 6 with another year and author (near miss), 7 nowhere, 8 and 9 a source is down, 10 found by a later source, 11 nothing to ask by."""
    import json

    def work(title, year, family="Roe", **more):
        return {"title": [title], "author": [{"given": "Ann", "family": family}], "issued": {"date-parts": [[year]]}, "container-title": ["J. Tests"]} | more

    rows = []
    for k in range(n):
        kind, (_, _, _, _, title, _, _, doi, arxiv, *_) = k % GENRES, _entry(k)
        say = lambda source, mode, key, payload, tag="ok": rows.append((source, mode, key, tag, payload))  # noqa: B023, E731
        found = lambda *items: json.dumps({"message": {"items": list(items)}})
        if doi:
            say("crossref", "id", doi, json.dumps({"message": work("Said Otherwise", 1999, DOI=doi.upper())}))
            say("openalex", "retraction", doi, json.dumps({"is_retracted": kind == 1}))
        elif arxiv:
            say("semanticscholar", "id", arxiv, None, "terminal")
            say("arxiv", "id", arxiv, f"<feed><entry><id>http://arxiv.org/abs/{arxiv}v2</id><title>{title}</title><published>2014-01-01T00:00:00Z</published><author><name>Ann Roe</name></author></entry></feed>")
            say("semanticscholar", "published", arxiv, None, "terminal")
            info = {"title": title + ".", "year": "2016", "type": "Journal Articles", "venue": "J. Tests" if kind == 2 else "CoRR", "authors": {"author": {"text": "Ann Roe 0001"}}}
            say("dblp", "search", f"{title} roe", json.dumps({"result": {"hits": {"hit": [{"info": info}]}}}))
        elif title:
            items = {4: [work("Another Thing", 2015, DOI="10.1000/o"), work(title.lower(), 2016, DOI=f"10.1000/T{k}")], 5: [work(title, 2005, DOI="10.1000/f"), work(title, 2010, DOI=f"10.1000/w{k}")], 6: [work(title, 2001, "Poe")]}.get(kind, [])
            say("crossref", "search", title, found(*items))
            say("openalex", "retraction", f"10.1000/t{k}", None, "terminal")
            say("semanticscholar", "search", title, json.dumps({"data": [{"title": title, "year": 2015, "authors": [{"name": "A. Roe"}], "externalIds": {"DOI": f"10.1000/S{k}"}}] if kind == 10 else []}))
            say("arxiv", "search", title, "<feed></feed>")
            if kind != 8:
                say("openalex", "search", title, None if kind == 9 else '{"results": []}', "transient" if kind == 9 else "ok")
    return spark.createDataFrame(rows, ANSWER)


#: What the genres of `recorded_answers` come to.
RESOLVED_SQL = f"""SELECT 'p' || CAST(k // 40 AS VARCHAR) AS paper_id, 'r' || CAST(k AS VARCHAR) AS ref_id,
  CASE WHEN g IN (0, 1, 2, 3, 4, 5, 10) THEN 'resolved' WHEN g IN (8, 9) THEN 'degraded' ELSE 'unresolved' END AS status,
  CASE WHEN g IN (0, 1, 4, 5) THEN 'crossref' WHEN g IN (2, 3) THEN 'arxiv' WHEN g = 10 THEN 'semanticscholar' END AS source,
  CASE g WHEN 0 THEN '10.1000/e' || k WHEN 1 THEN '10.1000/e' || k WHEN 4 THEN '10.1000/t' || k WHEN 5 THEN '10.1000/w' || k WHEN 10 THEN '10.1000/s' || k END AS doi,
  g = 5 AS is_weak, g = 1 AS is_retracted, CASE WHEN g = 2 THEN 'J. Tests' END AS published_in, CAST(CASE WHEN g = 6 THEN 1 ELSE 0 END AS INTEGER) AS n_near
FROM (SELECT k, k % {GENRES} AS g FROM range(480) t(k))"""
