"""Asking the scholarly sources: requests as rows, answers as rows.

A source's limits hold per run, so its requests form one ordered task with a gate, a retry budget
and a circuit breaker of its own; sources run beside each other. Asking is idempotent, so a task
that runs again asks again; what was answered goes to a table before anything is decided.
"""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import match as M
from vellum.functions import text as T

# Seconds between a source's requests, statuses that may pass, limits of retries and of the breaker.
INTERVALS = {"crossref": 1.0, "semanticscholar": 1.1, "arxiv": 3.0, "openalex": 0.2, "dblp": 1.0, "unpaywall": 1.0}
RETRYABLE = {429, 500, 502, 503, 504}
MISS_AS_TRANSIENT = {("openalex", 409)}
S2_FIELDS = "title,authors,year,abstract,externalIds,openAccessPdf,venue,publicationVenue"

#: url -> (status, headers, body); raises OSError where there is no answer.
Fetch = Callable[[str], tuple[int, dict, str]]


@dataclass(frozen=True)
class Policy:
    attempts: int = 3
    base: float = 0.75
    cap: float = 8.0
    retry_after_cap: float = 60.0
    consecutive: int = 5
    retries: int = 8


def retry_after(value: str | None, now: float, cap: float = 60.0) -> float | None:
    """Seconds that a Retry-After header asks for, as a number or a date; at least 0, at most cap."""
    if not value:
        return None
    try:
        seconds = float(value)
    except ValueError:
        try:
            seconds = parsedate_to_datetime(value).timestamp() - now
        except (TypeError, ValueError):
            return None
    return min(max(seconds, 0.0), cap)


@dataclass
class Line:
    """One source's gate, retry budget and breaker."""

    source: str
    fetch: Fetch
    policy: Policy = Policy()
    interval: float = 0.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    pick: random.Random = field(default_factory=random.Random)
    last: float = float("-inf")
    streak: int = 0
    spent: int = 0
    open: bool = False
    recovered: int = 0

    def _wait(self) -> None:
        left = self.last + self.interval - self.clock()
        if left > 0:
            self.sleep(left)
        self.last = self.clock()

    def _failed(self, retries: int) -> None:
        self.streak, self.spent = self.streak + 1, self.spent + retries
        self.open |= self.streak >= self.policy.consecutive or self.spent >= self.policy.retries

    def ask(self, url: str, fits: Callable[[str], bool] = lambda body: True) -> tuple[str, int | None, int, str | None]:
        """(tag, status, attempts, body): ok, terminal for an answer that is no record, transient for no answer to rely on."""
        if self.open:
            return "transient", None, 0, None
        self._wait()
        for attempt in range(1, self.policy.attempts + 1):
            hint = None
            try:
                status, headers, body = self.fetch(url)
                if status not in RETRYABLE:
                    break
                hint = retry_after({k.lower(): v for k, v in headers.items()}.get("retry-after"), time.time(), self.policy.retry_after_cap)
            except OSError:
                status = None
            if attempt < self.policy.attempts:
                self.sleep(hint if hint is not None else self.pick.uniform(0, min(self.policy.cap, self.policy.base * 2 ** (attempt - 1))))
        else:
            self._failed(self.policy.attempts - 1)
            return "transient", status, self.policy.attempts, None
        self.streak = 0
        if attempt > 1:
            self.recovered, self.spent = self.recovered + 1, self.spent + attempt - 1
        if (self.source, status) in MISS_AS_TRANSIENT:
            return "transient", status, attempt, None
        if status != 200:
            return "terminal", status, attempt, None
        if not fits(body):
            self._failed(0)
            return "transient", status, attempt, None
        return "ok", status, attempt, body


def http(url: str, timeout: float = 30.0) -> tuple[int, dict, str]:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return r.status, dict(r.headers), r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read().decode("utf-8", "replace")


def _url(base: str, **params: Column) -> Column:
    """Parameters that are null are left out."""
    pairs = F.array_compact(F.array(*[F.concat(F.lit(k.replace("_", ".") + "="), F.url_encode(v)) for k, v in params.items()]))
    return F.concat(F.lit(base + "?"), F.array_join(pairs, "&"))


def crossref_search(title: Column, first_author: Column) -> Column:
    return F.replace(_url("https://api.crossref.org/works", query_bibliographic=title, query_author=first_author, rows=F.lit("5")), F.lit("per.page="), F.lit("per-page="))


def requests(refs: DataFrame) -> DataFrame:
    """source, mode, lookup_key, url: each look-up that some entry needs, once, in the order of modes."""
    return lookups(refs).select("source", "mode", "lookup_key", "url").distinct()


def lookups(refs: DataFrame) -> DataFrame:
    """The look-ups of each entry: its paper_id and ref_id, if there, source, mode, lookup_key, url."""
    doi = M.normalize_doi(F.col("doi"))
    arxiv = M.arxiv_id_of(F.col("arxiv_id"), F.col("doi"), F.col("url"), F.col("raw_text"))
    title, first = T.blank_to_null(F.col("title")), F.get("authors", F.lit(0))
    name = M.surname(first)
    s2 = "https://api.semanticscholar.org/graph/v1/paper/"
    asked = [
        ("crossref", "id", doi, F.concat(F.lit("https://api.crossref.org/works/"), F.url_encode(doi))),
        ("semanticscholar", "id", doi, F.concat(F.lit(s2 + "DOI:"), doi, F.lit(f"?fields={S2_FIELDS}"))),
        ("semanticscholar", "id", arxiv, F.concat(F.lit(s2 + "ARXIV:"), arxiv, F.lit(f"?fields={S2_FIELDS}"))),
        ("arxiv", "id", arxiv, _url("http://export.arxiv.org/api/query", id_list=arxiv).try_cast("string")),
        ("openalex", "id", doi, F.concat(F.lit("https://api.openalex.org/works/doi:"), doi)),
        ("crossref", "search", title, _url("https://api.crossref.org/works", query_bibliographic=title, query_author=first, rows=F.lit("5"))),
        ("semanticscholar", "search", title, _url(s2 + "search", query=title, limit=F.lit("5"), fields=F.lit(S2_FIELDS))),
        ("arxiv", "search", title, F.concat(F.lit("http://export.arxiv.org/api/query?search_query="), F.concat_ws("+AND+", F.concat(F.lit("ti:%22"), F.url_encode(title), F.lit("%22")), F.concat(F.lit("au:"), F.url_encode(name))), F.lit("&max_results=5"))),
        ("openalex", "search", title, _url("https://api.openalex.org/works", search=title, per_page=F.lit("5"))),
        ("dblp", "search", title, _url("https://dblp.org/search/publ/api", q=F.concat_ws(" ", title, name), format=F.lit("json"), h=F.lit("10"))),
    ]
    each = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(m).alias("mode"), k.alias("lookup_key"), u.alias("url")) for s, m, k, u in asked])
    own = [c for c in ("paper_id", "ref_id") if c in refs.columns]
    rows = refs.select(*own, F.explode(each).alias("x")).select(*own, "x.*").where("lookup_key IS NOT NULL AND url IS NOT NULL")
    fix = F.replace(F.replace(F.col("url"), F.lit("id.list="), F.lit("id_list=")), F.lit("per.page="), F.lit("per-page="))
    return rows.withColumn("url", fix).distinct()


def lanes(spark: SparkSession, n: int) -> list[int]:
    """n numbers that hash partitioning deals to n different partitions."""
    rows = spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("id")).collect()  # n rows
    found = sorted((r.part, r.id) for r in rows)
    assert len(found) == n
    return [i for _, i in found]


def ask_all(asked: DataFrame, fetch: Fetch = http, policy: Policy | None = None, intervals: dict[str, float] | None = None) -> DataFrame:
    """requests -> with tag, status, attempts, payload. One ordered task per source."""
    policy, intervals = policy or Policy(), INTERVALS if intervals is None else intervals

    def fits(source: str) -> Callable[[str], bool]:
        import json
        import xml.etree.ElementTree as ET

        def parses(body: str) -> bool:
            try:
                ET.fromstring(body) if source == "arxiv" else json.loads(body)
            except (ValueError, ET.ParseError):
                return False
            return True

        return parses

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines: dict[str, Line] = {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                line = lines.setdefault(r.source, Line(r.source, fetch, policy, intervals.get(r.source, 0.0)))
                out.append((*r, *line.ask(r.url, fits(r.source))))
            yield pd.DataFrame(out, columns=[*pdf.columns, "tag", "status", "attempts", "payload"]).astype({"status": "Int32", "attempts": "int32"})

    names = sorted(r.source for r in asked.select("source").distinct().collect())  # the sources, some six of them
    lane = F.create_map(*[F.lit(x) for pair in zip(names, lanes(asked.sparkSession, max(1, len(names)))) for x in pair]) if names else F.create_map(F.lit(""), F.lit(0))
    ordered = asked.select("source", "mode", "lookup_key", "url", F.try_element_at(lane, F.col("source")).cast("long").alias("lane"))
    # a fixed number of partitions, which no later plan joins: sources run beside each other
    ordered = ordered.repartition(max(1, len(names)), "lane").sortWithinPartitions("source", "mode", "lookup_key").drop("lane")
    return ordered.mapInPandas(run, "source string, mode string, lookup_key string, url string, tag string, status int, attempts int, payload string")
