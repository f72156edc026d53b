"""Probes as tasks: links, artifacts, PDF files and venue notes. Each takes the function that does the asking, so tests and recorded runs need no network."""

from __future__ import annotations

import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T

# Probes beside each other, their patience in seconds, and statuses at which HEAD is refused.
CONCURRENCY, LINK_TIMEOUT, ARTIFACT_TIMEOUT = 8, 8.0, 15.0
HEAD_REFUSED = (403, 405, 501)

#: (method, url, timeout) -> (status, content type, body); raises OSError where there is no answer.
Send = Callable[[str, str, float], tuple[int, str, bytes]]


def http(method: str, url: str, timeout: float) -> tuple[int, str, bytes]:
    asked = urllib.request.Request(url, method=method, headers={"User-Agent": "vellum"})
    try:
        with urllib.request.urlopen(asked, timeout=timeout) as r:
            return r.status, r.headers.get("content-type", ""), r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("content-type", ""), b""


def _each(rows: DataFrame, ask: Callable[[tuple], tuple], schema: str) -> DataFrame:
    """ask(row) for every row, CONCURRENCY at a time in a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(CONCURRENCY) as pool:
            for pdf in batches:
                found = [*pool.map(ask, pdf.itertuples(index=False))]
                yield pd.DataFrame(found, columns=[x.strip().split(" ")[0] for x in schema.split(",")])

    return rows.mapInPandas(run, schema)


def probe_links(links: DataFrame, send: Send = http, timeout: float = LINK_TIMEOUT) -> DataFrame:
    """url -> url, head_status, get_status, error: each URL once, GET only where HEAD is refused."""

    def ask(row) -> tuple:
        head = get = None
        try:
            head = send("HEAD", row.url, timeout)[0]
            if head in HEAD_REFUSED:
                get = send("GET", row.url, timeout)[0]
        except OSError as e:
            return row.url, head, get, f"{type(e).__name__}: {e}"
        return row.url, head, get, None

    return _each(links.select("url").distinct(), ask, "url string, head_status int, get_status int, error string")


def artifact_api(kind: Column, identifier: Column) -> Column:
    at = {"hf_model": "https://huggingface.co/api/models/", "hf_dataset": "https://huggingface.co/api/datasets/", "github_repo": "https://api.github.com/repos/"}
    return F.concat(F.create_map(*[F.lit(x) for pair in at.items() for x in pair])[kind], identifier)


def probe_artifacts(artifacts: DataFrame, send: Send = http, timeout: float = ARTIFACT_TIMEOUT) -> DataFrame:
    """artifact_kind, identifier -> with status_code and parseable; no answer is status null."""

    def ask(row) -> tuple:
        import json

        try:
            status, _, body = send("GET", row.api, timeout)
        except OSError:
            return row.artifact_kind, row.identifier, None, False
        try:
            json.loads(body)
        except ValueError:
            return row.artifact_kind, row.identifier, status, False
        return row.artifact_kind, row.identifier, status, True

    asked = artifacts.select("artifact_kind", "identifier", artifact_api(F.col("artifact_kind"), F.col("identifier")).alias("api")).distinct()
    return _each(asked, ask, "artifact_kind string, identifier string, status_code int, parseable boolean")


def fetch_pdfs(places: DataFrame, send: Send = http, timeout: float = 60.0) -> DataFrame:
    """paper_id, ref_id, urls -> a row per place tried: pos, status, content_type, body; after a PDF no more are tried."""

    def ask(row) -> list[tuple]:
        out = []
        for pos, url in enumerate(row.urls if row.urls is not None else ()):
            try:
                status, kind, body = send("GET", url, timeout)
            except OSError:
                continue
            out.append((row.paper_id, row.ref_id, pos, status, kind, body))
            if status == 200 and body and ("pdf" in kind.lower() or body.startswith(b"%PDF")):
                break
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["paper_id", "ref_id", "pos", "status", "content_type", "body"]
        with ThreadPoolExecutor(CONCURRENCY) as pool:
            for pdf in batches:
                for at in range(0, len(pdf), CONCURRENCY):  # a few files in memory at a time
                    found = [x for some in pool.map(ask, pdf.iloc[at : at + CONCURRENCY].itertuples(index=False)) for x in some]
                    if found:
                        yield pd.DataFrame(found, columns=names)

    return places.select("paper_id", "ref_id", "urls").mapInPandas(run, "paper_id string, ref_id string, pos int, status int, content_type string, body binary")


def content_value(content: Column, key: str) -> Column:
    """A field of a note's content (JSON): {"value": ...} in one API version, plain in the other."""
    return F.coalesce(F.get_json_object(content, f"$.{key}.value"), F.get_json_object(content, f"$.{key}"))


def replies(notes: DataFrame) -> DataFrame:
    """paper_id, ref_id, reply_ord, content (JSON) -> decision and rating of each reply."""
    c = F.col("content")
    decision = F.coalesce(T.blank_to_null(content_value(c, "decision")), T.blank_to_null(content_value(c, "recommendation")))
    return notes.select("paper_id", "ref_id", "reply_ord", decision.alias("decision"), content_value(c, "rating").alias("rating"))


def load_env(folders: list[str], keys: list[str], environ: dict | None = None) -> dict[str, str]:
    """Keys out of the first .env file that has each, of the given folders in order; what the environment has wins and nothing else is read."""
    environ = os.environ if environ is None else environ
    for folder in folders:
        path = os.path.join(folder, ".env")
        if not os.path.isfile(path):
            continue
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, sep, value = line.strip().removeprefix("export ").partition("=")
                if sep and name.strip() in keys and name.strip() not in environ:
                    environ[name.strip()] = value.strip().strip("\"'")
    return {k: environ[k] for k in keys if k in environ}
