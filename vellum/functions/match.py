"""Matching predicates, identifiers and keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, squeeze, strip

# What an identifier looks like, and thresholds of a match.
DOI = r"(?i)10\.\d{4,9}/[^\s\"<>]+"
ARXIV_NEW = r"\b(\d{4}\.\d{4,5})(v\d+)?\b"
ARXIV_OLD = r"\b([a-z\-]+(?:\.[A-Z]{2})?/\d{7})(v\d+)?\b"
ARXIV_CONTEXT = r"(?i)(?:arxiv\.org/(?:abs|pdf)/|arxiv\s*[:\s]\s*|arxiv\.)(\d{4}\.\d{4,5}|[a-z\-]+(?:\.[A-Z]{2})?/\d{7})"
ARXIV_VENUE = r"(?i)\barxiv\b|\bcorr\b"
DATACITE_ARXIV = "10.48550/"
TITLE_JACCARD = 0.7
YEAR_TOLERANCE = 2
AUTHORS_COMPARED = 5


def normalize_doi(s: Column) -> Column:
    found = F.regexp_extract(F.regexp_replace(strip(s), r"(?i)^https?://(dx\.)?doi\.org/", ""), DOI, 0)
    return blank_to_null(F.regexp_replace(F.lower(found), r"[.,;)]+$", ""))


def normalize_arxiv_id(s: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(strip(s), r"(?i)^https?://arxiv\.org/abs/", ""), r"(?i)^arxiv:", "")
    return F.coalesce(blank_to_null(F.regexp_extract(s, ARXIV_NEW, 1)), blank_to_null(F.regexp_extract(s, ARXIV_OLD, 1)))


def arxiv_id_of(arxiv_id: Column, doi: Column, url: Column, raw_text: Column) -> Column:
    """Given, or recovered from a DataCite DOI, the URL, or raw text where arXiv is spoken of."""
    doi = normalize_doi(doi)
    from_doi = F.when(doi.startswith(DATACITE_ARXIV + "arxiv."), normalize_arxiv_id(F.substring(doi, len(DATACITE_ARXIV) + 7, 1000)))
    return F.coalesce(normalize_arxiv_id(arxiv_id), from_doi, normalize_arxiv_id(url), normalize_arxiv_id(blank_to_null(F.regexp_extract(raw_text, ARXIV_CONTEXT, 1))))


def cites_arxiv(doi: Column, arxiv: Column, venue: Column, url: Column) -> Column:
    """Whether an entry cites the preprint. arxiv: what arxiv_id_of gave."""
    doi = normalize_doi(doi)
    return F.when(doi.isNotNull() & ~doi.startswith(DATACITE_ARXIV), False).when(arxiv.isNotNull(), True).otherwise(F.coalesce(F.concat_ws(" ", venue, url).rlike(ARXIV_VENUE), F.lit(False)))


def norm_title(s: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(s), r"[^a-z0-9 ]+", " "))


def title_like(a: Column, b: Column, threshold: float = TITLE_JACCARD) -> Column:
    """Equal in normal form, or token sets with enough in common; never for a blank title."""
    a, b = norm_title(F.coalesce(a, F.lit(""))), norm_title(F.coalesce(b, F.lit("")))
    x, y = F.split(a, " "), F.split(b, " ")
    jaccard = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return (a != "") & (b != "") & ((a == b) | (jaccard >= threshold))


def title_matches(query: Column, candidates: Column) -> Column:
    return F.coalesce(F.exists(candidates, lambda c: title_like(query, c)), F.lit(False))


def year_compatible(a: Column, b: Column, tolerance: int = YEAR_TOLERANCE) -> Column:
    """An unknown year is compatible with any."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(True))


def surname(author: Column) -> Column:
    a = strip(author)
    return F.lower(F.when(F.contains(a, F.lit(",")), strip(F.split_part(a, F.lit(","), F.lit(1)))).otherwise(F.element_at(F.split(a, r"(?U)\s+"), -1)))


def surnames(authors: Column) -> Column:
    """The distinct surnames of the first authors, blanks left out."""
    return F.array_distinct(F.filter(F.transform(F.slice(F.coalesce(authors, F.array()), 1, AUTHORS_COMPARED), surname), lambda s: s.isNotNull() & (s != "")))


def surnames_overlap(a: Column, b: Column) -> Column:
    """No author on either side is no evidence of a match."""
    return F.coalesce(F.arrays_overlap(surnames(a), surnames(b)), F.lit(False))


def surname_mismatch(a: Column, b: Column) -> Column:
    """Both sides name authors and share none."""
    x, y = surnames(a), surnames(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)


# ---- keys ----


def slug(s: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 80)


def cache_key(doi: Column, arxiv_id: Column, title: Column, first_author: Column) -> Column:
    title, author = F.coalesce(title, F.lit("")), F.coalesce(first_author, F.lit(""))
    by_title = F.concat(F.lit("ta-"), slug(F.coalesce(blank_to_null(title), F.lit("untitled"))), F.lit("-"), F.substring(F.sha1(F.encode(F.concat(title, F.lit("|"), author), "utf-8")), 1, 16))
    return F.coalesce(F.concat(F.lit("doi-"), slug(blank_to_null(doi))), F.concat(F.lit("arxiv-"), slug(blank_to_null(arxiv_id))), by_title)


def verification_key(model: Column, ref_id: Column, sentence: Column, marker: Column) -> Column:
    nul = F.char(F.lit(0))
    return F.concat(F.lit("v-"), F.substring(F.sha1(F.encode(F.concat(model, nul, ref_id, nul, sentence, nul, marker), "utf-8")), 1, 24))


# ---- URLs ----

# Hosts that name their owners, hosts of code and data, and open-access hosts.
IDENTITY_HOSTS = ["github.com", "gitlab.com", "bitbucket.org"]
SCHEMES_DROPPED = ["mailto:", "javascript:", "tel:", "data:"]


def normalize_url(raw: Column) -> Column:
    s = F.regexp_replace(strip(raw), r"[.,;)]+$", "")
    low = F.lower(s)
    dropped = F.lit(False)
    for x in SCHEMES_DROPPED:
        dropped = dropped | low.startswith(x)
    host_like = F.contains(F.split_part(s, F.lit("/"), F.lit(1)), F.lit("."))
    return F.when((s == "") | dropped, None).when(low.rlike(r"^(?:https?|ftp)://"), s).when(host_like, F.concat(F.lit("https://"), s))


def is_identity_url(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    at = F.instr(low, F.lit("//"))
    host = F.split_part(F.when(at > 0, F.substring(low, at + 2, F.length(low))).otherwise(low), F.lit("/"), F.lit(1))
    known = host.endswith(".github.io") | host.endswith(".gitlab.io") | F.contains(low, F.lit("/~"))
    for h in IDENTITY_HOSTS:
        known = known | F.contains(host, F.lit(h))
    return known


OPEN_HOSTS = ["arxiv.org/pdf", "biorxiv.org", "openreview.net/pdf", "aclanthology.org", ".github.io/"]


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether lower-cased text holds one of the words; null holds none."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def is_open_access(url: Column) -> Column:
    return contains_any(url, OPEN_HOSTS)


def http_outcome(status: Column) -> Column:
    """retry for what may pass, else terminal."""
    return F.when(status.isin(429, 500, 502, 503, 504), "retry").otherwise("terminal")
