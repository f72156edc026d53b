"""From entries to resolutions in one run: look-ups, answers, candidates, decisions, follow-ups and the record store.

Sources are asked step by step, identifiers before titles, and only for entries that no earlier step
has settled; a step is one table of requests, each asked once however many entries want it, and one
table of answers. What is asked is decided by joins on those tables, never by a loop over entries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import match as M
from vellum.functions import text as T
from vellum.sources import connectors
from vellum.sources import payloads as P
from vellum.sources.scratch import stored

from . import resolution

KEY = resolution.KEY
ASKED = ["source", "mode", "lookup_key", "url"]
CANDIDATE = "source string, title string, authors array<string>, year int, venue string, doi string, url string, abstract string, open_access_pdf_url string, is_retracted boolean"
VERSION = "venue string, year int, doi string, url string, source string"

#: source, mode, lookup_key, url -> the same with tag, status, attempts, payload.
Ask = Callable[[DataFrame], DataFrame]


def recorded(answers: DataFrame) -> Ask:
    """An Ask that looks answers up: source, mode, lookup_key, tag, payload[, status, attempts]. What was never recorded is no answer."""
    for c, kind in (("status", "int"), ("attempts", "int")):
        if c not in answers.columns:
            answers = answers.withColumn(c, F.lit(1 if c == "attempts" else None).cast(kind))
    answers = answers.select("source", "mode", "lookup_key", "tag", "status", "attempts", "payload").dropDuplicates(["source", "mode", "lookup_key"])

    def ask(asked: DataFrame) -> DataFrame:
        rows = asked.join(answers, ["source", "mode", "lookup_key"], "left")
        return rows.select(*ASKED, F.coalesce("tag", F.lit("transient")).alias("tag"), "status", F.coalesce("attempts", F.lit(0)).alias("attempts"), "payload")

    return ask


def live(fetch: connectors.Fetch = connectors.http, **how) -> Ask:
    return lambda asked: connectors.ask_all(asked, fetch, **how)


def ask_each(wanted: DataFrame, ask: Ask, label: str) -> DataFrame:
    """wanted: KEY and a look-up each -> with its answer; a look-up that several want is asked once."""
    wanted = stored(wanted.select(*KEY, *ASKED), f"{label}-wanted")
    answers = stored(ask(wanted.select(*ASKED).distinct()), f"{label}-answers")
    return stored(wanted.join(answers.drop("url"), ["source", "mode", "lookup_key"]), f"{label}-answered")


# ---- records out of answers ----


def items(source: Column, mode: Column, payload: Column) -> Column:
    """The items of an answer, each as JSON or XML: one for a look-up by identifier, a list for a search."""
    listed = lambda schema, *path: _path(F.from_json(payload, schema), path)
    by_id = F.when(source == "crossref", F.array(F.get_json_object(payload, "$.message"))).when(source == "arxiv", P.arxiv_entries(payload)).otherwise(F.array(payload))
    found = F.when(source == "crossref", listed("message struct<items:array<string>>", "message", "items")).when(source == "semanticscholar", listed("data array<string>", "data"))
    found = found.when(source == "openalex", listed("results array<string>", "results")).when(source == "dblp", listed("result struct<hits:struct<hit:array<string>>>", "result", "hits", "hit")).when(source == "arxiv", P.arxiv_entries(payload))
    return F.when(mode == "search", found).otherwise(by_id)


def _path(c: Column, path: tuple[str, ...]) -> Column:
    for name in path:
        c = c[name]
    return c


def record_of(source: Column, item: Column) -> Column:
    made = {"crossref": P.crossref, "semanticscholar": P.semantic_scholar, "arxiv": P.arxiv, "openalex": P.openalex}
    out = F.lit(None)
    for name, make in made.items():
        out = F.when(source == name, make(item)).otherwise(out)
    return out


def candidates(answered: DataFrame) -> DataFrame:
    """KEY, mode, source, item_rank, the record's fields, and the published version that a record itself tells of."""
    rows = answered.where("tag = 'ok'").select(*KEY, "mode", "source", F.posexplode(items(F.col("source"), F.col("mode"), F.col("payload"))).alias("item_rank", "item"))
    version = F.when(F.col("source") == "semanticscholar", P.s2_published(F.col("item"))).when(F.col("source") == "arxiv", P.arxiv_published(F.col("item"))).cast(f"struct<{VERSION.replace(' ', ':').replace(',:', ',')}>")
    rows = rows.select(*KEY, "mode", "item_rank", record_of(F.col("source"), F.col("item")).alias("r"), version.alias("known_version")).where("r IS NOT NULL")
    return rows.select(*KEY, "mode", "item_rank", "r.*", "known_version")


# ---- the steps ----


def look_up(refs: DataFrame, ask: Ask) -> tuple[DataFrame, DataFrame]:
    """refs -> responses (KEY, mode, source, tag, attempts) and candidates of every step that some entry came to."""
    every = stored(connectors.lookups(refs), "lookups")
    open_, answered, found = refs.select(*KEY), [], []
    for mode in resolution.MODES:
        for source in resolution.SOURCES:
            here = every.where((F.col("mode") == mode) & (F.col("source") == source)).join(open_, KEY, "left_semi")
            answers = ask_each(here, ask, f"{source}-{mode}")
            new = stored(candidates(answers), f"{source}-{mode}-candidates")
            answered.append(answers.select(*KEY, "mode", "source", "tag", "attempts"))
            found.append(new)
            strong = resolution.triage(refs, new).where("class = 'strong'").select(*KEY).distinct()
            open_ = stored(open_.join(strong, KEY, "left_anti"), "open")
    union = lambda parts: _union(parts)
    return union(answered), union(found)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_retraction(resolved: DataFrame, ask: Ask) -> DataFrame:
    """Records from elsewhere are looked up by DOI where retractions are listed; no answer means not retracted."""
    doi = F.lower("record.doi")
    wanted = resolved.where((F.col("record.source") != "openalex") & ~F.coalesce("record.is_retracted", F.lit(False)) & (F.coalesce("record.doi", F.lit("")) != ""))
    wanted = wanted.select(*KEY, F.lit("openalex").alias("source"), F.lit("retraction").alias("mode"), doi.alias("lookup_key"), F.concat(F.lit("https://api.openalex.org/works/doi:"), doi).alias("url"))
    answers = ask_each(wanted, ask, "retraction").where("tag = 'ok'")
    flags = answers.select(F.col("lookup_key").alias("doi"), F.coalesce(F.get_json_object("payload", "$.is_retracted") == "true", F.lit(False)).alias("is_retracted"))
    return resolution.with_retractions(resolved, flags)


def with_published(refs: DataFrame, resolved: DataFrame, ask: Ask) -> DataFrame:
    """resolved: KEY, record, match_note, checked -> with published_version, published_version_checked, unchecked_now.

    The record itself, then Semantic Scholar by arXiv id, then DBLP by title; Crossref by title only where
    Semantic Scholar gave no answer.
    """
    r = refs.select(*KEY, F.col("title").alias("r_title"), F.col("authors").alias("r_authors"), F.col("year").alias("r_year"), F.col("venue").alias("r_venue"), F.col("doi").alias("r_doi"), F.col("arxiv_id").alias("r_arxiv"), F.col("url").alias("r_url"), "raw_text")
    arxiv = M.arxiv_id_of(F.col("r_arxiv"), F.col("r_doi"), F.col("r_url"), F.col("raw_text"))
    rows = resolved.join(r, KEY).withColumn("arxiv", arxiv)
    cites = (F.col("status") == "resolved") & M.cites_arxiv(F.col("r_doi"), F.col("arxiv"), F.col("r_venue"), F.col("r_url"))
    by_record = F.coalesce(resolution.published_by_record(F.col("record"), F.col("match_note")), F.col("record.known_version"))
    title, authors = F.coalesce(T.blank_to_null(F.col("r_title")), F.col("record.title")), F.when(F.size("r_authors") > 0, F.col("r_authors")).otherwise(F.col("record.authors"))
    rows = rows.select(
        *KEY, "record", "match_note", "checked", F.coalesce(cites, F.lit(False)).alias("cites_arxiv"), by_record.alias("by_record"), title.alias("title"), authors.alias("authors"),
        F.coalesce("r_year", "record.year").alias("year"), F.coalesce("arxiv", M.normalize_arxiv_id(F.col("record.url"))).alias("arxiv"),
    )
    rows = stored(rows, "published-wanted")
    open_ = rows.where("cites_arxiv AND NOT checked AND by_record IS NULL")

    s2_url = F.concat(F.lit("https://api.semanticscholar.org/graph/v1/paper/ARXIV:"), F.col("arxiv"), F.lit("?fields=externalIds,venue,publicationVenue,year"))
    wanted = open_.where("arxiv IS NOT NULL AND record.source <> 'semanticscholar'").select(*KEY, F.lit("semanticscholar").alias("source"), F.lit("published").alias("mode"), F.col("arxiv").alias("lookup_key"), s2_url.alias("url"))
    s2 = ask_each(wanted, ask, "published-s2").select(*KEY, F.col("tag").alias("s2_tag"), F.when(F.col("tag") == "ok", P.s2_published(F.col("payload"))).alias("s2"))
    rows = rows.join(s2, KEY, "left").withColumn("s2_tag", F.when(F.col("record.source") == "semanticscholar", "ok").otherwise(F.coalesce("s2_tag", F.lit("skip"))))

    open_ = stored(rows, "published-s2-done").where("cites_arxiv AND NOT checked AND by_record IS NULL AND s2 IS NULL AND coalesce(title, '') <> ''")
    name = M.surname(F.get("authors", F.lit(0)))
    q = F.concat_ws(" ", "title", T.blank_to_null(name))
    dblp_url = F.concat(F.lit("https://dblp.org/search/publ/api?q="), F.url_encode(q), F.lit("&format=json&h=10"))
    wanted = open_.select(*KEY, F.lit("dblp").alias("source"), F.lit("search").alias("mode"), q.alias("lookup_key"), dblp_url.alias("url"))
    answers = ask_each(wanted, ask, "published-dblp")
    found = answers.where("tag = 'ok'").select(*KEY, F.posexplode(items(F.lit("dblp"), F.lit("search"), F.col("payload"))).alias("item_rank", "item"))
    found = found.select(*KEY, "item_rank", P.dblp(F.get_json_object("item", "$.info")).alias("d")).where("d IS NOT NULL").select(*KEY, "item_rank", "d.*")
    dblp = resolution.published_by_search(open_.select(*KEY, "title", "authors", "year"), found, "dblp")
    tags = answers.select(*KEY, F.col("tag").alias("dblp_tag"))
    rows = stored(rows.join(tags, KEY, "left").join(dblp, KEY, "left").withColumn("dblp_tag", F.coalesce("dblp_tag", F.lit("skip"))), "published-dblp-done")

    open_ = rows.where("cites_arxiv AND NOT checked AND by_record IS NULL AND s2 IS NULL AND dblp IS NULL AND s2_tag NOT IN ('ok', 'terminal') AND coalesce(title, '') <> ''")
    wanted = open_.select(*KEY, F.lit("crossref").alias("source"), F.lit("search").alias("mode"), F.col("title").alias("lookup_key"), connectors.crossref_search(F.col("title"), F.get("authors", F.lit(0))).alias("url"))
    answers = ask_each(wanted, ask, "published-crossref")
    found = answers.where("tag = 'ok'").select(*KEY, F.posexplode(items(F.lit("crossref"), F.lit("search"), F.col("payload"))).alias("item_rank", "item"))
    held = P.listed(F.get_json_object("item", "$.container-title"))
    found = found.select(*KEY, "item_rank", F.get_json_object("item", "$.type").alias("type"), P.crossref(F.col("item")).alias("r"), T.blank_to_null(held).alias("held")).where("held IS NOT NULL")
    found = found.select(*KEY, "item_rank", "type", "r.title", "r.authors", "r.year", F.col("held").alias("venue"), "r.doi", "r.url")
    crossref = resolution.published_by_search(open_.select(*KEY, "title", "authors", "year"), found, "crossref")
    rows = rows.join(answers.select(*KEY, F.col("tag").alias("crossref_tag")), KEY, "left").join(crossref, KEY, "left").withColumn("crossref_tag", F.coalesce("crossref_tag", F.lit("skip")))
    done = stored(resolution.published_version(rows).select(*KEY, "published_version", "published_version_checked", "unchecked_now"), "published-done")
    return resolved.drop("checked").join(done, KEY)


def keyed(refs: DataFrame) -> DataFrame:
    """refs with the key of their records in the store."""
    doi, arxiv = M.normalize_doi(F.col("doi")), M.arxiv_id_of(F.col("arxiv_id"), F.col("doi"), F.col("url"), F.col("raw_text"))
    return refs.withColumn("cache_key", M.cache_key(doi, arxiv, F.col("title"), F.get("authors", F.lit(0))))


def resolve_all(refs: DataFrame, ask: Ask, store: DataFrame | None = None) -> dict[str, DataFrame]:
    """resolutions of every entry, responses of the sources, and new_records for the store.

    store: cache_key, record, match_note, is_retracted, published_version, published_version_checked of
    earlier runs. An entry found there asks nothing but for its published version, if that is not yet known;
    only resolved entries are stored, and of entries with one key the first.
    """
    refs = stored(keyed(refs), "resolve-refs")
    plain = refs.drop("cache_key")
    none = F.array().cast("array<string>")
    if store is None:
        misses, hits = plain, None
    else:
        kept = store.select("cache_key", "record", "match_note", "is_retracted", F.col("published_version").alias("old_version"), F.col("published_version_checked").alias("checked"))
        hits = stored(refs.select(*KEY, "cache_key").join(kept, "cache_key"), "resolve-hits")
        hits = hits.select(*KEY, F.lit("resolved").alias("status"), "record", "match_note", none.alias("near_misses"), "is_retracted", "checked", "old_version", F.lit(True).alias("from_store"))
        misses = plain.join(hits.select(*KEY), KEY, "left_anti")
    responses, found = look_up(misses, ask)
    new = resolution.resolve(misses, responses, found, never_asked="unresolved")
    new = stored(with_retraction(stored(new, "resolve-decided"), ask), "resolve-new")
    version = F.lit(None).cast(f"struct<{VERSION.replace(' ', ':').replace(',:', ',')}>")
    new = new.select(*KEY, "status", "record", "match_note", "near_misses", "is_retracted", F.lit(False).alias("checked"), version.alias("old_version"), F.lit(False).alias("from_store"))
    rows = stored(new if hits is None else new.unionByName(hits), "resolve-all")
    rows = with_published(plain, rows, ask)
    rows = rows.withColumn("changed", (F.col("status") == "resolved") & (~F.col("from_store") | ~F.col("published_version").eqNullSafe(F.col("old_version")) & F.col("published_version").isNotNull()))
    rows = rows.withColumn("published_version", F.coalesce("published_version", "old_version")).drop("old_version")
    rows = stored(rows, "resolutions")
    kept = rows.where("changed").join(refs.select(*KEY, "cache_key", "ordinal"), KEY)
    value = F.struct("record", "match_note", "is_retracted", "published_version", "published_version_checked")
    kept = kept.groupBy("cache_key").agg(F.min_by(value, F.struct(*KEY, "ordinal")).alias("x")).select("cache_key", "x.*")
    return {"resolutions": rows.drop("changed"), "responses": responses, "new_records": kept}


def counters(responses: DataFrame, resolutions: DataFrame) -> DataFrame:
    """One row: recovered (answers that took a retry), skipped (look-ups that an open breaker left out), unchecked (published versions not told this time). Derived from rows, so a task that runs again counts once."""
    a = responses.agg(F.count_if((F.col("attempts") > 1) & (F.col("tag") != "transient")).alias("recovered"), F.count_if(F.col("attempts") == 0).alias("skipped"), F.array_sort(F.collect_set(F.when(F.col("attempts") == 0, F.col("source")))).alias("broken_sources"))
    return a.crossJoin(resolutions.agg(F.count_if("unchecked_now").alias("unchecked")))  # a row each


# ---- full texts ----


def unpaywall_pdf(payload: Column) -> Column:
    place = "struct<url_for_pdf:string,url:string>"
    m = F.from_json(payload, f"best_oa_location {place}, oa_locations array<{place}>")
    every = F.concat(F.array(m["best_oa_location"]), F.coalesce(m["oa_locations"], F.array().cast(f"array<{place}>")))
    return F.get(F.array_compact(F.transform(every, lambda x: F.coalesce(T.blank_to_null(x["url_for_pdf"]), T.blank_to_null(x["url"])))), F.lit(0))


def openalex_pdf(payload: Column) -> Column:
    m = F.from_json(payload, "open_access struct<oa_url:string>, primary_location struct<pdf_url:string>")
    return F.coalesce(T.blank_to_null(m["open_access"]["oa_url"]), T.blank_to_null(m["primary_location"]["pdf_url"]))


def open_access_urls(resolutions: DataFrame, refs: DataFrame, ask: Ask, email: str | None = None) -> DataFrame:
    """KEY, urls (where a full text may be, in the order to try), unpaywall_skipped (no e-mail to ask with)."""
    rows = resolutions.where("record IS NOT NULL").join(refs.select(*KEY, F.col("url").alias("ref_url")), KEY)
    rows = rows.select(*KEY, F.lower("record.doi").alias("doi"), F.col("record.open_access_pdf_url").alias("own"), "ref_url")
    has = rows.where("coalesce(doi, '') <> ''")
    look = lambda source, url: has.select(*KEY, F.lit(source).alias("source"), F.lit("open_access").alias("mode"), F.col("doi").alias("lookup_key"), url.alias("url"))
    wanted = look("openalex", F.concat(F.lit("https://api.openalex.org/works/doi:"), F.url_encode("doi")))
    if email:
        wanted = wanted.unionByName(look("unpaywall", F.concat(F.lit("https://api.unpaywall.org/v2/"), F.url_encode("doi"), F.lit("?email="), F.url_encode(F.lit(email)))))
    answers = ask_each(wanted, ask, "open-access").where("tag = 'ok'")
    at = F.when(F.col("source") == "unpaywall", unpaywall_pdf(F.col("payload"))).otherwise(openalex_pdf(F.col("payload")))
    found = answers.withColumn("at", at).groupBy(*KEY).agg(F.max(F.when(F.col("source") == "unpaywall", F.col("at"))).alias("unpaywall"), F.max(F.when(F.col("source") == "openalex", F.col("at"))).alias("openalex"))
    from . import verification

    urls = verification.open_access_candidates(F.col("own"), F.col("ref_url"), F.col("unpaywall"), F.col("openalex"))
    skipped = (F.coalesce("doi", F.lit("")) != "") & F.lit(not email)
    return rows.join(found, KEY, "left").select(*KEY, urls.alias("urls"), skipped.alias("unpaywall_skipped"))
