"""Every query of the engine by name, with its SQL where SQL can express it.

Queries over shared literals (fixtures) show the operators that the test tables have no input for;
the others run the same operators over whole tables. The dialect of the SQL has no look-around, no
spans and no balanced braces, so queries that need them have none and are tested in tests/.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import match as M
from vellum.functions import text as T
from vellum.operators import anonymity, checklist, coverage, findings, judging, lookups, numbers, pages, report, resolution, submission, tex, verification
from vellum.sources import payloads, tables

from . import engine, sources
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, needs: tuple[X.Rows, ...] = ()):
    """Registers a function under its name, with SQL over the given fixtures' rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            head = "WITH " + ", ".join(x.cte() for x in needs) if needs else ""
            body = sql.strip()
            ORACLE[f.__name__] = f"{head}, {body[5:]}" if head and body.upper().startswith("WITH ") else f"{head} {body}"
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Pieces of SQL that several queries share.
SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
NORM = SQUEEZE.format("regexp_replace(lower({0}), '[^a-z0-9 ]+', ' ', 'g')")
LIKE = f"({NORM.format('{0}')} <> '' AND {NORM.format('{1}')} <> '' AND ({NORM.format('{0}')} = {NORM.format('{1}')} OR len(list_intersect(list_distinct(string_split({NORM.format('{0}')}, ' ')), list_distinct(string_split({NORM.format('{1}')}, ' '))))::DOUBLE / len(list_distinct(list_concat(string_split({NORM.format('{0}')}, ' '), string_split({NORM.format('{1}')}, ' ')))) >= 0.7))"
SURNAME = "lower(CASE WHEN contains(trim({0}), ',') THEN trim(split_part(trim({0}), ',', 1)) ELSE list_last(regexp_split_to_array(trim({0}), '\\s+')) END)"
SURNAMES = f"list_distinct(list_filter(list_transform(list_slice(coalesce({{0}}, []), 1, 5), lambda a: {SURNAME.format('a')}), lambda s: s <> ''))"
DOI = "nullif(rtrim(lower(regexp_extract(regexp_replace(trim({0}), '^https?://(dx\\.)?doi\\.org/', '', 'i'), '10\\.\\d{{4,9}}/[^\\s\"<>]+', 0, 'i')), '.,;)'), '')"
ARXIV = "regexp_replace(regexp_replace(trim({0}), '^https?://arxiv\\.org/abs/', '', 'i'), '^arxiv:', '', 'i')"
ARXIV = f"coalesce(nullif(regexp_extract({ARXIV}, '\\b(\\d{{{{4}}}}\\.\\d{{{{4,5}}}})(v\\d+)?\\b', 1), ''), nullif(regexp_extract({ARXIV}, '\\b([a-z\\-]+(?:\\.[A-Z]{{{{2}}}})?/\\d{{{{7}}}})(v\\d+)?\\b', 1), ''))"
URL = "rtrim(trim({0}), '.,;)')"
URL = f"CASE WHEN {URL} = '' OR regexp_matches(lower({URL}), '^(mailto:|javascript:|tel:|data:)') THEN NULL WHEN regexp_matches(lower({URL}), '^(https?|ftp)://') THEN {URL} WHEN contains(split_part({URL}, '/', 1), '.') THEN 'https://' || {URL} END"
HOST = "split_part(CASE WHEN contains(lower(coalesce({0}, '')), '//') THEN substr(lower({0}), instr(lower({0}), '//') + 2) ELSE lower(coalesce({0}, '')) END, '/', 1)"
IDENTITY = f"(regexp_matches({HOST}, 'github\\.com|gitlab\\.com|bitbucket\\.org') OR ends_with({HOST}, '.github.io') OR ends_with({HOST}, '.gitlab.io') OR contains(lower(coalesce({{0}}, '')), '/~'))"
BLANK = "(trim(lower({0})) = '' OR contains(lower({0}), 'type your response here'))"
WORDS = "regexp_extract_all(lower({0}), '[a-z]+')"
ANSWER = f"CASE WHEN {BLANK} OR len({WORDS}) = 0 THEN NULL WHEN len({WORDS}) <= 3 AND len(list_filter({WORDS}, lambda w: length(w) > 1)) = 0 THEN array_to_string({WORDS}, '') ELSE {WORDS}[1] END"
SEVERITY = "CASE {0} " + " ".join(f"WHEN '{v}' THEN {n}" for v, n in coverage.SEVERITY.items()) + " END"
PROBLEM = "({0}verdict IN ('does_not_support', 'partially_supports', 'target_unavailable', 'metadata_mismatch') OR (({0}verdict = 'abstract_too_thin' OR ({0}verdict = 'supports' AND {0}abstract_only)) AND {0}role IS DISTINCT FROM 'method_attribution'))"
ANONYMOUS = "(trim(coalesce({0}, '')) = '' OR regexp_matches(lower({0}), '" + "|".join(anonymity.ANONYMOUS) + "'))"

DECIDED = f"""WITH t AS (SELECT c.*, r.year AS r_year, CASE mode WHEN 'id' THEN 0 ELSE 4 END + list_position(['crossref', 'semanticscholar', 'arxiv', 'openalex'], source) - 1 AS step,
      CASE WHEN mode = 'id' THEN 'strong' WHEN NOT {LIKE.format("r.title", "c.title")} THEN NULL WHEN coalesce(abs(r.year - c.year) <= 2, true) THEN 'strong'
       WHEN coalesce(list_has_any({SURNAMES.format("r.authors")}, {SURNAMES.format("c.authors")}), false) THEN 'weak' ELSE 'near_miss' END AS class
      FROM {{cands}} c JOIN {{refs}} r ON c.paper_id = r.paper_id AND c.ref_id = r.ref_id),
    s AS (SELECT paper_id, ref_id, min(step) AS stop, arg_min({{{{'source': source, 'year': year, 'authors': authors}}}}, step * 100 + item_rank) AS rec FROM t WHERE class = 'strong' GROUP BY ALL),
    f AS (SELECT p.paper_id, p.ref_id, bool_or(tag = 'transient') AS transient FROM {{resps}} p LEFT JOIN s ON s.paper_id = p.paper_id AND s.ref_id = p.ref_id
      WHERE stop IS NULL OR CASE mode WHEN 'id' THEN 0 ELSE 4 END + list_position(['crossref', 'semanticscholar', 'arxiv', 'openalex'], source) - 1 < stop GROUP BY ALL),
    w AS (SELECT paper_id, ref_id, arg_min({{{{'source': source, 'year': year, 'authors': authors}}}}, coalesce(abs(year - r_year), 10000) * 10000 + step * 100 + item_rank) AS rec FROM t WHERE class = 'weak' GROUP BY ALL),
    n AS (SELECT paper_id, ref_id, count(*) AS n FROM t WHERE class = 'near_miss' GROUP BY ALL),
    decided AS (SELECT r.paper_id, r.ref_id, CASE WHEN s.rec IS NOT NULL THEN 'resolved' WHEN coalesce(transient, false) THEN 'degraded' WHEN w.rec IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS status,
     CASE WHEN s.rec IS NOT NULL THEN s.rec.source WHEN NOT coalesce(transient, false) THEN w.rec.source END AS source, CASE WHEN s.rec IS NOT NULL THEN s.rec.authors WHEN NOT coalesce(transient, false) THEN w.rec.authors END AS authors, CASE WHEN s.rec IS NOT NULL THEN s.rec.year WHEN NOT coalesce(transient, false) THEN w.rec.year END AS year,
     s.rec IS NULL AND NOT coalesce(transient, false) AND w.rec IS NOT NULL AS is_weak,
     CAST(CASE WHEN s.rec IS NOT NULL OR (NOT coalesce(transient, false) AND w.rec IS NOT NULL) THEN 0 ELSE coalesce(n.n, 0) END AS INTEGER) AS n_near
    FROM {{refs}} r LEFT JOIN s ON s.paper_id = r.paper_id AND s.ref_id = r.ref_id LEFT JOIN f ON f.paper_id = r.paper_id AND f.ref_id = r.ref_id
     LEFT JOIN w ON w.paper_id = r.paper_id AND w.ref_id = r.ref_id LEFT JOIN n ON n.paper_id = r.paper_id AND n.ref_id = r.ref_id)"""
TOKEN_SETS = f"SELECT doc_id, list_sort(list_distinct(string_split({NORM.format('text')}, ' '))) AS w FROM documents WHERE {NORM.format('text')} <> ''"


# ---- joins between citations, entries and records ----


@query(
    """SELECT paper_id, 'unused' AS kind, ref_id FROM refs r WHERE NOT EXISTS (SELECT 1 FROM cites c WHERE c.paper_id = r.paper_id AND c.ref_id = r.ref_id)
    UNION ALL SELECT DISTINCT paper_id, 'ghost', ref_id FROM cites c WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE c.paper_id = r.paper_id AND c.ref_id = r.ref_id)""",
    (X.REFS, X.CITATIONS),
)
def refs_unused_and_ghost(spark, sf):
    refs, cites = X.REFS.df(spark).withColumn("is_synthetic", F.lit(False)), X.CITATIONS.df(spark)
    kind = lambda df, k: df.select("paper_id", F.lit(k).alias("kind"), "ref_id")
    return kind(tex.unused_keys(refs, cites), "unused").unionByName(kind(tex.ghosts(cites, refs), "ghost"))


@query(
    f"""SELECT paper_id, ref_id, {DOI.format("doi")} AS doi, coalesce({ARXIV.format("arxiv_id")}, CASE WHEN starts_with({DOI.format("doi")}, '10.48550/arxiv.') THEN {ARXIV.format(f"substr({DOI.format('doi')}, 16)")} END, {ARXIV.format("url")},
     {ARXIV.format("nullif(regexp_extract(raw_text, '(?:arxiv\\.org/(?:abs|pdf)/|arxiv\\s*[:\\s]\\s*|arxiv\\.)(\\d{4}\\.\\d{4,5}|[a-z\\-]+(?:\\.[A-Z]{2})?/\\d{7})', 1, 'i'), '')")}) AS arxiv FROM refs""",
    (X.REFS,),
)
def identifiers_normalised(spark, sf):
    c = F.col
    return X.REFS.df(spark).select("paper_id", "ref_id", M.normalize_doi(c("doi")).alias("doi"), M.arxiv_id_of(c("arxiv_id"), c("doi"), c("url"), c("raw_text")).alias("arxiv"))


@query(
    f"""SELECT c.paper_id, c.ref_id, c.mode, c.source, {LIKE.format("r.title", "c.title")} AS title_ok, coalesce(abs(r.year - c.year) <= 2, true) AS year_ok,
     coalesce(list_has_any({SURNAMES.format("r.authors")}, {SURNAMES.format("c.authors")}), false) AS authors_ok
     FROM cands c JOIN refs r ON c.paper_id = r.paper_id AND c.ref_id = r.ref_id""",
    (X.REFS, X.CANDIDATES),
)
def match_predicates(spark, sf):
    r = X.REFS.df(spark).select("paper_id", "ref_id", F.col("title").alias("t"), F.col("authors").alias("a"), F.col("year").alias("y"))
    c = F.col
    return X.CANDIDATES.df(spark).join(r, ["paper_id", "ref_id"]).select("paper_id", "ref_id", "mode", "source", M.title_like(c("t"), c("title")).alias("title_ok"), M.year_compatible(c("y"), c("year")).alias("year_ok"), M.surnames_overlap(c("a"), c("authors")).alias("authors_ok"))


@query(f"""{DECIDED.format(refs="refs", cands="cands", resps="resps")} SELECT * EXCLUDE authors FROM decided""", (X.REFS, X.CANDIDATES, X.RESPONSES))
def resolution_decisions(spark, sf):
    out = resolution.resolve(X.REFS.df(spark), X.RESPONSES.df(spark), X.CANDIDATES.df(spark))
    return out.select("paper_id", "ref_id", "status", F.col("record.source").alias("source"), F.col("record.year").alias("year"), F.col("match_note").isNotNull().alias("is_weak"), F.size("near_misses").alias("n_near"))


@query(
    f"""{DECIDED.format(refs="refs", cands="cands", resps="resps")}
    SELECT c.paper_id, c.cite_ord, c.ref_id, CASE WHEN v.status = 'degraded' THEN 'verification_unavailable' WHEN v.source IS NULL THEN 'target_unavailable'
      WHEN len({SURNAMES.format("r.authors")}) > 0 AND len({SURNAMES.format("v.authors")}) > 0 AND NOT list_has_any({SURNAMES.format("r.authors")}, {SURNAMES.format("v.authors")}) THEN 'metadata_mismatch' END AS verdict
    FROM cites c JOIN refs r ON c.paper_id = r.paper_id AND c.ref_id = r.ref_id JOIN decided v ON v.paper_id = c.paper_id AND v.ref_id = c.ref_id""",
    (X.REFS, X.CANDIDATES, X.RESPONSES, X.CITATIONS),
)
def citations_short_circuited(spark, sf):
    refs = X.REFS.df(spark)
    resolved = resolution.resolve(refs, X.RESPONSES.df(spark), X.CANDIDATES.df(spark), never_asked="unresolved")
    return verification.short_circuit(X.CITATIONS.df(spark), refs, resolved).select("paper_id", "cite_ord", "ref_id", "verdict")


@query(f"SELECT min(doc_id) OVER (PARTITION BY w) AS class_id, doc_id FROM ({TOKEN_SETS})")
def title_classes(spark, sf):
    """Texts with one set of tokens, each by its class's least id."""
    return resolution.title_classes(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))).select("class_id", F.col("id").alias("doc_id"))


@query(
    f"""WITH r AS (SELECT min(doc_id) AS id, w FROM ({TOKEN_SETS}) GROUP BY w), t AS (SELECT id, len(w) AS n, unnest(w) AS t FROM r),
    p AS (SELECT a.id AS l_id, b.id AS r_id, count(*) AS c, any_value(a.n) AS m, any_value(b.n) AS n FROM t a JOIN t b ON a.t = b.t AND a.id < b.id GROUP BY ALL)
    SELECT l_id, r_id FROM p WHERE c >= 0.7 * (m + n - c) - 1e-9"""
)
def title_linkage(spark, sf):
    """Classes of texts whose token sets are alike, by joining on rare tokens: pairs of their least ids."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))
    return resolution.linked_titles(docs)


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def keys_never_used(spark, sf):
    """Documents as entries, labels as citations: entries that nothing cites."""
    refs = read(spark, sf, "documents").select(F.lit("all").alias("paper_id"), F.col("doc_id").alias("ref_id"), F.lit(False).alias("is_synthetic"))
    cites = read(spark, sf, "labels").select(F.lit("all").alias("paper_id"), F.col("doc_id").alias("ref_id"))
    return tex.unused_keys(refs, cites).select(F.col("ref_id").alias("doc_id"))


# ---- URLs, artifacts, probes ----


@query(
    f"SELECT n, {URL.format('url')} AS normal, {IDENTITY.format('url')} AS is_identity, regexp_matches(lower(coalesce(url, '')), 'arxiv\\.org/pdf|biorxiv\\.org|openreview\\.net/pdf|aclanthology\\.org|\\.github\\.io/') AS is_open FROM urls",
    (X.URLS,),
)
def urls_classified(spark, sf):
    u = F.col("url")
    return X.URLS.df(spark).select("n", M.normalize_url(u).alias("normal"), M.is_identity_url(u).alias("is_identity"), M.is_open_access(u).alias("is_open"))


@query(f"SELECT page_id, {URL.format('url')} AS normal, {HOST.format('url')} AS host, {IDENTITY.format('url')} AS is_identity FROM (SELECT page_id, url, row_number() OVER (PARTITION BY url ORDER BY page_id) AS k FROM pages) WHERE k = 1")
def page_urls_first_seen(spark, sf):
    rows = tex.first_seen(read(spark, sf, "pages").select("page_id", "url"), ["url"], ["page_id"])
    low = F.lower(F.coalesce("url", F.lit("")))
    at = F.instr(low, F.lit("//"))
    host = F.split_part(F.when(at > 0, F.substring(low, at + 2, F.length(low))).otherwise(low), F.lit("/"), F.lit(1))
    return rows.select("page_id", M.normalize_url(F.col("url")).alias("normal"), host.alias("host"), M.is_identity_url(F.col("url")).alias("is_identity"))


@query(
    """WITH m AS (SELECT n, lower(regexp_extract(url, 'https?://(?:www\\.)?(huggingface\\.co|github\\.com)/([^?#\\s]+)', 1, 'i')) AS host, list_filter(string_split(regexp_extract(url, 'https?://(?:www\\.)?(huggingface\\.co|github\\.com)/([^?#\\s]+)', 2, 'i'), '/'), lambda s: s <> '') AS s FROM urls),
    k AS (SELECT n, s, CASE WHEN host = 'github.com' AND len(s) >= 2 AND lower(s[1]) NOT IN ('sponsors','features','about','pricing','marketplace','topics','collections','orgs','apps','settings','login','join','explore','search') THEN 'github_repo'
      WHEN host = 'huggingface.co' AND lower(s[1]) = 'datasets' AND len(s) > 1 THEN 'hf_dataset' WHEN host = 'huggingface.co' AND len(s) > 0 AND lower(s[1]) NOT IN ('datasets','spaces','models','docs','blog','join','pricing','settings','api','search','login','new') THEN 'hf_model' END AS artifact_kind FROM m)
    SELECT n, artifact_kind, CASE artifact_kind WHEN 'github_repo' THEN s[1] || '/' || regexp_replace(s[2], '\\.git$', '') WHEN 'hf_dataset' THEN array_to_string(s[2:3], '/') ELSE array_to_string(s[1:2], '/') END AS identifier FROM k WHERE artifact_kind IS NOT NULL""",
    (X.URLS,),
)
def artifacts_parsed(spark, sf):
    return X.URLS.df(spark).select("n", tables.artifact(F.col("url")).alias("a")).where("a IS NOT NULL").select("n", "a.artifact_kind", "a.identifier")


@query("SELECT url, s AS status, coalesce(s >= 200 AND s < 400, false) AS ok FROM (SELECT url, CASE WHEN error IS NULL THEN CASE WHEN head_status IN (403, 405, 501) THEN get_status ELSE head_status END END AS s FROM probes)", (X.PROBES,))
def link_health(spark, sf):
    return tables.link_outcomes(X.PROBES.df(spark)).select("url", "status", "ok")


@query("SELECT artifact_kind, status_code, parseable, CASE WHEN status_code = 404 OR (artifact_kind <> 'github_repo' AND status_code IN (401, 403)) THEN 'terminal_miss' WHEN status_code = 200 AND parseable THEN 'hit' ELSE 'transient_fail' END AS status FROM aprobes", (X.ARTIFACT_PROBES,))
def artifact_health(spark, sf):
    return tables.artifact_outcomes(X.ARTIFACT_PROBES.df(spark)).select("artifact_kind", "status_code", "parseable", "status")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 600 IN (429, 500, 502, 503, 504) THEN 'retry' ELSE 'terminal' END AS outcome FROM lineitem")
def http_outcomes(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", M.http_outcome(F.col("l_partkey") % 600).alias("outcome"))


@query(
    """WITH e AS (SELECT event_id, event_type AS source, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS ord, user_id % 3 <> 0 AS failed, CAST(user_id % 3 = 1 AS INTEGER) AS attempts_over FROM events),
    a AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY ord) AS answers, sum(attempts_over) OVER (PARTITION BY source ORDER BY ord) AS spent FROM e),
    b AS (SELECT *, CASE WHEN failed THEN sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY source, answers ORDER BY ord) ELSE 0 END AS streak FROM a),
    c AS (SELECT *, max(CASE WHEN failed AND (streak >= 5 OR spent >= 8) THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM b)
    SELECT event_id, source, CAST(streak AS BIGINT) AS streak, CAST(spent AS BIGINT) AS spent, coalesce(t, 0) = 1 AS skipped FROM c"""
)
def breaker_replay(spark, sf):
    """A source's events are few against the corpus and order matters, so a window per source is what it takes."""
    order = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    e = read(spark, sf, "events").select("event_id", F.col("event_type").alias("source"), order.alias("ord"), (F.col("user_id") % 3 != 0).alias("failed"), (F.col("user_id") % 3 == 1).cast("int").alias("attempts_over"))
    return tables.replay_breaker(e).select("event_id", "source", F.col("streak").cast("long").alias("streak"), F.col("spent").cast("long").alias("spent"), "skipped")


# ---- keys and text functions over whole tables ----

SLUG = "substr(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80)"


@query(
    f"""SELECT doc_id, 'ta-' || {SLUG.format("CASE WHEN t = '' THEN 'untitled' ELSE t END")} || '-' || substr(sha1(t || '|' || source), 1, 16) AS cache_key, 'v-' || substr(sha1('m' || chr(0) || CAST(doc_id AS VARCHAR) || chr(0) || t || chr(0) || 'x'), 1, 24) AS verification_key
    FROM (SELECT doc_id, source, text AS t FROM documents)"""
)
def document_keys(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("t"))
    return rows.select("doc_id", M.cache_key(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("t"), F.col("source")).alias("cache_key"), M.verification_key(F.lit("m"), F.col("doc_id").cast("string"), F.col("t"), F.lit("x")).alias("verification_key"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'), ' ') AS numbers FROM documents WHERE regexp_matches(text, '\\d')")
def numbers_in_documents(spark, sf):
    return read(spark, sf, "documents").where(F.col("text").rlike(r"\d")).select("doc_id", F.array_join(submission.numbers_of(F.col("text")), " ").alias("numbers"))


@query(f"SELECT doc_id, {SQUEEZE.format('text')} AS flat, {NORM.format('text')} AS norm, CASE WHEN length(text) > 2000 THEN substr(text, 1, 1200) || chr(10) || chr(10) || '[... middle left out ...]' || chr(10) || chr(10) || right(text, 600) ELSE text END AS head_tail FROM documents")
def texts_flattened(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", T.squeeze(t).alias("flat"), M.norm_title(t).alias("norm"), judging.head_and_tail(t, 2000, 1200, 600).alias("head_tail"))


@query(f"SELECT doc_id, {ANONYMOUS.format('text')} AS anonymous, regexp_matches(lower(text), 'imagenet|cifar|mnist|coco|squad|glue|wikitext|librispeech|penn treebank|ptb|wmt|conll|snli|mnli|celeba|svhn') AS dataset, coalesce(list_filter(['lorem', 'moron', 'license'], lambda m: contains(lower(text), m))[1], '') AS marker FROM documents")
def documents_scanned(spark, sf):
    rows = read(spark, sf, "documents").withColumn("placeholder_markers", F.array(*[F.lit(x) for x in ("lorem", "moron", "license")]))
    return rows.select("doc_id", anonymity.is_anonymous(F.col("text")).alias("anonymous"), M.contains_any(F.col("text"), checklist.DATASET_NAMES).alias("dataset"), F.coalesce(submission.marker(F.col("text")), F.lit("")).alias("marker"))


@query(
    """WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM conversations),
    w AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[\\w\\p{L}\\p{N}_]+')) AS b, list_distinct(regexp_extract_all(lower(old), '[\\w\\p{L}\\p{N}_]+')) AS a FROM c WHERE old IS NOT NULL)
    SELECT conv_id, turn, regexp_extract_all(old, '\\d+(?:\\.\\d+)?') <> regexp_extract_all(text, '\\d+(?:\\.\\d+)?') OR (len(list_distinct(list_concat(a, b))) > 0 AND 1 - len(list_intersect(a, b))::DOUBLE / greatest(len(list_distinct(list_concat(a, b))), 1) > 0.2) AS changed FROM w"""
)
def turns_changed(spark, sf):
    rows = read(spark, sf, "conversations").withColumn("old", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("old IS NOT NULL")
    return rows.select("conv_id", "turn", submission.changed(F.col("old"), F.col("text")).alias("changed"))


@query()
def sentences_around_license(spark, sf):
    """The sentence of each mention; the boundary needs look-around, so it is tested against plain Python."""
    rows = read(spark, sf, "documents").select("doc_id", "text", F.posexplode(T.spans(F.col("text"), r"(?i)license")).alias("n", "s"))
    return rows.select("doc_id", "n", T.sentence_around(F.col("text"), F.col("s.start"), F.col("s.end")).alias("sentence"))


@query(
    """WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT source, string_agg('- ' || CAST(doc_id AS VARCHAR), chr(10) ORDER BY k) || CASE WHEN any_value(n) > 30 THEN chr(10) || '- ... and ' || CAST(any_value(n) - 30 AS VARCHAR) || ' more' ELSE '' END AS said FROM d WHERE k <= 30 GROUP BY source"""
)
def longest_of_each_source(spark, sf):
    """The first lines of a list and how many more there are, as prompts get them."""
    rows = read(spark, sf, "documents").select(F.col("source").alias("paper_id"), "doc_id", "n_chars")
    return judging.first_lines(rows, F.concat(F.lit("- "), F.col("doc_id").cast("string")), [F.desc("n_chars"), "doc_id"], judging.FLAGS, "-").withColumnRenamed("paper_id", "source")


# ---- verdicts, coverage, report ----


@query(
    """SELECT paper_id, count(*) AS citations_checked, count(*) FILTER (c = 'resolved') AS resolved, count(*) FILTER (c = 'ghost') AS ghost_unresolved, count(*) FILTER (c = 'res') AS resolution_degraded, count(*) FILTER (c = 'ver') AS verification_degraded,
     count(*) FILTER (abstract_only) AS abstract_only_count, count(*) FILTER (NOT abstract_only AND verdict <> 'target_unavailable') AS fetched_full_text_count, count(*) FILTER (c IN ('res', 'ver')) > 0 AS has_coverage_gap
     FROM (SELECT *, CASE WHEN status = 'degraded' THEN 'res' WHEN verdict = 'verification_unavailable' THEN 'ver' WHEN verdict = 'target_unavailable' THEN 'ghost' ELSE 'resolved' END AS c FROM verdicts) GROUP BY paper_id""",
    (X.VERDICTS,),
)
def coverage_partition(spark, sf):
    return coverage.coverage(X.VERDICTS.df(spark))


@query(
    f"""WITH g AS (SELECT paper_id, ref_id, arg_min(verdict, {SEVERITY.format("verdict")} * 1000 + cite_ord) AS headline, bool_or(verdict IN ('metadata_mismatch', 'target_unavailable')) AS entry_level, count(*) AS n_sites, array_to_string(list(sentence ORDER BY cite_ord), '|') AS sites FROM verdicts v WHERE {PROBLEM.format("")} GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY {SEVERITY.format("headline")}, ref_id) AS INTEGER) AS rank FROM g""",
    (X.VERDICTS,),
)
def citation_groups(spark, sf):
    g = coverage.groups(X.VERDICTS.df(spark))
    return g.withColumn("sites", F.array_join(F.transform("sites", lambda s: s["sentence"]), "|"))


EVENT_VERDICTS = "SELECT CAST(user_id AS VARCHAR) AS paper_id, CAST(event_id % 5 AS VARCHAR) AS ref_id, event_id AS cite_ord, CASE event_type WHEN 'error' THEN 'does_not_support' WHEN 'purchase' THEN 'metadata_mismatch' WHEN 'signup' THEN 'abstract_too_thin' ELSE 'supports' END AS verdict, CAST(NULL AS VARCHAR) AS role, event_id % 2 = 0 AS abstract_only FROM events"


@query(
    f"""WITH v AS ({EVENT_VERDICTS}), g AS (SELECT paper_id, ref_id, arg_min(verdict, CAST({SEVERITY.format("verdict")} AS BIGINT) * 1000000000 + cite_ord) AS headline, bool_or(verdict IN ('metadata_mismatch', 'target_unavailable')) AS entry_level, count(*) AS n_sites FROM v WHERE {PROBLEM.format("")} GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY {SEVERITY.format("headline")}, ref_id) AS INTEGER) AS rank FROM g"""
)
def event_groups(spark, sf):
    """The grouping of flagged citations over a whole table: events as sites, users as papers."""
    kind = F.when(F.col("event_type") == "error", "does_not_support").when(F.col("event_type") == "purchase", "metadata_mismatch").when(F.col("event_type") == "signup", "abstract_too_thin").otherwise("supports")
    none = F.lit(None).cast("string")
    rows = read(spark, sf, "events").select(F.col("user_id").cast("string").alias("paper_id"), (F.col("event_id") % 5).cast("string").alias("ref_id"), F.col("event_id").alias("cite_ord"), kind.alias("verdict"), none.alias("role"), (F.col("event_id") % 2 == 0).alias("abstract_only"), none.alias("rationale"), none.alias("sentence"))
    return coverage.groups(rows).drop("sites")


@query(
    """SELECT source AS paper_id, count(*) AS citations_checked, count(*) FILTER (quality = 1 AND toxic = 0) AS resolved, count(*) FILTER (quality = 1 AND toxic = 1) AS ghost_unresolved, count(*) FILTER (quality = 0) AS resolution_degraded, 0::BIGINT AS verification_degraded,
    count(*) FILTER (lang = 'en') AS abstract_only_count, count(*) FILTER (lang <> 'en' AND toxic = 0) AS fetched_full_text_count, count(*) FILTER (quality = 0) > 0 AS has_coverage_gap FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY source"""
)
def label_coverage(spark, sf):
    """The partition of outcomes over whole tables: labels as verdicts, sources as papers."""
    status, verdict = F.when(F.col("quality") == 0, "degraded").otherwise("resolved"), F.when(F.col("toxic") == 1, "target_unavailable").otherwise("supports")
    rows = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    return coverage.coverage(rows.select(F.col("source").alias("paper_id"), status.alias("status"), verdict.alias("verdict"), (F.col("lang") == "en").alias("abstract_only")))


@query(
    f"""WITH r AS (SELECT paper_id, lower(trim(severity)) AS severity, coalesce(nullif(trim(coalesce(evidence, '')), ''), trim(issue)) AS q FROM review WHERE lower(trim(severity)) IN ('critical', 'major', 'minor') AND trim(issue) <> ''),
    g AS (SELECT paper_id, ref_id, min({SEVERITY.format("verdict")}) AS s FROM verdicts v WHERE {PROBLEM.format("")} GROUP BY ALL),
    u AS (SELECT paper_id, list_position(['critical', 'major', 'minor'], severity) AS rank, q FROM r UNION ALL SELECT paper_id, CASE severity WHEN 'blocker' THEN 1 ELSE 3 END, coalesce(nullif(evidence, ''), detail) FROM points
      UNION ALL SELECT paper_id, CASE WHEN s <= 2 THEN 2 ELSE 3 END, ref_id FROM g),
    k AS (SELECT paper_id, rank, {SQUEEZE.format("lower(q)")} AS key, row_number() OVER () AS i FROM u),
    m AS (SELECT paper_id, CASE WHEN key = '' THEN CAST(i AS VARCHAR) || '#' ELSE key END AS key, min(rank) AS rank FROM k GROUP BY ALL)
    SELECT paper_id, count(*) FILTER (rank = 1) AS critical, count(*) FILTER (rank = 2) AS major, count(*) FILTER (rank = 3) AS minor FROM m GROUP BY paper_id""",
    (X.REVIEW, X.VERDICTS, X.POINTS),
)
def overall_assessment(spark, sf):
    return coverage.assessment(coverage.reviewer_findings(X.REVIEW.df(spark)), X.POINTS.df(spark), coverage.groups(X.VERDICTS.df(spark)))


@query("SELECT paper_id, ref_id, arg_min(decision, reply_ord) FILTER (coalesce(decision, '') <> '') AS decision, avg(try_cast(nullif(regexp_extract(rating, '^\\s*(-?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE)) AS rating_avg, CAST(count(try_cast(nullif(regexp_extract(rating, '^\\s*(-?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE)) AS INTEGER) AS rating_count FROM replies GROUP BY ALL HAVING decision IS NOT NULL OR rating_avg IS NOT NULL", (X.REPLIES,))
def venue_decisions(spark, sf):
    return verification.venue_decisions(X.REPLIES.df(spark))


@query(
    "SELECT source, '# ' || source || chr(10) || string_agg('- ' || CAST(doc_id AS VARCHAR) || ': quality ' || CAST(quality AS VARCHAR), chr(10) ORDER BY doc_id) AS markdown FROM (SELECT source, l.* FROM labels l JOIN documents d ON l.doc_id = d.doc_id) GROUP BY source"
)
def reports_assembled(spark, sf):
    rows = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "source"), "doc_id").withColumnRenamed("source", "paper_id")
    head = report.lines(rows.select("paper_id").distinct(), "title", [0], F.concat(F.lit("# "), F.col("paper_id")))
    body = report.lines(rows, "title", [1, F.col("doc_id")], F.concat(F.lit("- "), F.col("doc_id").cast("string"), F.lit(": quality "), F.col("quality").cast("string")))
    return report.stitch([head, body]).withColumnRenamed("paper_id", "source")


# ---- lint ----


@query(
    f"""WITH g AS (SELECT paper_id, question AS gq, arg_max({ANSWER.format("response")}, item_ord) AS given FROM items WHERE is_gate GROUP BY ALL),
    j AS (SELECT i.*, given, {ANSWER.format("response")} AS ans, {BLANK.format("response")} AS blank FROM items i LEFT JOIN g ON g.paper_id = i.paper_id AND g.gq = i.gate_question),
    p AS (SELECT paper_id, gate_question, count(*) FILTER (NOT blank AND ans IS DISTINCT FROM 'na') AS answered, bool_and(blank) AS all_blank FROM j WHERE gate_question IS NOT NULL GROUP BY ALL)
    SELECT paper_id, item_ord, 'unanswered' AS kind FROM j WHERE blank AND (given IS NULL OR given <> 'no')
    UNION ALL SELECT paper_id, item_ord, 'invalid_response' FROM j WHERE NOT blank AND (given IS NULL OR given <> 'no') AND len(options) > 0 AND ans IS NOT NULL AND NOT list_contains(options, ans)
    UNION ALL SELECT i.paper_id, item_ord, 'gate_inconsistency' FROM items i JOIN p ON p.paper_id = i.paper_id AND p.gate_question = i.question JOIN g ON g.paper_id = i.paper_id AND g.gq = i.question WHERE is_gate AND ((given = 'no' AND answered > 0) OR (given = 'yes' AND all_blank))""",
    (X.ITEMS,),
)
def checklist_consistency(spark, sf):
    rows = checklist.consistency(X.ITEMS.df(spark))
    return rows.select("paper_id", F.get("place", F.lit(1)).alias("item_ord"), "kind")


@query(
    f"SELECT paper_id, item_ord, {ANSWER.format('response')} AS answer, {BLANK.format('response')} AS blank FROM items",
    (X.ITEMS,),
)
def checklist_answers(spark, sf):
    return X.ITEMS.df(spark).select("paper_id", "item_ord", checklist.answer(F.col("response")).alias("answer"), checklist.is_blank(F.col("response")).alias("blank"))


@query(
    """WITH r AS (SELECT p.*, v.* EXCLUDE venue_id FROM papers p JOIN venues v ON p.venue_id = v.venue_id), m AS (SELECT *, list_filter(placeholder_markers, lambda x: contains(lower(coalesce(title, '')), x))[1] AS mt, list_filter(placeholder_markers, lambda x: contains(lower(coalesce(abstract, '')), x))[1] AS ma FROM r)
    SELECT paper_id, 'over_length' AS kind, CASE WHEN references_start_page IS NOT NULL THEN 'blocker' ELSE 'warning' END AS severity FROM m WHERE page_count IS NOT NULL AND coalesce(references_start_page, page_count) > page_limit_technical
    UNION ALL SELECT paper_id, 'placeholder_title', 'blocker' FROM m WHERE trim(coalesce(title, '')) = '' OR mt IS NOT NULL
    UNION ALL SELECT paper_id, 'placeholder_abstract', 'blocker' FROM m WHERE (trim(coalesce(abstract, '')) = '' AND requires_abstract) OR (trim(coalesce(abstract, '')) <> '' AND (ma IS NOT NULL OR len(regexp_split_to_array(trim(abstract), '\\s+')) < min_abstract_words))
    UNION ALL SELECT paper_id, 'changed_abstract', 'blocker' FROM papers WHERE abstract IS NOT NULL AND baseline_abstract IS NOT NULL AND (regexp_extract_all(abstract, '\\d+(?:\\.\\d+)?') <> regexp_extract_all(baseline_abstract, '\\d+(?:\\.\\d+)?')
     OR 1 - len(list_intersect(list_distinct(regexp_extract_all(lower(abstract), '\\w+')), list_distinct(regexp_extract_all(lower(baseline_abstract), '\\w+'))))::DOUBLE / len(list_distinct(list_concat(regexp_extract_all(lower(abstract), '\\w+'), regexp_extract_all(lower(baseline_abstract), '\\w+')))) > 0.2)""",
    (X.PAPERS, X.VENUES),
)
def submission_findings(spark, sf):
    papers = X.PAPERS.df(spark)
    rules = X.VENUES.df(spark).withColumn("references_excluded", F.lit(True)).withColumn("checklist_required", F.lit(True)).withColumn("color_table_macros", F.array().cast("array<string>"))
    ruled = submission.with_rules(papers, rules)
    parts = [submission.length(ruled), submission.title(ruled, True), submission.abstract(ruled), submission.changed_abstract(papers.drop("baseline_abstract"), papers.select("paper_id", "baseline_abstract").where("baseline_abstract IS NOT NULL"))]
    return findings.union(parts).select("paper_id", "kind", "severity")


@query(f"SELECT paper_id, {ANONYMOUS.format('author_block')} AS block_anonymous, {ANONYMOUS.format('acknowledgments')} AS thanks_anonymous FROM papers", (X.PAPERS,))
def anonymous_fields(spark, sf):
    return X.PAPERS.df(spark).select("paper_id", anonymity.is_anonymous(F.col("author_block")).alias("block_anonymous"), anonymity.is_anonymous(F.col("acknowledgments")).alias("thanks_anonymous"))


PLANTED = ". The accuracy of {percent}.5% is ours. Train 600 / val 100 / test 100 of {total} samples in total."


@query(
    """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS paper_id, 60 + doc_id % 90 AS percent, 800 + 50 * (doc_id % 3) AS total FROM documents)
    SELECT paper_id, 'bounded_metric' AS kind, 'a accuracy of ' || percent || '.5% is above 100%; check the number' AS detail FROM d WHERE percent >= 100
    UNION ALL SELECT paper_id, 'split_mismatch', 'train+val+test = 600+100+100 = 800, but the total is said to be ' || total FROM d WHERE total > 800"""
)
def numeric_findings_in_documents(spark, sf):
    """The number detectors over every text, each with a sentence added whose numbers follow its id: those that cannot be are found, and nothing else in the texts is."""
    head, rest = PLANTED.split("{percent}")
    middle, tail = rest.split("{total}")
    said = F.concat(F.lit(head), (60 + F.col("doc_id") % 90).cast("string"), F.lit(middle), (800 + 50 * (F.col("doc_id") % 3)).cast("string"), F.lit(tail))
    text = F.concat(F.coalesce("text", F.lit("")), said)
    rows = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), text.alias("body"), text.alias("tex_text"), F.lit(None).cast("string").alias("abstract"))
    return findings.numbered(findings.union([numbers.bounded_metrics(rows), numbers.split_arithmetic(rows), numbers.mean_std(rows)])).select("paper_id", "kind", "detail")


# ---- whole sources ----


@query()
def tex_tables(spark, sf):
    """Sources to references, citations, links and broken references: grammar that SQL has no words for; tested."""
    m = sources.manuscripts(spark)
    papers, refs = tex.papers(m), tex.refs(m)
    cites = tex.citations(papers)
    row = lambda df, kind, a, b: df.select("paper_id", F.lit(kind).alias("kind"), F.col(a).alias("key"), F.col(b).cast("string").alias("said"))
    return findings.union([row(papers, "paper", "title", "abstract"), row(refs, "ref", "ref_id", "title"), row(cites, "citation", "ref_id", "sentence"), row(tex.broken_refs(m), "broken", "target", "surrounding"), row(tex.links(m, refs), "link", "source", "url")])


@query()
def page_tables(spark, sf):
    m = sources.page_manuscripts(spark)
    papers, refs = pages.papers(m), X.REFS.df(spark)
    row = lambda df, kind, a, b: df.select("paper_id", F.lit(kind).alias("kind"), F.col(a).cast("string").alias("key"), F.col(b).cast("string").alias("said"))
    return findings.union([row(papers, "paper", "title", "references_start_page"), row(pages.numeric_citations(papers, sources.numbered_refs(spark)), "numeric", "ref_id", "sentence"), row(pages.author_year_citations(papers, refs), "author_year", "ref_id", "sentence")])


@query(sources.RESOLVED_SQL)
def references_resolved(spark, sf):
    """From entries to decisions over recorded answers of the sources: look-ups, payloads, candidates, retractions, published versions."""
    out = lookups.resolve_all(sources.recorded_refs(spark), lookups.recorded(sources.recorded_answers(spark)))["resolutions"]
    return out.select("paper_id", "ref_id", "status", "record.source", "record.doi", F.col("match_note").isNotNull().alias("is_weak"), "is_retracted", F.col("published_version.venue").alias("published_in"), F.size("near_misses").alias("n_near"))


@query(
    r"""WITH j AS (SELECT n, source, payload, CASE WHEN source <> 'arxiv' THEN CAST(payload AS JSON) END AS p FROM payloads),
x AS (SELECT n, source, regexp_replace(regexp_extract(payload, '<id>(.*?)</id>', 1), '\s+', ' ', 'g') AS id, payload FROM j WHERE source = 'arxiv')
SELECT n, source, coalesce(p->>'$.title[0]', '') AS title,
  array_to_string(list_filter(list_transform(coalesce(CAST(p->'$.author' AS JSON[]), []), lambda a: trim(coalesce(a->>'$.given', '') || ' ' || coalesce(a->>'$.family', ''))), lambda s: s <> ''), '; ') AS authors,
  CAST(p->>'$.issued."date-parts"[0][0]' AS INTEGER) AS year, coalesce(p->>'$."container-title"[0]', p->>'$.publisher') AS venue, lower(p->>'$.DOI') AS doi, 'https://doi.org/' || (p->>'$.DOI') AS url, regexp_replace(p->>'$.abstract', '<[^>]+>', '', 'g') AS abstract FROM j WHERE source = 'crossref'
UNION ALL SELECT n, source, p->>'$.title', array_to_string(list_filter(list_transform(coalesce(CAST(p->'$.authors' AS JSON[]), []), lambda a: a->>'$.name'), lambda s: s <> ''), '; '), CAST(p->>'$.year' AS INTEGER), p->>'$.venue', lower(p->>'$.externalIds.DOI'), coalesce('https://doi.org/' || lower(p->>'$.externalIds.DOI'), 'https://arxiv.org/abs/' || lower(p->>'$.externalIds.ArXiv')), p->>'$.abstract' FROM j WHERE source = 'semanticscholar'
UNION ALL SELECT n, source, p->>'$.title', array_to_string(list_transform(coalesce(CAST(p->'$.authorships' AS JSON[]), []), lambda a: a->>'$.author.display_name'), '; '), CAST(p->>'$.publication_year' AS INTEGER), p->>'$.primary_location.source.display_name', lower(replace(p->>'$.doi', 'https://doi.org/', '')), p->>'$.doi',
  (SELECT string_agg(w, ' ' ORDER BY k) FROM (SELECT w, unnest(CAST(p->'$.abstract_inverted_index'->w AS INTEGER[])) AS k FROM (SELECT unnest(json_keys(p->'$.abstract_inverted_index')) AS w))) FROM j WHERE source = 'openalex'
UNION ALL SELECT n, source, regexp_replace(regexp_extract(payload, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g'), array_to_string(regexp_extract_all(payload, '<author><name>(.*?)</name>', 1), '; '), CAST(substr(regexp_extract(payload, '<published>(.*?)</published>', 1), 1, 4) AS INTEGER), 'arXiv', NULL, id, replace(regexp_extract(payload, '<summary>(.*?)</summary>', 1), '&amp;', '&') FROM x WHERE NOT contains(id, '/api/errors')""",
    (sources.PAYLOADS,),
)
def payload_records(spark, sf):
    """Source answers to records: nested JSON and Atom."""
    p = sources.PAYLOADS.df(spark)
    made = F.when(F.col("source") == "crossref", payloads.crossref(F.col("payload"))).when(F.col("source") == "semanticscholar", payloads.semantic_scholar(F.col("payload"))).when(F.col("source") == "openalex", payloads.openalex(F.col("payload"))).otherwise(payloads.arxiv(F.col("payload")))
    return p.select("n", made.alias("r")).where("r IS NOT NULL").select("n", "r.source", "r.title", F.array_join("r.authors", "; ").alias("authors"), "r.year", "r.venue", "r.doi", "r.url", "r.abstract")


@query()
def reviews(spark, sf):
    """A whole run over the sample manuscripts: the findings of every audit."""
    return engine.run(sources.manuscripts(spark))["findings"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unused and never-written references, beside the same question asked of a table: documents that no label speaks of."""
    refs = QUERIES["refs_unused_and_ghost"](spark, sf_dir)
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return refs.unionByName(docs.select(F.lit("documents").alias("paper_id"), F.lit("unlabelled").alias("kind"), F.col("doc_id").cast("string").alias("ref_id")))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
