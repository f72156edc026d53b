"""Which published work an entry means: candidates from the sources, gated, ranked and decided in three states.

responses: what each source answered to each look-up (paper_id, ref_id, mode id|search, source, tag
ok|terminal|transient). candidates: the records in those answers (paper_id, ref_id, mode, source,
item_rank, title, authors, year, venue, doi, ...). Acceptance depends on the citing entry, so it is
decided per (paper_id, ref_id), never shared by look-up key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import match as M
from vellum.functions import text as T

from . import linkage

KEY = ["paper_id", "ref_id"]
# The order of sources and phases, and the record types that count as published.
SOURCES = ["crossref", "semanticscholar", "arxiv", "openalex"]
MODES = ["id", "search"]
CROSSREF_PUBLISHED = ["journal-article", "proceedings-article", "book-chapter"]
DBLP_PUBLISHED = ["Conference and Workshop Papers", "Journal Articles", "Parts in Books or Collections"]
UNKNOWN_GAP = 10_000


def step(mode: str = "mode", source: str = "source") -> Column:
    """Place in the order in which sources are asked: all look-ups by identifier before any search."""
    number = lambda names, c: F.array_position(F.array(*[F.lit(x) for x in names]), F.col(c)) - 1
    return number(MODES, mode) * len(SOURCES) + number(SOURCES, source)


def triage(refs: DataFrame, candidates: DataFrame) -> DataFrame:
    """class of each candidate: strong, weak (title and authors, other year), near_miss (title only); others go. A hit by identifier is strong as it is."""
    c = candidates.select(*KEY, "mode", "source", "item_rank", F.struct("source", *[x for x in candidates.columns if x not in (*KEY, "mode", "source", "item_rank")]).alias("record"))
    r = refs.select(*KEY, F.col("title").alias("r_title"), F.col("authors").alias("r_authors"), F.col("year").alias("r_year"))
    rows = c.join(r, KEY).withColumn("step", step())
    title = M.title_like(F.col("r_title"), F.col("record.title"))
    kind = F.when(F.col("mode") == "id", "strong").when(~title, None).when(M.year_compatible(F.col("r_year"), F.col("record.year")), "strong")
    kind = kind.when(M.surnames_overlap(F.col("r_authors"), F.col("record.authors")), "weak").otherwise("near_miss")
    rows = rows.withColumn("class", kind).where("class IS NOT NULL")
    # a source goes through its list until something is strong: what follows is never seen
    first = F.min(F.when(F.col("class") == "strong", F.col("item_rank"))).over(Window.partitionBy(*KEY, "step"))
    return rows.withColumn("first", first).where("first IS NULL OR item_rank <= first").drop("first")


def describe(record: Column) -> Column:
    doi = F.coalesce(F.concat(F.lit(", doi:"), T.blank_to_null(record["doi"])), F.lit(""))
    return F.concat(F.lit('"'), record["title"], F.lit('" ('), F.coalesce(record["year"].cast("string"), F.lit("no year")), F.lit(", "), F.coalesce(T.blank_to_null(record["venue"]), record["source"]), doi, F.lit(")"))


def resolve(refs: DataFrame, responses: DataFrame, candidates: DataFrame, never_asked: str = "degraded") -> DataFrame:
    """paper_id, ref_id, status, record, match_note, near_misses.

    The first strong hit ends the asking, so nothing after it counts. Without one, a transient
    failure leaves the entry degraded, and a weak match is not taken over it. never_asked: what an entry is
    that has something to look up and no response at all, 'degraded' or 'unresolved'.
    """
    seen = triage(refs, candidates)
    strong = seen.where("class = 'strong'").groupBy(*KEY).agg(F.min_by("record", F.struct("step", "item_rank")).alias("strong"), F.min("step").alias("stop"))
    asked = responses.withColumn("step", step()).join(strong.select(*KEY, "stop"), KEY, "left").where("stop IS NULL OR step < stop")
    failed = asked.groupBy(*KEY).agg(F.bool_or(F.col("tag") == "transient").alias("transient"))
    rest = seen.where("class <> 'strong'")
    gap = F.coalesce(F.abs(F.col("record.year") - F.col("r_year")), F.lit(UNKNOWN_GAP))
    weak = rest.where("class = 'weak'").groupBy(*KEY).agg(F.min_by("record", F.struct(gap, "step", "item_rank")).alias("weak"))
    near = rest.where("class = 'near_miss'").groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "item_rank", describe(F.col("record")).alias("said")))), lambda x: x["said"]).alias("near"))
    rows = refs.select(*KEY, "year", *[c for c in ("doi", "arxiv_id", "title") if c in refs.columns]).join(strong, KEY, "left").join(failed, KEY, "left").join(weak, KEY, "left").join(near, KEY, "left")
    # an entry with something to look up that no source was asked about is not known to be absent
    can_ask = T.blank_to_null(F.coalesce(*[F.col(c) for c in ("doi", "arxiv_id", "title") if c in refs.columns])).isNotNull()
    is_strong, is_transient, is_weak = F.col("strong").isNotNull(), F.coalesce("transient", can_ask & F.lit(never_asked == "degraded")), F.col("weak").isNotNull()
    year = lambda c: F.coalesce(c.cast("string"), F.lit("(no year)"))
    venue = F.coalesce(F.concat(F.lit(" ("), T.blank_to_null(F.col("weak.venue")), F.lit(")")), F.lit(""))
    note = F.concat(F.lit("Matched by title and surnames only: the bibliography says "), year(F.col("year")), F.lit(", the record "), year(F.col("weak.year")), venue, F.lit(". No source had a record of a fitting year; check that this is the work meant."))
    status = F.when(is_strong, "resolved").when(is_transient, "degraded").when(is_weak, "resolved").otherwise("unresolved")
    only_weak = ~is_strong & ~is_transient & is_weak
    return rows.select(*KEY, status.alias("status"), F.when(is_strong, F.col("strong")).when(only_weak, F.col("weak")).alias("record"), F.when(only_weak, note).alias("match_note"), F.when(is_strong | only_weak, F.array().cast("array<string>")).otherwise(F.coalesce("near", F.array().cast("array<string>"))).alias("near_misses"))


def with_retractions(resolutions: DataFrame, retracted: DataFrame) -> DataFrame:
    """retracted: doi, is_retracted. Asked for resolved records that are not retracted and come from elsewhere than OpenAlex."""
    flags = retracted.where("is_retracted").select(F.lower("doi").alias("x_doi")).distinct()
    rows = resolutions.join(flags, F.lower("record.doi") == F.col("x_doi"), "left")
    known = F.coalesce("record.is_retracted", F.lit(False)) | ((F.col("record.source") != "openalex") & F.col("x_doi").isNotNull())
    return rows.withColumn("is_retracted", F.coalesce(known, F.lit(False))).drop("x_doi")


def not_arxiv(doi: Column) -> Column:
    """A publisher's DOI, or null."""
    return F.when(~doi.startswith(M.DATACITE_ARXIV), T.blank_to_null(doi))


def not_preprint_venue(venue: Column) -> Column:
    return F.when(~venue.rlike(M.ARXIV_VENUE), T.blank_to_null(venue))


def published_by_record(record: Column, match_note: Column) -> Column:
    """A strong Crossref or OpenAlex record with a publisher's DOI and venue is the published version itself."""
    fits = match_note.isNull() & record["source"].isin("crossref", "openalex") & not_arxiv(record["doi"]).isNotNull() & not_preprint_venue(record["venue"]).isNotNull()
    return F.when(fits, F.struct(record["venue"].alias("venue"), record["year"].alias("year"), record["doi"].alias("doi"), F.concat(F.lit("https://doi.org/"), record["doi"]).alias("url"), record["source"].alias("source")))


def published_by_search(wanted: DataFrame, found: DataFrame, source: str) -> DataFrame:
    """The first gated hit of a title search. wanted: KEY, title, authors, year; found: KEY, item_rank, type, title, authors, year, venue, doi, url."""
    types = {"crossref": CROSSREF_PUBLISHED, "dblp": DBLP_PUBLISHED}[source]
    f = found.select(*KEY, "item_rank", "type", F.col("title").alias("f_title"), F.col("authors").alias("f_authors"), F.col("year").alias("f_year"), "venue", "doi", "url")
    rows = f.join(wanted, KEY).where(F.col("type").isin(types) & not_preprint_venue(F.col("venue")).isNotNull())
    rows = rows.where(M.title_like(F.col("title"), F.col("f_title")) & M.year_compatible(F.col("year"), F.col("f_year")) & M.surnames_overlap(F.col("authors"), F.col("f_authors")))
    doi = not_arxiv(F.lower("doi"))
    rows = rows.where(doi.isNotNull()) if source == "crossref" else rows
    url = F.coalesce(F.concat(F.lit("https://doi.org/"), doi), F.col("url"))
    version = F.struct("venue", F.col("f_year").alias("year"), doi.alias("doi"), url.alias("url"), F.lit(source).alias("source"))
    return rows.groupBy(*KEY).agg(F.min_by(version, "item_rank").alias(source))


def published_version(rows: DataFrame) -> DataFrame:
    """The waterfall, over rows with checked, cites_arxiv, by_record, s2_tag, s2, dblp_tag, dblp, crossref_tag, crossref.

    Adds published_version, published_version_checked and unchecked_now (could not tell this time).
    Semantic Scholar's answer decides unless DBLP knows better; Crossref is only asked where it gave none.
    """
    ask = ~F.col("checked") & F.col("cites_arxiv")
    answered = F.col("s2_tag").isin("ok", "terminal")
    found = F.coalesce("by_record", "s2", "dblp", F.when(~answered, F.col("crossref")))
    transient = (F.col("s2_tag") == "transient") | (F.col("dblp_tag") == "transient") | (F.col("crossref_tag") == "transient")
    rows = rows.withColumn("published_version", F.when(ask, found))
    rows = rows.withColumn("published_version_checked", F.col("checked") | (ask & (found.isNotNull() | answered)))
    return rows.withColumn("unchecked_now", ask & ~F.col("published_version_checked") & transient)


def token_set(title: Column) -> Column:
    return F.array_sort(F.array_distinct(F.split(M.norm_title(title), " ")))


def title_classes(titles: DataFrame) -> DataFrame:
    """id, title -> class_id, id: titles with one set of tokens, by the least id; those without tokens are left out."""
    rows = titles.select("id", token_set(F.col("title")).alias("w")).where("w <> array('')")
    first = rows.groupBy("w").agg(F.min("id").alias("class_id"))
    return rows.join(first, "w").select("class_id", "id")


def linked_titles(titles: DataFrame, threshold: float = M.TITLE_JACCARD) -> DataFrame:
    """id, title -> l_id, r_id of classes that match, each pair once; copies are told by title_classes and never paired."""
    return linkage.linked_sets(titles, threshold)


def fuzzy_pairs(left: DataFrame, right: DataFrame, threshold: float = M.TITLE_JACCARD, only: Column | None = None) -> DataFrame:
    """l_id, r_id of titles that match, for a corpus of our own: (id, title) on both sides, joined on rare words. only: which pairs of l_id and r_id are asked for.

    Two token sets with a Jaccard of at least t share one of the rarest |a| - ceil(t |a|) + 1 tokens of
    either, so prefixes in the order of rarity lose nothing. The place of that token bounds what the
    two can have in common; pairs below what t needs go before anything is compared, and the
    rest meet their token sets by id. Ties of rarity are broken by the token itself.
    """
    words = lambda df: df.select("id", F.array_distinct(F.split(M.norm_title(F.col("title")), " ")).alias("w")).where("w <> array('')")
    a, b = words(left), words(right)
    tokens = a.select(F.explode("w").alias("t")).unionAll(b.select(F.explode("w").alias("t")))
    rarity = tokens.groupBy("t").count()

    def prefix(df: DataFrame, side: str) -> DataFrame:
        each = df.select("id", F.size("w").alias("n"), F.explode("w").alias("t")).join(rarity, "t")
        order = F.row_number().over(Window.partitionBy("id").orderBy("count", "t"))
        each = each.withColumn("k", order).where(F.col("k") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1)
        return each.select("t", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "n", "k")])

    most = 1 + F.least(F.col("l_n") - F.col("l_k"), F.col("r_n") - F.col("r_k"))
    needed = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("l_n") + F.col("r_n")) - 1e-9)
    near = (F.col("l_n") >= F.lit(threshold) * F.col("r_n") - 1e-9) & (F.col("r_n") >= F.lit(threshold) * F.col("l_n") - 1e-9)
    pairs = prefix(a, "l").join(prefix(b, "r"), "t").where(near & (most >= needed) & (F.lit(True) if only is None else only)).groupBy("l_id", "r_id").agg(F.min("t"))
    pairs = pairs.join(a.select(F.col("id").alias("l_id"), F.col("w").alias("x")), "l_id").join(b.select(F.col("id").alias("r_id"), F.col("w").alias("y")), "r_id")
    common = F.size(F.array_intersect("x", "y"))
    return pairs.where(common >= F.lit(threshold) * (F.size("x") + F.size("y") - common) - 1e-9).select("l_id", "r_id")
