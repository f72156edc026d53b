"""From TeX and BibTeX sources to tables: papers, refs, citations, broken references, links, unused keys.

All tables are keyed by paper_id, since a reference's key is unique within one paper only, and
carry the places that order-sensitive operators need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import match as M
from vellum.functions import text as T

from . import grammar

# What names authors, and where a bibliography entry keeps its venue and identifiers.
AUTHOR_HEAD = r"(\\author)\b\s*\*?\s*(?:\[[^\]]*\])?\s*"
VENUE_FIELDS = ["journal", "booktitle", "series", "publisher"]
ARXIV_FIELDS = ["eprint", "archiveprefix", "journal", "note", "url"]
RAW_FIELDS = ["author", "title", "journal", "booktitle", "year", "publisher", "doi", "url"]
ARXIV_INLINE = r"(?i)arXiv\s*[:.]?\s*(\d{4}\.\d{4,5})"

author_blocks = grammar.braced(AUTHOR_HEAD)


def papers(manuscripts: DataFrame) -> DataFrame:
    """paper_id, tex_text -> title, abstract, author_block, acknowledgments, section_titles, body."""
    tex = F.coalesce("tex_text", F.lit(""))
    rows = manuscripts.withColumn("authors_found", author_blocks(T.strip_comments(tex)))
    # an \author without an argument hides later ones, as only the first head is looked at
    first = F.regexp_extract(T.strip_comments(tex), AUTHOR_HEAD.replace("(\\\\author)", "(\\\\author)") + r"(\{?)", 2)
    block = F.when(first == "{", F.get("authors_found", F.lit(0))["inner"])
    return rows.select(
        "paper_id",
        "tex_text",
        T.tex_title(tex).alias("title"),
        T.tex_abstract(tex).alias("abstract"),
        T.blank_to_null(T.flatten_tex(block)).alias("author_block"),
        T.tex_acknowledgments(tex).alias("acknowledgments"),
        T.tex_sections(tex).alias("section_titles"),
        T.tex_body(tex).alias("body"),
    )


def bib_authors(s: Column) -> Column:
    """'Last, First and Other Name' -> names with the given name first."""

    def one(raw: Column) -> Column:
        raw = F.regexp_replace(T.strip(raw), r"^,+|,+$", "")
        last, first = F.split_part(raw, F.lit(","), F.lit(1)), F.regexp_replace(raw, r"^[^,]*,", "")
        full = F.when(F.contains(raw, F.lit(",")), T.strip(F.concat(T.strip(first), F.lit(" "), T.strip(last)))).otherwise(raw)
        return F.regexp_replace(full, T.SPACE, " ")

    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), r"(?U)\s+and\s+"), one), lambda x: x != "")


def refs(manuscripts: DataFrame) -> DataFrame:
    """paper_id, bib_text -> a row per entry, in order."""
    rows = manuscripts.select("paper_id", F.posexplode(grammar.parse_bib("bib_text")).alias("ordinal", "e"))
    rows = rows.select("paper_id", "ordinal", F.col("e.key").alias("ref_id"), F.col("e.type").alias("type"), F.transform_values("e.fields", lambda _, v: T.clean_bib_value(v)).alias("f"))
    get = lambda k: T.blank_to_null(F.try_element_at("f", F.lit(k)))
    arxiv = [T.blank_to_null(F.regexp_extract(get(k), ARXIV_INLINE, 1)) for k in ARXIV_FIELDS]
    arxiv.insert(1, F.when(get("eprint").rlike(r"^\d{4}\.\d{4,5}$"), get("eprint")))
    said = F.concat_ws(",\n", F.concat(F.lit("@"), F.col("type"), F.lit("{"), F.col("ref_id")), *[F.concat(F.lit(f"  {k} = {{"), get(k), F.lit("}")) for k in RAW_FIELDS])
    return rows.select(
        "paper_id",
        "ref_id",
        F.concat(said, F.lit("\n}")).alias("raw_text"),
        bib_authors(get("author")).alias("authors"),
        get("title").alias("title"),
        T.blank_to_null(F.regexp_extract(get("year"), r"\d{4}", 0)).cast("int").alias("year"),
        F.coalesce(*[get(k) for k in VENUE_FIELDS]).alias("venue"),
        get("doi").alias("doi"),
        F.coalesce(*arxiv).alias("arxiv_id"),
        get("url").alias("url"),
        "ordinal",
        F.lit(False).alias("is_synthetic"),
    )


def without_marks(sentence: Column) -> Column:
    """A sentence as a reader sees it: no marks, and none of the punctuation they leave behind."""
    return T.squeeze(T.chain(sentence, [(r"\[CITE:[^\]]+\]", ""), (r"(?U)\s*[;,]\s*(?=[;,)]|$)", ""), (r"(?U)\(\s*\)", "")]))


def citations(papers: DataFrame) -> DataFrame:
    """paper_id, body -> a row per mark and key: cite_ord, ref_id, sentence."""
    rows = papers.select("paper_id", "body", F.posexplode(T.spans(F.col("body"), r"\[CITE:([^\]]+)\]")).alias("n", "s"))
    sentence = without_marks(T.sentence_around(F.col("body"), F.col("s.start"), F.col("s.end")))
    keys = F.split(F.regexp_extract("s.match", r"\[CITE:([^\]]+)\]", 1), ",")
    rows = rows.select("paper_id", "n", sentence.alias("sentence"), F.posexplode(F.filter(F.transform(keys, T.strip), lambda k: k != "")).alias("k", "ref_id"))
    order = F.row_number().over(Window.partitionBy("paper_id").orderBy("n", "k")) - 1
    return rows.select("paper_id", order.alias("cite_ord"), "ref_id", "sentence", F.lit(None).cast("string").alias("section"))


def ghosts(citations: DataFrame, refs: DataFrame) -> DataFrame:
    """Keys that are cited but in no bibliography, as references of their own."""
    missing = citations.join(refs.select("paper_id", "ref_id"), ["paper_id", "ref_id"], "left_anti").groupBy("paper_id", "ref_id").agg(F.min("cite_ord").alias("first"))
    none = {c: F.lit(None).cast(t) for c, t in (("title", "string"), ("year", "int"), ("venue", "string"), ("doi", "string"), ("arxiv_id", "string"), ("url", "string"))}
    raw = F.concat(F.lit("(citation key `"), F.col("ref_id"), F.lit("` not present in bibliography)"))
    return missing.select("paper_id", "ref_id", raw.alias("raw_text"), F.array().cast("array<string>").alias("authors"), *[v.alias(c) for c, v in none.items()], (F.col("first") + 1_000_000).alias("ordinal"), F.lit(True).alias("is_synthetic"))


def unused_keys(refs: DataFrame, citations: DataFrame) -> DataFrame:
    return refs.where("NOT is_synthetic").join(citations, ["paper_id", "ref_id"], "left_anti").select("paper_id", "ref_id")


def first_seen(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Of rows with one key the first in order; dropDuplicates would keep any."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_nth", rank).where("_nth = 1").drop("_nth")


def broken_refs(manuscripts: DataFrame) -> DataFrame:
    """References to labels that no source of the paper sets, each (command, target) once, with what stands around."""
    pattern = r"\\(" + "|".join(T.REF_COMMANDS) + r")\s*\{([^{}]+)\}"
    rows = manuscripts.select("paper_id", T.strip_comments(F.coalesce("tex_text", F.lit(""))).alias("t"))
    labels = rows.select("paper_id", F.explode(F.regexp_extract_all("t", F.lit(r"\\label\s*\{([^{}]+)\}"), F.lit(1))).alias("target")).select("paper_id", T.strip(F.col("target")).alias("target")).distinct()
    used = rows.select("paper_id", "t", F.explode(T.spans(F.col("t"), pattern)).alias("s"))
    begin = F.greatest(F.lit(0), F.col("s.start") - 60)
    used = used.select("paper_id", F.col("s.start").alias("at"), F.regexp_extract("s.match", pattern, 1).alias("command"), T.strip(F.regexp_extract("s.match", pattern, 2)).alias("target"), T.squeeze(F.substring("t", begin + 1, F.col("s.end") + 60 - begin)).alias("surrounding"))
    used = used.where("target <> ''").join(labels, ["paper_id", "target"], "left_anti")
    return first_seen(used, ["paper_id", "command", "target"], ["at"]).select("paper_id", "at", "command", "target", "surrounding")


def links(manuscripts: DataFrame, refs: DataFrame) -> DataFrame:
    """URLs of the source and of its bibliography, each once per place it comes from."""
    pattern = r"\\(url|href)\s*\{([^{}]+)\}"
    rows = manuscripts.select("paper_id", F.explode(T.spans(T.strip_comments(F.coalesce("tex_text", F.lit(""))), pattern)).alias("s"))
    tex = rows.select("paper_id", F.lit(0).alias("part"), F.col("s.start").alias("at"), F.concat(F.lit("tex_"), F.regexp_extract("s.match", pattern, 1)).alias("source"), M.normalize_url(F.regexp_extract("s.match", pattern, 2)).alias("url"), F.lit(None).cast("string").alias("bibkey"))
    bib = refs.select("paper_id", F.lit(1).alias("part"), F.col("ordinal").alias("at"), F.lit("bib_url").alias("source"), M.normalize_url(F.col("url")).alias("url"), F.col("ref_id").alias("bibkey"))
    return first_seen(tex.unionByName(bib).where("url IS NOT NULL"), ["paper_id", "source", "url", "bibkey"], ["part", "at"])
