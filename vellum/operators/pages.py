"""From page texts to tables: title, abstract, body and bibliography, and citations by number or by author and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import match as M
from vellum.functions import text as T

# The shapes of citations in running text.
NUMERIC = r"\[(\d+(?:\s*[,–\-]\s*\d+)*)\]"
NAME = r"[A-Z][\w\-']+"
ONE_CITE = rf"{NAME}(?:\s+(?:and|&|et\s+al\.?)\s+{NAME})?(?:\s+et\s+al\.?)?\s*[,;]?\s*\d{{4}}[a-z]?"
PARENTHETICAL = rf"(?U)\(({ONE_CITE}(?:\s*[;,]\s*{ONE_CITE})*)\)"
INLINE = rf"(?U)\b({NAME}(?:\s+(?:and|&)\s+{NAME}|\s+et\s+al\.?)?)\s*\((\d{{4}}[a-z]?)\)"
NAME_AND_YEAR = rf"(?U)^({NAME})(?:\s+(?:and|&)\s+{NAME}|\s+et\s+al\.?)?\s*[,;]?\s*(\d{{4}})"


def papers(manuscripts: DataFrame) -> DataFrame:
    """paper_id, pages -> title, abstract, body, references_text, page_count, references_start_page."""
    rows = manuscripts.withColumn("t", T.join_pages(F.coalesce("pages", F.array())))
    cut = T.split_references(F.col("t"))
    return rows.select("paper_id", T.page_title(F.col("t")).alias("title"), T.page_abstract(F.col("t")).alias("abstract"), cut["body"].alias("body"), cut["references"].alias("references_text"), F.size(F.coalesce("pages", F.array())).alias("page_count"), T.references_page(F.col("pages")).alias("references_start_page"))


def _ordered(rows: DataFrame) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("paper_id").orderBy("part", "at", "k")) - 1
    return rows.select("paper_id", order.alias("cite_ord"), "ref_id", "sentence")


def numeric_citations(papers: DataFrame, refs: DataFrame) -> DataFrame:
    rows = papers.select("paper_id", "body", F.explode(T.spans(F.col("body"), NUMERIC)).alias("s"))
    sentence = T.sentence_around(F.col("body"), F.col("s.start"), F.col("s.end"))
    rows = rows.select("paper_id", F.lit(0).alias("part"), F.col("s.start").alias("at"), sentence.alias("sentence"), F.posexplode(T.expand_numbers(F.regexp_extract("s.match", NUMERIC, 1))).alias("k", "ref_id"))
    return _ordered(rows.join(refs.select("paper_id", "ref_id"), ["paper_id", "ref_id"]))


def author_year_citations(papers: DataFrame, refs: DataFrame) -> DataFrame:
    """Cites in brackets first, then those in the sentence. Of entries with one surname and year the last is meant."""
    first = F.get("authors", F.lit(0))
    known = refs.where(first.isNotNull() & F.col("year").isNotNull()).select("paper_id", M.surname(first).alias("name"), "year", "ref_id", "ordinal").where("name <> ''")
    known = known.groupBy("paper_id", "name", "year").agg(F.max_by("ref_id", "ordinal").alias("ref_id"))

    def found(pattern: str, part: int, cites) -> DataFrame:
        rows = papers.select("paper_id", "body", F.explode(T.spans(F.col("body"), pattern)).alias("s"))
        sentence = T.sentence_around(F.col("body"), F.col("s.start"), F.col("s.end"))
        return rows.select("paper_id", F.lit(part).alias("part"), F.col("s.start").alias("at"), sentence.alias("sentence"), F.posexplode(cites(F.col("s.match"))).alias("k", "cite"))

    def cluster(m: Column) -> Column:
        return F.filter(F.transform(F.split(F.regexp_extract(m, PARENTHETICAL, 1), r"\s*;\s*"), T.strip), lambda c: c != "")

    rows = found(PARENTHETICAL, 0, cluster).unionByName(found(INLINE, 1, lambda m: F.array(F.concat(F.regexp_extract(m, INLINE, 1), F.lit(", "), F.regexp_extract(m, INLINE, 2)))))
    rows = rows.withColumn("name", F.lower(F.regexp_extract("cite", NAME_AND_YEAR, 1))).withColumn("year", F.regexp_extract("cite", NAME_AND_YEAR, 2).try_cast("int"))
    return _ordered(rows.join(known, ["paper_id", "name", "year"]))


def grounded_entries(entries: DataFrame, source: str = "references_text") -> DataFrame:
    """Entries that a model read off a bibliography, less those whose first 80 characters do not stand in it."""
    head = F.substring(T.squeeze(F.col("raw_text")), 1, 80)
    return entries.where((head != "") & F.contains(T.squeeze(F.col(source)), head))
