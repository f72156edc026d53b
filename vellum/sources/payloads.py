"""Records out of what the sources answer: JSON and Atom payloads as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import match as M
from vellum.functions import text as T

PERSON = "struct<given:string,family:string>"
CROSSREF = f"struct<DOI:string,URL:string,title:array<string>,author:array<{PERSON}>,issued:struct<`date-parts`:array<array<int>>>,`container-title`:string,publisher:string,abstract:string,type:string>"
S2 = "struct<title:string,year:int,abstract:string,venue:string,externalIds:map<string,string>,authors:array<struct<name:string>>,openAccessPdf:struct<url:string>,publicationVenue:struct<name:string,type:string>>"
OPENALEX = "struct<id:string,title:string,display_name:string,authorships:array<struct<author:struct<display_name:string>>>,publication_year:int,doi:string,abstract_inverted_index:map<string,array<int>>,primary_location:struct<source:struct<display_name:string>>,open_access:struct<oa_url:string>,is_retracted:boolean>"
DBLP_INFO = "struct<title:string,year:string,venue:string,type:string,doi:string,ee:string,url:string,authors:struct<author:string>>"


def record(source: str, **fields: Column) -> Column:
    kinds = {"title": "string", "authors": "array<string>", "year": "int", "venue": "string", "doi": "string", "url": "string", "abstract": "string", "open_access_pdf_url": "string", "is_retracted": "boolean"}
    return F.struct(F.lit(source).alias("source"), *[fields.get(k, F.lit(False if k == "is_retracted" else None)).cast(t).alias(k) for k, t in kinds.items()])


def _at_doi(doi: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), doi)


def listed(json: Column) -> Column:
    """The first of a JSON list, or the string itself."""
    return F.coalesce(F.get(F.from_json(json, "array<string>"), F.lit(0)), F.when(~json.startswith("["), json))


def crossref(json: Column) -> Column:
    m = F.from_json(json, CROSSREF)
    names = F.filter(F.transform(F.coalesce(m["author"], F.array()), lambda a: T.strip(F.concat_ws(" ", F.coalesce(a["given"], F.lit("")), F.coalesce(a["family"], F.lit(""))))), lambda n: n != "")
    year = F.get(F.get(m["issued"]["date-parts"], F.lit(0)), F.lit(0))
    venue = F.coalesce(T.blank_to_null(listed(m["container-title"])), T.blank_to_null(listed(m["publisher"])))
    abstract = T.blank_to_null(T.strip(F.regexp_replace(m["abstract"], "<[^>]+>", "")))
    return F.when(m.isNotNull(), record("crossref", title=F.coalesce(F.get(m["title"], F.lit(0)), F.lit("")), authors=names, year=F.nullif(year, F.lit(0)), venue=venue, doi=F.lower(m["DOI"]), url=F.coalesce(_at_doi(m["DOI"]), m["URL"]), abstract=abstract))


def s2_ids(m: Column) -> tuple[Column, Column]:
    ids = m["externalIds"]
    get = lambda *k: F.coalesce(*[F.try_element_at(ids, F.lit(x)) for x in k])
    return F.lower(get("DOI", "doi")), get("ArXiv", "arxiv")


def semantic_scholar(json: Column) -> Column:
    m = F.from_json(json, S2)
    doi, arxiv = s2_ids(m)
    names = F.filter(F.transform(F.coalesce(m["authors"], F.array()), lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    url = F.coalesce(_at_doi(doi), F.concat(F.lit("https://arxiv.org/abs/"), arxiv))
    return F.when(m.isNotNull(), record("semanticscholar", title=F.coalesce(m["title"], F.lit("")), authors=names, year=m["year"], venue=m["venue"], doi=doi, url=url, abstract=m["abstract"], open_access_pdf_url=m["openAccessPdf"]["url"]))


def s2_published(json: Column) -> Column:
    """A publisher's DOI, a DBLP key that is not CoRR's, or a typed venue that is not arXiv; null if none of them."""
    m = F.from_json(json, S2)
    doi, _ = s2_ids(m)
    doi = F.when(~doi.startswith(M.DATACITE_ARXIV), T.blank_to_null(doi))
    dblp = T.blank_to_null(F.try_element_at(m["externalIds"], F.lit("DBLP")))
    in_dblp = F.coalesce(~dblp.startswith("journals/corr/"), F.lit(False))
    venue = F.coalesce(T.blank_to_null(m["publicationVenue"]["name"]), T.blank_to_null(m["venue"]))
    venue = F.when(~venue.rlike(M.ARXIV_VENUE), venue)
    typed = venue.isNotNull() & F.coalesce(F.lower(m["publicationVenue"]["type"]).isin("conference", "journal"), F.lit(False))
    return F.when(doi.isNotNull() | in_dblp | typed, F.struct(venue.alias("venue"), m["year"].alias("year"), doi.alias("doi"), _at_doi(doi).alias("url"), F.lit("semanticscholar").alias("source")))


def inverted_abstract(index: Column) -> Column:
    """{word: [positions]} -> the words in order."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("i"), e["key"].alias("w")))))
    return T.blank_to_null(F.array_join(F.transform(F.array_sort(places), lambda p: p["w"]), " "))


def openalex(json: Column) -> Column:
    m = F.from_json(json, OPENALEX)
    names = F.filter(F.transform(F.coalesce(m["authorships"], F.array()), lambda a: a["author"]["display_name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    doi = T.blank_to_null(F.lower(F.replace(m["doi"], F.lit("https://doi.org/"), F.lit(""))))
    title = F.coalesce(T.blank_to_null(m["title"]), T.blank_to_null(m["display_name"]), F.lit(""))
    return F.when(m.isNotNull(), record("openalex", title=title, authors=names, year=m["publication_year"], venue=m["primary_location"]["source"]["display_name"], doi=doi, url=F.coalesce(T.blank_to_null(m["doi"]), m["id"]), abstract=inverted_abstract(m["abstract_inverted_index"]), open_access_pdf_url=m["open_access"]["oa_url"], is_retracted=F.coalesce(m["is_retracted"], F.lit(False))))


def dblp_authors(json: Column) -> Column:
    """authors.author is an object for one author and a list for more; numbers that tell namesakes apart go."""
    one = F.get_json_object(json, "$.text")
    many = F.from_json(json, "array<struct<text:string>>")
    plain = F.from_json(json, "array<string>")
    names = F.when(json.startswith("["), F.coalesce(F.when(F.forall(many, lambda a: a["text"].isNotNull()), F.transform(many, lambda a: a["text"])), plain)).when(json.startswith("{"), F.array(one)).otherwise(F.array(json))
    return F.transform(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""), lambda n: F.regexp_replace(T.strip(n), r"\s+\d{4}$", ""))


def dblp(json: Column) -> Column:
    m = F.from_json(json, DBLP_INFO)
    venue = F.coalesce(F.array_join(F.filter(F.from_json(m["venue"], "array<string>"), lambda v: v != ""), ", "), m["venue"])
    return F.when(m.isNotNull(), F.struct(m["type"].alias("type"), m["title"].alias("title"), dblp_authors(m["authors"]["author"]).alias("authors"), F.substring(m["year"], 1, 4).try_cast("int").alias("year"), venue.alias("venue"), F.lower(m["doi"]).alias("doi"), F.coalesce(m["ee"], m["url"]).alias("url")))


def arxiv_entries(feed: Column) -> Column:
    """The entries of an Atom feed, each as XML."""
    return F.regexp_extract_all(feed, F.lit(r"(?s)<entry\b.*?</entry>"), F.lit(0))


def well_formed(xml: Column) -> Column:
    return F.from_xml(xml, "a int, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNull()


def arxiv(entry: Column) -> Column:
    """One Atom entry; an unknown id is answered by an entry that is an error, which is no record."""
    tag = lambda name: T.blank_to_null(T.squeeze(F.replace(F.replace(F.regexp_extract(entry, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))))
    at = tag("id")
    names = F.filter(F.transform(F.regexp_extract_all(entry, F.lit(r"(?s)<author(?:\s[^>]*)?>.*?<name>(.*?)</name>"), F.lit(1)), T.strip), lambda n: n != "")
    pdf = F.get(F.filter(F.regexp_extract_all(entry, F.lit(r"<link\b[^>]*>"), F.lit(0)), lambda x: x.rlike(r"""title=["']pdf["']""")), F.lit(0))
    doi = F.lower(tag("arxiv:doi"))
    fits = ~F.contains(F.coalesce(at, F.lit("")), F.lit("/api/errors")) & tag("title").isNotNull()
    return F.when(fits, record("arxiv", title=tag("title"), authors=names, year=F.substring(tag("published"), 1, 4).try_cast("int"), venue=F.lit("arXiv"), doi=doi, url=at, abstract=tag("summary"), open_access_pdf_url=T.blank_to_null(F.regexp_extract(pdf, r"""href=["']([^"']*)["']""", 1))))


def arxiv_published(entry: Column) -> Column:
    """A venue's DOI that the authors registered with arXiv."""
    doi = F.lower(T.blank_to_null(T.squeeze(F.regexp_extract(entry, r"(?s)<arxiv:doi[^>]*>(.*?)</arxiv:doi>", 1))))
    ref = T.blank_to_null(T.squeeze(F.regexp_extract(entry, r"(?s)<arxiv:journal_ref[^>]*>(.*?)</arxiv:journal_ref>", 1)))
    return F.when(~doi.startswith(M.DATACITE_ARXIV), F.struct(ref.alias("venue"), F.lit(None).cast("int").alias("year"), doi.alias("doi"), _at_doi(doi).alias("url"), F.lit("arxiv").alias("source")))


def loose_json(text: Column) -> Column:
    """JSON that a model wrote: the whole answer, else its first fenced block, else from the first brace to the last, else brackets; null if none parses."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    cut = lambda a, b: F.regexp_extract(text, rf"(?s)(\{a}.*\{b})", 1)
    fits = lambda j: F.when(F.try_parse_json(j).isNotNull() & (T.strip(j) != ""), T.strip(j))
    return F.coalesce(fits(text), fits(fence), fits(cut("{", "}")), fits(cut("[", "]")))
