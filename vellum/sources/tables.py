"""Reading manuscripts, storing and looking up what was fetched, writing reviews."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as T


def _decode(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


def decode_utf8(raw: Column) -> Column:
    """Bad bytes are replaced; decode() would fail on them."""
    return F.pandas_udf(_decode, "string")(raw)


def read_texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, text of the files under a folder whose names match a glob."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", decode_utf8("content").alias("text"))


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


# Where a bibliography or a checklist is looked for when the source names none.
DEFAULT_BIBS = ["references.bib", "main.bib", "bibliography.bib", "refs.bib"]
CHECKLIST = "ReproducibilityChecklist.tex"


def _first_existing(sources: DataFrame, names: Column, files: DataFrame, out: str) -> DataFrame:
    """path of each source -> the first of its candidate names that exists in its folder."""
    asked = sources.select("path", F.posexplode(names).alias("k", "name")).select("path", "k", F.concat(folder(F.col("path")), F.lit("/"), F.col("name")).alias("wanted"))
    found = asked.join(files.select(F.col("path").alias("wanted")), "wanted")
    return found.groupBy("path").agg(F.min_by("wanted", "k").alias(out))


def with_suffix(name: Column, suffix: str, append: bool) -> Column:
    """Ends in the suffix: put in place of another one, or appended."""
    other = name if append else F.regexp_replace(name, r"(?<=[^/.])\.[^./]*$", "")
    return F.when(F.lower(name).endswith(suffix), name).otherwise(F.concat(other, F.lit(suffix)))


def find_bibs(sources: DataFrame, files: DataFrame) -> DataFrame:
    """path, text of TeX sources; path of bib files -> path, bib_path. Named resources first, in order, then the usual names."""
    named = [F.split(F.array_join(F.regexp_extract_all("text", F.lit(rf"\\{c}\s*\{{([^{{}}]+)\}}"), F.lit(1)), ","), ",") for c in ("addbibresource", "bibliography")]
    names = F.filter(F.transform(F.concat(*named), T.strip), lambda n: n != "")
    names = F.concat(F.transform(names, lambda n: with_suffix(n, ".bib", False)), F.array(*[F.lit(x) for x in DEFAULT_BIBS]))
    return _first_existing(sources, names, files, "bib_path")


def find_checklists(sources: DataFrame, files: DataFrame, explicit: str | None = None) -> DataFrame:
    """path, text -> path, checklist_path: the one named, beside the source or by its whole path, else an input whose file name speaks of a checklist, else the usual sibling."""
    inputs = F.transform(F.regexp_extract_all(T.strip_comments(F.col("text")), F.lit(r"\\input\s*\{([^{}]+)\}"), F.lit(1)), T.strip)
    inputs = F.filter(inputs, lambda n: F.contains(F.lower(F.regexp_extract(n, "[^/]*$", 0)), F.lit("checklist")))
    names = F.concat(F.transform(inputs, lambda n: with_suffix(n, ".tex", True)), F.array(F.lit(CHECKLIST)))
    if explicit is None:
        return _first_existing(sources, names, files, "checklist_path")
    if "/" in explicit:
        return sources.select("path").join(files.where(F.col("path").endswith(explicit)).groupBy().agg(F.min("path").alias("checklist_path")).where("checklist_path IS NOT NULL"))  # one row
    return _first_existing(sources, F.concat(F.array(F.lit(explicit)), names), files, "checklist_path")


def manuscripts(spark: SparkSession, path: str, checklist: str | None = None) -> DataFrame:
    """paper_id, tex_text, bib_text, checklist_text of every TeX file with a document under a folder."""
    tex, bib = read_texts(spark, path, "*.tex"), read_texts(spark, path, "*.bib")
    main = tex.where(F.regexp_like("text", F.lit(r"\\begin\s*\{document\}")))
    b = find_bibs(main, bib).join(bib.select(F.col("path").alias("bib_path"), F.col("text").alias("bib_text")), "bib_path")
    c = find_checklists(main, tex, checklist).join(tex.select(F.col("path").alias("checklist_path"), F.col("text").alias("checklist_file")), "checklist_path")
    rows = main.join(b.select("path", "bib_text"), "path", "left").join(c.select("path", "checklist_file"), "path", "left")
    inline = F.when(F.regexp_like("text", F.lit(r"\\checksubsection\b")), F.col("text"))
    return rows.select(F.col("path").alias("paper_id"), F.col("text").alias("tex_text"), "bib_text", F.coalesce("checklist_file", inline).alias("checklist_text"))


# ---- what was fetched ----


def misses(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Each missing key once, however many papers want it."""
    return wanted.select(key).distinct().join(stored, key, "left_anti")


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows, those of the same key replaced. Only resolved records and judged verdicts belong in new."""
    return stored.join(new, key, "left_anti").unionByName(new)


def append_store(new: DataFrame, path: str) -> None:
    """Adds rows of a run to a store; earlier ones of the same key stay and are read no more."""
    new.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_store(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The latest row of each key of a store, or None if there is no such store yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    value = F.struct(*[c for c in rows.columns if c not in (key, "written_at")])
    return rows.groupBy(key).agg(F.max_by(value, "written_at").alias("x")).select(key, "x.*")


def replay_breaker(events: DataFrame, consecutive: int = 5, retries: int = 8) -> DataFrame:
    """Recorded requests through each source's circuit breaker: events has source, ord, failed, attempts_over.

    A failure lengthens the source's streak and any answer ends it; retries add up over the run.
    The breaker opens at the first failure that finds the streak or the retries at their limit, and
    what comes after it is skipped. Adds streak, spent, skipped.
    """
    w = Window.partitionBy("source").orderBy("ord")
    rows = events.withColumn("answers", F.sum((~F.col("failed")).cast("int")).over(w))
    streak = F.sum(F.col("failed").cast("int")).over(Window.partitionBy("source", "answers").orderBy("ord"))
    rows = rows.withColumn("streak", F.when(F.col("failed"), streak).otherwise(0)).withColumn("spent", F.sum("attempts_over").over(w))
    opens = F.col("failed") & ((F.col("streak") >= consecutive) | (F.col("spent") >= retries))
    tripped = F.max(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("skipped", F.coalesce(tripped, F.lit(0)) == 1).drop("answers")


def link_outcomes(probes: DataFrame) -> DataFrame:
    """head_status, get_status, error -> status, ok: the GET counts where HEAD is refused; 2xx and 3xx are fine."""
    status = F.when(F.col("head_status").isin(403, 405, 501), F.col("get_status")).otherwise(F.col("head_status"))
    return probes.withColumn("status", F.when(F.col("error").isNull(), status)).withColumn("ok", F.coalesce((F.col("status") >= 200) & (F.col("status") < 400), F.lit(False)))


# Site paths that are no repositories or models, and statuses that mean "not there".
GITHUB_PAGES = ["sponsors", "features", "about", "pricing", "marketplace", "topics", "collections", "orgs", "apps", "settings", "login", "join", "explore", "search"]
HUB_PAGES = ["datasets", "spaces", "models", "docs", "blog", "join", "pricing", "settings", "api", "search", "login", "new"]
MISSING = {"hf_model": [401, 403, 404], "hf_dataset": [401, 403, 404], "github_repo": [404]}


def artifact(url: Column) -> Column:
    """(artifact_kind, identifier, url) of a model, dataset or repository page; null for anything else."""
    pattern = r"(?i)https?://(?:www\.)?(huggingface\.co|github\.com)/([^?#\s]+)"
    host, path = F.lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)
    segs = F.filter(F.split(path, "/"), lambda s: s != "")
    first = F.lower(F.get(segs, F.lit(0)))
    two = lambda s: F.array_join(F.slice(s, 1, 2), "/")
    make = lambda kind, ident, prefix: F.struct(F.lit(kind).alias("artifact_kind"), ident.alias("identifier"), F.concat(F.lit(prefix), ident).alias("url"))
    repo = F.concat(F.get(segs, F.lit(0)), F.lit("/"), F.regexp_replace(F.get(segs, F.lit(1)), r"\.git$", ""))
    rest = F.slice(segs, 2, 2)
    out = F.when((host == "github.com") & (F.size(segs) >= 2) & ~first.isin(GITHUB_PAGES), make("github_repo", repo, "https://github.com/"))
    out = out.when((host == "huggingface.co") & (first == "datasets") & (F.size(rest) > 0), make("hf_dataset", two(rest), "https://huggingface.co/datasets/"))
    return out.when((host == "huggingface.co") & (F.size(segs) > 0) & ~first.isin(HUB_PAGES), make("hf_model", two(segs), "https://huggingface.co/"))


def artifacts(papers: DataFrame, links: DataFrame) -> DataFrame:
    """What a paper claims to have put online, from its links, then its text; each once by kind and identifier."""
    a = links.select("paper_id", F.lit(0).alias("from_text"), "part", "at", "url")
    b = papers.select("paper_id", F.lit(1).alias("from_text"), F.lit(0).alias("part"), F.posexplode(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"https?://[^\s)\]}>\"']+"), F.lit(0))).alias("at", "url"))
    rows = a.unionByName(b).withColumn("x", artifact(F.col("url"))).where("x IS NOT NULL")
    order = F.row_number().over(Window.partitionBy("paper_id", "x.artifact_kind", F.lower("x.identifier")).orderBy("from_text", "part", "at"))
    return rows.withColumn("nth", order).where("nth = 1").select("paper_id", "x.*")


def artifact_outcomes(probes: DataFrame) -> DataFrame:
    """artifact_kind, status_code, parseable -> status: hit, terminal_miss or transient_fail."""
    missing = F.lit(False)
    for kind, codes in MISSING.items():
        missing = missing | ((F.col("artifact_kind") == kind) & F.col("status_code").isin(codes))
    return probes.withColumn("status", F.when(missing, "terminal_miss").when((F.col("status_code") == 200) & F.col("parseable"), "hit").otherwise("transient_fail"))


def write_reviews(reviews: DataFrame, folder_: str) -> None:
    """paper_id, markdown: a new version each time; earlier ones stay."""
    reviews.withColumn("written_at", F.date_format(F.current_timestamp(), "yyyyMMdd-HHmmss")).write.mode("append").partitionBy("written_at").parquet(folder_)
