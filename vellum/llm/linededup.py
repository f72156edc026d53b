"""Line dedup: winnowing over line hashes, with matches grown both ways.

A repeated run is a stretch of consecutive lines, of at least `least` words, that stands earlier in
the corpus and ends before the run starts; order is by doc_id, text hash and line. Lines without
words are no part of a run; those inside a deleted run go with it. Later repeated runs are deleted,
the first one stays. How they are found:

1. Lines are hashed. A line that occurs once can be in no repeated run, so only stretches of
   lines that occur at least twice, with enough words, go on.
2. Winnowing: from every line the shortest window with `least` words is grown, forwards and
   backwards, and the minimum of a window's lines by (number of occurrences, hash) is its
   fingerprint. Every run with `least` words holds a whole window, and equal windows choose equal
   lines, so a fingerprint in each run is guaranteed.
3. Positions of equal fingerprints are joined: a window whose fingerprint is chosen at no second
   position goes. The join is to an aggregate per fingerprint, never from position to position.
4. What is left is verified by the hash of the window's lines, against the first window in the
   corpus that holds the same. As windows start and end at every line of a match, grown both ways,
   those that match cover it from its first line to its last, whatever places its parts stood at before.

Only DataFrame functions are used. Counts and first places are pre-aggregated before the shuffle, so
a line or passage that a third of the corpus holds is no hot group; tables are broadcast only if
they are small, else the join is shuffled and AQE splits a hot line's rows.

Defined cases: a null text has no lines and stays null; an empty text has one empty line; a very long
text is one document like any other, its windows a partition sorted on disk; a null id is last in order,
and ids that tie are in the order of their text's hash; rows equal in id and text are one document and
get one result, which each of them carries; a run that overlaps its own source is deleted from the source's
end on (of forty equal lines the first `least` words stay); a document that consists of repeated runs keeps
its row with an empty text; an empty table gives no rows; other columns pass through unchanged, whatever
their names, but n_chars, if there, is counted anew where lines went.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAST = 50
LAST_ID = (1 << 63) - 1


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))


def split_lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n")


def lines(docs: DataFrame) -> DataFrame:
    """did, tk, at, h, h2, words: a row per line with words of each distinct document, nth its number among them."""
    rows = docs.select(_id().alias("did"), common.text_key().alias("tk"), F.posexplode(split_lines()).alias("at", "line"))
    rows = rows.select("did", "tk", "at", F.xxhash64("line").alias("h"), F.hash("line").alias("h2"), F.regexp_count("line", F.lit(r"\S+")).alias("words")).where("words > 0")
    rows = rows.repartition("did", "tk").dropDuplicates(["did", "tk", "at"])
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("did", "tk").orderBy("at")))


def repeated_lines(every: DataFrame, least: int = LEAST) -> DataFrame:
    """Lines that occur at least twice, in stretches of enough words, with their count n, the stretch and its words (total)."""
    counts = every.groupBy(F.col("h").alias("c_h"), F.col("h2").alias("c_h2")).agg(F.count("*").alias("n")).where("n > 1")
    counts = common.table(counts, "lines-counts")
    rows = common.join_small(every, counts, (F.col("h") == F.col("c_h")) & (F.col("h2") == F.col("c_h2"))).drop("c_h", "c_h2")
    doc = Window.partitionBy("did", "tk").orderBy("nth")
    rows = rows.withColumn("stretch", F.col("nth") - F.row_number().over(doc))
    whole = Window.partitionBy("did", "tk", "stretch")
    return rows.withColumn("total", F.sum("words").over(whole)).where(F.col("total") >= least)


def windows(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """did, tk, start, last (lines), m_at, m_h, m_h2 (the fingerprint), c1, c2 (hashes of the lines): every shortest window, forwards and backwards."""
    stretch = Window.partitionBy("did", "tk", "stretch")
    rows = rows.withColumn("end", F.sum("words").over(stretch.orderBy("nth"))).withColumn("begin", F.col("end") - F.col("words"))

    def grown(frame, whole: Column) -> Column:
        mark = F.min(F.struct("n", "h", "h2", "at")).over(frame)
        said = F.collect_list(F.struct("h", "h2")).over(frame)
        return F.when(whole, F.struct(F.min("at").over(frame).alias("start"), F.max("at").over(frame).alias("last"), mark["at"].alias("m_at"), mark["h"].alias("m_h"), mark["h2"].alias("m_h2"), F.xxhash64(said).alias("c1"), F.hash(said).alias("c2")))

    forwards = grown(stretch.orderBy("begin").rangeBetween(0, least - 1), F.col("begin") + least <= F.col("total"))
    backwards = grown(stretch.orderBy("end").rangeBetween(1 - least, 0), F.col("end") >= least)
    rows = rows.select("did", "tk", forwards.alias("x"), backwards.alias("y"))
    return rows.select("did", "tk", F.explode(F.array_compact(F.array("x", "y"))).alias("w")).select("did", "tk", "w.*")


def repeated_windows(every: DataFrame) -> DataFrame:
    """Written-out windows -> did, tk, start, last of those that stand earlier: fingerprints first, then whole windows."""
    place = F.struct("did", "tk", "m_at")
    shared = every.groupBy(F.col("m_h").alias("f_h"), F.col("m_h2").alias("f_h2")).agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("f_h", "f_h2")
    left = common.join_small(every, common.table(shared, "lines-marks"), (F.col("m_h") == F.col("f_h")) & (F.col("m_h2") == F.col("f_h2")), "left_semi")
    left = common.table(left.select("did", "tk", "start", "last", "c1", "c2"), "lines-candidates")
    place = F.struct("did", "tk", "start", "last")
    first = left.groupBy(F.col("c1").alias("f_c1"), F.col("c2").alias("f_c2")).agg(F.min(place).alias("first"), F.max(place).alias("latest")).where("first < latest").drop("latest")
    later = common.join_small(left, common.table(first, "lines-first"), (F.col("c1") == F.col("f_c1")) & (F.col("c2") == F.col("f_c2")))
    here = (F.col("did") == F.col("first.did")) & (F.col("tk") == F.col("first.tk"))
    after = F.when(here, F.col("start") > F.col("first.last")).otherwise(F.struct("did", "tk") > F.struct("first.did", "first.tk"))
    return later.where(after).select("did", "tk", "start", "last")


def repeated_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """did, tk, runs: array of (start, end), the line ranges to delete from each document that has any."""
    every = common.table(lines(docs), "lines")
    found = common.table(windows(repeated_lines(every, least), least), "lines-windows")
    common.drop(every)
    gone = repeated_windows(found).distinct()
    doc = Window.partitionBy("did", "tk").orderBy("start", "last")
    before = F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    gone = gone.withColumn("run", F.sum(F.coalesce(F.col("start") > before + 1, F.lit(True)).cast("int")).over(doc))
    runs = gone.groupBy("did", "tk", "run").agg(F.min("start").alias("start"), F.max("last").alias("end"))
    return runs.groupBy("did", "tk").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def dedup(docs: DataFrame, least: int = LEAST, counts: bool = False) -> DataFrame:
    """The documents with later repeated runs deleted; with counts, also n_lines and n_removed."""
    runs = common.settled("lines-runs", lambda: repeated_runs(docs, least)).select(F.col("did").alias("r_did"), F.col("tk").alias("r_tk"), "runs")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), _id().alias("did"), common.text_key().alias("tk"))
    rows = common.join_small(rows, runs, (F.col("did") == F.col("r_did")) & (F.col("tk") == F.col("r_tk")), "left")
    kept = F.filter(F.split(F.col("row.text"), "\n"), lambda x, i: ~F.exists("runs", lambda r: (r["start"] <= i) & (i <= r["end"])))
    text = F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(text.alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            out.append(F.when(F.col("runs").isNull(), F.col("row.n_chars")).otherwise(F.length(text)).cast(kind).alias(c))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    if counts:
        n_removed = F.aggregate(F.coalesce("runs", F.array()), F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"] + 1)
        out += [F.coalesce(F.size(F.split(F.col("row.text"), "\n")), F.lit(0)).cast("long").alias("n_lines"), n_removed.alias("n_removed")]
    return rows.select(*out)


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.read(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


#: Every shortest window from either end, its first place, and the lines of those that stand again after it.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(range(0, len(ls))) AS k, unnest(ls) AS line FROM d),
y AS (SELECT doc_id, k, line, len(regexp_extract_all(line, '[^\x09-\x0D ]+')) AS words FROM x),
z AS (SELECT *, row_number() OVER p AS nth, sum(words) OVER p AS cum FROM y WHERE words > 0 WINDOW p AS (PARTITION BY doc_id ORDER BY k)),
lists AS (SELECT doc_id, list(line ORDER BY k) AS lines FROM z GROUP BY doc_id),
f AS (SELECT a.doc_id, a.nth AS lo, min(b.nth) AS hi, a.k AS first_at, min(b.k) AS last_at FROM z a JOIN z b ON a.doc_id = b.doc_id AND b.nth >= a.nth AND b.cum >= a.cum - a.words + 50 GROUP BY a.doc_id, a.nth, a.k),
g AS (SELECT b.doc_id, max(a.nth) AS lo, b.nth AS hi, max(a.k) AS first_at, b.k AS last_at FROM z a JOIN z b ON a.doc_id = b.doc_id AND b.nth >= a.nth AND a.cum - a.words + 50 <= b.cum GROUP BY b.doc_id, b.nth, b.k),
w AS (SELECT doc_id, first_at, last_at, array_to_string(lines[lo:hi], chr(10)) AS said FROM (SELECT * FROM f UNION SELECT * FROM g) JOIN lists USING (doc_id)),
o AS (SELECT *, min((doc_id, first_at, last_at)) OVER (PARTITION BY said) AS src FROM w),
gone AS (SELECT DISTINCT y.doc_id, y.k FROM o JOIN y ON y.doc_id = o.doc_id AND y.k BETWEEN o.first_at AND o.last_at
  WHERE (o.doc_id = src[1] AND first_at > src[3]) OR o.doc_id > src[1]),
kept AS (SELECT y.doc_id, string_agg(line, chr(10) ORDER BY k) AS text FROM y WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = y.doc_id AND gone.k = y.k) GROUP BY y.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, coalesce(len(ls), 0) AS n_lines, coalesce(n.n, 0) AS n_removed
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
