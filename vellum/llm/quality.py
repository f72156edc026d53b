"""Quality classifier: interpolated modified Kneser-Ney over character n-grams.

Per language a model of order ORDER is trained on trusted text (labels: quality 1, toxic 0). Counts
are taken over every trusted document, combined per task before the shuffle, and the lower orders
(continuation counts), discounts, context totals and interpolated probabilities come from joins
that are hash-sharded by n-gram. Perplexity is per document over its whole text. A fifth of the
trusted documents is held out of training; a language's threshold is a quantile of theirs, smoothed
by one rule at all sizes: of log perplexities less their language's mean, the language's quantile
and that of all languages are averaged, the latter with the weight of 1 / (1 - quantile) documents,
so what few documents do not tell comes from the others and what many tell is theirs.

Scoring joins a document block's different windows of ORDER characters, each once, with the finished
tables. These lie in the shared folder in shards by n-gram hash, of MODEL_ROWS rows each however common a
context is; a task goes through the shards one after another, looks up all that its block asks of each, and
holds a few of them at a time. So every text is read once, the model passes no driver and is broadcast to
nobody, no text is shuffled to be scored, and a document's perplexity is the sum over its windows' places.

Defined cases: a null language is the language ''; a document without text has no perplexity and is rejected; a
very long text is scored whole, in one block; where a language has no held-out trusted document, nothing is known
and its documents are kept; a perplexity that ties with the threshold is kept; a document with several labels is
trusted if all of them agree; a null id has no label; rows that repeat an id but not a text are documents of their
own, and rows equal in id and text share their result; empty tables give no rows; other columns pass through
unchanged, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 5
HELD_OUT = 5
QUANTILE = 0.975
#: Rows of a shard of the model, and shards that a worker holds.
MODEL_ROWS, HELD_SHARDS = 1_000_000, 4
#: Characters worked on at a time, and different n-grams a task holds before it hands counts on.
CHUNK, MOST_CHUNK = 500_000, 8_000_000
HOLD = 200_000
PAD = "\x02"
MUL = np.uint64(0x9E3779B97F4A7C15)


def hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number for each row of n code points along the last axis (or each window, for a vector)."""
    with np.errstate(over="ignore"):
        if points.ndim == 1:
            h = np.full(len(points) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ (h >> np.uint64(29))) * MUL + points[k : len(points) - n + 1 + k]
        else:
            h = np.full(len(points), n, np.uint64)
            for k in range(n):
                h = (h ^ (h >> np.uint64(29))) * MUL + points[:, k]
    return h.view(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _chunks(texts: list[str], most: int = CHUNK) -> Iterator[tuple[list[int], str, np.ndarray]]:
    """Runs of texts of about `most` characters: their numbers, the padded joined text and where each begins in it."""
    at, held = [], 0
    for i, t in enumerate(texts):
        if t:
            at.append(i)
            held += len(t)
        if at and (held >= most or i == len(texts) - 1):
            parts = [PAD * (ORDER - 1) + texts[k] for k in at]
            yield at, "".join(parts), np.cumsum([0, *map(len, parts)])
            at, held = [], 0
    if at:
        parts = [PAD * (ORDER - 1) + texts[k] for k in at]
        yield at, "".join(parts), np.cumsum([0, *map(len, parts)])


def _windows(joined: str, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window that ends at each real character, and the places of the windows."""
    h = hashes(_points(joined), ORDER)
    real = np.ones(len(joined), bool)
    real[(begins[:-1, None] + np.arange(ORDER - 1)).ravel()] = False
    ends = np.flatnonzero(real)
    return h[ends - ORDER + 1], ends - ORDER + 1


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, text -> lang, g, c: how often each n-gram of the top order occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def out() -> pd.DataFrame:
            rows = pd.DataFrame(held.keys(), columns=["lang", "g"]).assign(c=list(held.values()))
            held.clear()
            return rows

        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                for _, joined, begins in _chunks(part["text"].tolist()):
                    h, places = _windows(joined, begins)
                    _, first, c = np.unique(h, return_index=True, return_counts=True)
                    for k, n in zip(places[first].tolist(), c.tolist()):
                        held[lang, joined[k : k + ORDER]] += n
                    if len(held) >= HOLD:
                        yield out()
        if held:
            yield out()
        common.release()

    counted = docs.select("lang", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "lang string, g string, c long")
    return counted.groupBy("lang", "g").agg(F.sum("c").alias("c"))


def train(docs: DataFrame) -> DataFrame:
    """lang, text -> lang, n, kind ('p' a gram's log probability, 'b' a context's back-off), g, value. Order 0 tells an unseen character's."""
    levels = {ORDER: common.table(count_grams(docs), "kn-counts")}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = levels[n + 1].groupBy("lang", F.substring("g", 2, n).alias("g")).agg(F.count("*").alias("c"))
    grams = levels[ORDER].withColumn("n", F.lit(ORDER))
    for n in range(1, ORDER):
        grams = grams.unionByName(levels[n].withColumn("n", F.lit(n)))
    grams = common.table(grams, "kn-grams")
    is_ = lambda k: F.count_if(F.col("c") == k).cast("double")
    d = grams.groupBy("lang", "n").agg(*[is_(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    some = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    cut = lambda k: F.when(some, F.least(F.greatest(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(0.05)), F.lit(k - 0.05))).otherwise(0.5 + 0.25 * (k > 1))
    d = common.table(d.select("lang", "n", *[cut(k).alias(f"d{k}") for k in (1, 2, 3)]), "kn-discounts")  # a row per language and order
    grams = grams.join(common.small(d), ["lang", "n"])
    grams = grams.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
    contexts = grams.groupBy("lang", "n", F.expr("substring(g, 1, n - 1)").alias("h")).agg(F.sum("c").alias("total"), F.sum("d").alias("spare"))
    contexts = common.table(contexts.withColumn("back", F.col("spare") / F.col("total")), "kn-contexts")
    grams = grams.withColumn("h", F.expr("substring(g, 1, n - 1)")).join(contexts, ["lang", "n", "h"])
    grams = common.table(grams.select("lang", "n", "g", ((F.col("c") - F.col("d")) / F.col("total")).alias("own"), "back"), "kn-own")
    letters = grams.where("n = 1").groupBy("lang").agg((F.count("*") + 1).alias("letters"))
    letters = common.small(common.table(letters, "kn-letters"))  # a row per language
    lower = grams.where("n = 1").join(letters, "lang")
    lower = lower.select("lang", "g", (F.col("own") + F.col("back") / F.col("letters")).alias("p"))
    row = lambda df, n, kind, g, value: df.select("lang", F.lit(n).alias("n"), F.lit(kind).alias("kind"), F.col(g).alias("g"), F.log(value).alias("value"))
    unseen = contexts.where("n = 1").join(letters, "lang")
    out = row(lower, 1, "p", "g", F.col("p")).unionByName(row(unseen, 0, "p", "h", F.col("back") / F.col("letters")))
    for n in range(2, ORDER + 1):
        this = grams.where(F.col("n") == n).withColumn("tail", F.expr("substring(g, 2)"))
        lower = this.join(lower.select("lang", F.col("g").alias("tail"), F.col("p").alias("p_tail")), ["lang", "tail"])
        lower = lower.select("lang", "g", (F.col("own") + F.col("back") * F.col("p_tail")).alias("p"))
        out = out.unionByName(row(lower, n, "p", "g", F.col("p")))
    out = out.unionByName(contexts.where("n > 1").select("lang", "n", F.lit("b").alias("kind"), F.col("h").alias("g"), F.log("back").alias("value")))
    return common.table(out, "kn-model")


def store_model(model: DataFrame, model_rows: int = MODEL_ROWS) -> tuple[str, int]:
    """The model in the shared folder and its number of shards: per shard rows of lang, n, kind, and keys and values as sorted 64- and 32-bit numbers."""
    shards = max(1, -(-model.count() // model_rows))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (n, kind), part in pdf.groupby(["n", "kind"]):
                size = n - (kind == "b")
                points = _points("".join(part["g"])).reshape(len(part), size) if size else np.zeros((len(part), 0), np.uint64)
                key = hashes(points, size)
                yield part.assign(key=key, shard=key % shards)[["lang", "n", "kind", "shard", "key", "value"]]

    def pack(group: tuple, rows: pa.Table) -> pa.Table:
        keys, values = rows.column("key").to_numpy(), rows.column("value").to_numpy()
        order = np.argsort(keys)
        cols = [[x.as_py()] for x in group] + [[keys[order].tobytes()], [values[order].astype("<f4").tobytes()]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["lang", "n", "kind", "shard", "keys", "values"])

    rows = model.mapInPandas(number, "lang string, n int, kind string, shard long, key long, value double")
    packed = rows.groupBy("lang", "n", "kind", "shard").applyInArrow(pack, "lang string, n int, kind string, shard long, keys binary, values binary")
    path = common.made(common.scratch(model.sparkSession, "kn-shards"))
    packed.repartition(shards, "shard").write.partitionBy("shard").parquet(path)
    return path, shards


class Model:
    """Shards of a stored model, the last HELD_SHARDS of them in memory."""

    def __init__(self, path: str, shards: int):
        self.path, self.shards, self.held = path, shards, {}

    def shard(self, number: int) -> dict:
        if number not in self.held:
            from pyarrow import fs, parquet

            system, root = fs.FileSystem.from_uri(f"{self.path}/shard={number}")
            tables = {}
            for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if f.path.endswith(".parquet"):
                    with system.open_input_file(f.path) as opened:
                        for r in parquet.ParquetFile(opened).read(columns=["lang", "n", "kind", "keys", "values"]).to_pylist():
                            tables[r["lang"], r["n"], r["kind"]] = (np.frombuffer(r["keys"], "<i8"), np.frombuffer(r["values"], "<f4"))
            while len(self.held) >= HELD_SHARDS:
                self.held.pop(next(iter(self.held)))
            self.held[number] = tables
        return self.held[number]

    def knows(self, lang: str) -> bool:
        return (lang, 0, "p") in self.shard(0)  # the key of no characters at all is 0

    def log_probabilities(self, points: np.ndarray, lang: str) -> np.ndarray:
        """Of the last code point in each row of ORDER, by the longest seen n-gram and the back-offs above it."""
        keys = {(n, "p"): hashes(points[:, ORDER - n :], n) for n in range(1, ORDER + 1)}
        keys |= {(n, "b"): hashes(points[:, ORDER - n : -1], n - 1) for n in range(2, ORDER + 1)}
        seen = {k: np.zeros(len(points), bool) for k in keys}
        value = {k: np.zeros(len(points)) for k in keys}
        for s in range(self.shards):
            tables = self.shard(s)
            for k, key in keys.items():
                if (lang, *k) in tables:
                    mine = np.flatnonzero(key % self.shards == s) if self.shards > 1 else slice(None)
                    seen[k][mine], value[k][mine] = _find(tables[lang, *k], key[mine])
        out = np.where(seen[1, "p"], value[1, "p"], self.shard(0)[lang, 0, "p"][1][0])
        for n in range(2, ORDER + 1):
            out = np.where(seen[n, "p"], value[n, "p"], out + np.where(seen[n, "b"], value[n, "b"], 0))
        return out


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return table[0][at] == keys, table[1][at]


def score(docs: DataFrame, model: DataFrame, model_rows: int = MODEL_ROWS) -> DataFrame:
    """did, tk, lang, n, log_p (null where the language has no model) for each row of docs (did, tk, lang, text)."""
    path, shards = store_model(model, model_rows)
    chunk = min(MOST_CHUNK, CHUNK * max(1, shards // HELD_SHARDS))  # the more shards a block goes through, the larger it is

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = Model(path, shards)
        step = max(500, chunk // 1000)
        for batch in (b.slice(k, step) for b in batches for k in range(0, b.num_rows, step)):
            langs, texts = np.array(batch.column(2).to_pylist(), object), batch.column(3).to_pylist()
            total, size = np.full(len(texts), np.nan), np.array([len(t) for t in texts])
            for lang in set(langs):
                if not stored.knows(lang):
                    continue
                rows = np.flatnonzero(langs == lang)
                for at, joined, begins in _chunks([texts[i] for i in rows], chunk):
                    h, places = _windows(joined, begins)
                    codes, uniques = pd.factorize(h)
                    first = np.zeros(len(uniques), int)
                    first[codes[::-1]] = places[::-1]
                    p = stored.log_probabilities(_points(joined)[first[:, None] + np.arange(ORDER)], lang)
                    n = np.diff(begins) - ORDER + 1
                    total[rows[at]] = np.add.reduceat(p[codes], np.cumsum([0, *n[:-1]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(size, pa.int64()), pa.array(total, pa.float64(), from_pandas=True)], ["did", "tk", "lang", "n", "log_p"])
        common.release()

    return docs.mapInArrow(run, "did long, tk long, lang string, n long, log_p double")


def _lang() -> Column:
    return F.coalesce("lang", F.lit(""))


def thresholds(known: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """lang, perplexity of held-out documents -> l_lang, threshold."""
    logs = common.table(known.select("lang", F.log("perplexity").alias("x")), "quality-known")
    means = common.table(logs.groupBy(F.col("lang").alias("l_lang")).agg(F.count("*").alias("held_out"), F.avg("x").alias("mean")), "quality-means")
    logs = common.join_small(logs, means, F.col("lang") == F.col("l_lang")).withColumn("off", F.col("x") - F.col("mean"))
    high = F.percentile_approx("off", quantile, 10000)
    shared = logs.agg(high.alias("shared"))
    own = logs.groupBy("l_lang", "held_out", "mean").agg(high.alias("own")).crossJoin(F.broadcast(shared))  # one row
    weight = 1 / (1 - quantile)
    off = (F.col("held_out") * F.col("own") + weight * F.col("shared")) / (F.col("held_out") + weight)
    return common.table(own.select("l_lang", F.exp(F.col("mean") + off).alias("threshold")), "quality-limits")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, model_rows: int = MODEL_ROWS) -> DataFrame:
    """did, tk, lang, perplexity, threshold, keep for each distinct (id, text, language)."""
    trusted = labels.groupBy(F.col("doc_id").alias("t_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND t = 0 AND t_id IS NOT NULL").select("t_id")
    trusted = common.table(trusted, "quality-trusted")
    held = F.pmod(F.xxhash64("t_id"), F.lit(HELD_OUT)) == 0
    learn = common.join_small(docs.select("doc_id", _lang().alias("lang"), "text"), trusted.where(~held), F.col("doc_id") == F.col("t_id"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("did"), common.text_key().alias("tk"), _lang().alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    scored = common.settled("quality-scores", lambda: score(rows, train(learn.select("lang", "text")), model_rows)).dropDuplicates(["did", "tk", "lang"])
    scored = scored.withColumn("perplexity", F.when(F.col("n") > 0, F.exp(-F.col("log_p") / F.col("n"))))
    known = common.join_small(scored, trusted.where(held), F.col("did") == F.col("t_id")).where("perplexity IS NOT NULL")
    limits = thresholds(known, quantile)
    out = common.join_small(scored, limits, F.col("lang") == F.col("l_lang"), "left")
    keep = (F.col("n") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("did", "tk", "lang", "perplexity", "threshold", keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    verdicts = common.settled("quality-rejected", lambda: classify(docs, labels, **how).where("NOT keep").select("did", "tk", F.col("lang").alias("v_lang")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("r_did"), common.text_key().alias("r_tk"), _lang().alias("r_lang"))
    on = (F.col("r_did") == F.col("did")) & (F.col("r_tk") == F.col("tk")) & (F.col("r_lang") == F.col("v_lang"))
    return common.join_small(rows, verdicts, on, "left_anti").select("row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return out.select(F.when(F.col("did") != (1 << 63) - 1, F.col("did")).alias("doc_id"), "lang", "perplexity", "threshold", "keep")
