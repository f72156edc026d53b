"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

Texts are sets of word WORDS-grams; texts with one set are one class, of which one text stands for
all. A signature is TREES bands of MAX_DEPTH minima. Each tree is a trie of its bands: a node is a
prefix of one, and texts that share it are sorted under it. The tries are tables of (tree, depth, prefix)
with their numbers of texts, counted from the shortest prefix of use downwards, so only
nodes with company are ever split further.

A text looks for company from the longest prefix upwards, in all trees at once, and shortens it until
the target recall is reached. How many neighbours it has and how similar they are is estimated from
how many texts share its nodes at the two longest prefixes; of these, and of one more neighbour at
the threshold that nothing tells of, a prefix of depth d misses (1 - s^d)^TREES each. A text of a large
group of copies thus stops at long prefixes, where few others are met; one with little company goes on
to the depth at which any pair at the threshold meets with probability RECALL (4 with these constants),
which is the shortest there is. A text meets all that stand under the nodes it stopped at, however far
they themselves went on. Nodes of several trees with the same texts are one.

Signatures of texts that meet are compared, and what looks similar at all (ROUGH) is joined into candidate
components, within which every pair is verified exactly on whole sets. So a pair that no tree brought
together is still found if it lies in one component.

Nothing emits the pairs of a group: nodes and components with many texts are cut into chunks of
bounded size, a pair of chunks to a task, and a task returns per text its number of links and the
least text it is connected to. Node counts and minima are pre-aggregated; keys are shuffled without
signatures, which are joined once per node a text is met in. Word sets are built again from the texts for
candidates only, and never shuffled for the others.

Result: per row of the input its class_id, the smallest doc_id of the texts connected by links,
and n_links, the number of other rows with similarity of at least the threshold, copies included.

Defined cases: words are runs of letters, digits and underscores of the lower-cased text; a text of
fewer than WORDS words has one shingle of them all; a very long text is one set like any other, held by the
tasks that compare it; a null text or one without words links to nothing; rows may repeat, an id or all of
it, and then link to each other; of ids that tie, the one with the least text hash stands for its class; a null
id is last in order and its class_id null unless linked; an empty table gives no rows; other columns, whatever
their names, are not read, and keep_one passes them through. Sets are told apart by two 64-bit sums.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS = 5
THRESHOLD = 0.8
TREES = 16
MAX_DEPTH = 6
RECALL = 0.9995
ROUGH = 0.55
CHUNK_TEXTS = 512
CHUNK_SHINGLES = 400_000
COLUMNS = 8192
#: Rows of a batch turned into Python objects at a time.
TASK_ROWS = 1000
LAST_ID = (1 << 63) - 1
WORD = re.compile(r"\w+")
MUL = np.uint64(0x9E3779B97F4A7C15)


def depth_for(threshold: float = THRESHOLD, trees: int = TREES, most: int = MAX_DEPTH, recall: float = RECALL) -> int:
    """The longest prefix, at most `most`, under which a pair at the threshold meets in some tree with probability `recall`."""
    depth = most
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the sorted distinct shingle hashes of each text, one text after another."""
    found = [WORD.findall(t.lower()) for t in texts]
    flat = [w for f in found for w in f]
    codes, uniques = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, int), np.zeros(0, object))
    h = pd.util.hash_array(np.asarray(uniques, dtype=object), categorize=False)[codes] if flat else np.zeros(0, np.uint64)
    out, sizes, at = [], [], 0
    for f in found:
        w = h[at : at + len(f)]
        at += len(f)
        n = min(words, len(w))
        if not n:
            sizes.append(0)
            continue
        with np.errstate(over="ignore"):
            s = np.zeros(len(w) - n + 1, np.uint64)
            for k in range(n):
                s = (s ^ (s >> np.uint64(29))) * MUL + w[k : len(w) - n + 1 + k]
        out.append(np.unique(_mix(s)))
        sizes.append(len(out[-1]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array(sizes, int)


def signatures(hashes: np.ndarray, sizes: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """n minima of each non-empty set, as 32-bit numbers."""
    starts = np.cumsum(sizes) - sizes
    full = sizes > 0
    out = np.zeros((len(sizes), n), np.uint32)
    salts = np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
    for k in range(n):
        with np.errstate(over="ignore"):
            x = hashes * salts[k]
        x ^= x >> np.uint64(32)
        with np.errstate(over="ignore"):
            x *= MUL
        out[full, k] = np.minimum.reduceat(x, starts[full]) >> np.uint64(32) if full.any() else 0
    return out


def _slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch of about `most` characters, with the texts of the column."""
    texts, begin, held = batch.column(column).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most or i == len(texts) - 1:
            yield batch.slice(begin, i + 1 - begin), texts[begin : i + 1]
            begin, held = i + 1, 0


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("did"), common.text_key().alias("tk"), F.coalesce("text", F.lit("")).alias("text"))


def sign(docs: DataFrame, words: int, trees: int, depth: int) -> DataFrame:
    """did, tk, text -> did, tk, set_a, set_b (a set's identity), n, sig; sets without words stay out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _slices(batch, 2):
                h, sizes = shingle_sets(texts, words)
                sig = signatures(h, sizes, trees * depth)
                at = np.flatnonzero(sizes)
                if not len(at):
                    continue
                starts = (np.cumsum(sizes) - sizes)[at]
                with np.errstate(over="ignore"):
                    ids = [np.add.reduceat(_mix(h * m), starts) ^ sizes[at].astype(np.uint64) for m in (MUL, np.uint64(0xD1B54A32D192ED03))]
                rows = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(x.view(np.int64)) for x in ids), pa.array(sizes[at], pa.int64()), pa.array([s.tobytes() for s in sig[at]], pa.binary())], ["did", "tk", "set_a", "set_b", "n", "sig"])
        common.release()

    return docs.mapInArrow(run, "did long, tk long, set_a long, set_b long, n long, sig binary")


def tree_keys(sigs: DataFrame, trees: int, lowest: int, most: int = MAX_DEPTH) -> DataFrame:
    """rid, sig -> rid, tree, path: the nodes of each text in a tree, from the prefix of the lowest depth to the longest."""
    width = 4 * most
    path = lambda t: F.array(*[F.xxhash64(F.substring("sig", 1 + t * width, 4 * d)) for d in range(lowest, most + 1)])
    each = F.array(*[F.struct(F.lit(t).alias("tree"), path(t).alias("path")) for t in range(trees)])
    return sigs.select("rid", F.explode(each).alias("x")).select("rid", "x.*")


def missed(s: Column | float, depth: int, trees: int) -> Column:
    """The probability that a neighbour of similarity s shares no prefix of this depth."""
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.pow(1 - F.pow(s, F.lit(float(depth))), F.lit(float(trees)))


def stop_depth(company: DataFrame, lowest: int, most: int, trees: int, threshold: float, recall: float) -> DataFrame:
    """rid, a_<depth> (over all trees, how many other texts share its node) -> rid, stop: the longest prefix that reaches the recall, at least the lowest."""
    longest, next_ = F.col(f"a_{most}"), F.col(f"a_{max(most - 1, lowest)}")
    s = F.least(F.greatest(F.coalesce(F.try_divide(longest, next_), F.lit(0.0)), F.lit(float(threshold))), F.lit(1.0))
    n = longest / (trees * F.pow(s, F.lit(float(most))))
    stop = F.lit(lowest)
    for d in range(lowest + 1, most + 1):
        found = n * (1 - missed(s, d, trees))
        lost = n * missed(s, d, trees) + missed(threshold, d, trees)
        stop = F.when(found >= recall * (found + lost), d).otherwise(stop)
    return company.select("rid", stop.alias("stop"))


def meetings(reps: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, most: int = MAX_DEPTH) -> DataFrame:
    """rid, sig -> node, rid, asks, n_here: the texts that meet under a node, and whether a text stopped there; nodes where none did are left out."""
    lowest = depth_for(threshold, trees, most, recall)
    keyed = tree_keys(reps, trees, lowest, most).withColumn("prefix", F.get("path", F.lit(0)))
    crowded = keyed.groupBy(F.col("tree").alias("c_tree"), F.col("prefix").alias("c_prefix")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    rows = common.join_small(keyed, common.table(crowded, "jaccard-crowded"), (F.col("tree") == F.col("c_tree")) & (F.col("prefix") == F.col("c_prefix")))
    paths = rows.select("rid", "tree", F.posexplode("path").alias("k", "prefix")).select("rid", "tree", (F.col("k") + lowest).alias("depth"), "prefix")
    paths = common.table(paths, "jaccard-paths")
    nodes = paths.groupBy(F.col("tree").alias("n_tree"), F.col("depth").alias("n_depth"), F.col("prefix").alias("n_prefix")).agg(F.count("*").alias("n_here"), F.bit_xor(F.xxhash64("rid")).alias("all_a"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("all_b")).where("n_here > 1")
    nodes = nodes.withColumn("node", F.xxhash64("n_here", "all_a", "all_b", "n_depth")).drop("all_a", "all_b")
    same = (F.col("tree") == F.col("n_tree")) & (F.col("depth") == F.col("n_depth")) & (F.col("prefix") == F.col("n_prefix"))
    paths = common.table(common.join_small(paths, common.table(nodes, "jaccard-nodes"), same).select("rid", "depth", "node", "n_here"), "jaccard-met")
    company = paths.groupBy("rid").agg(*[F.sum(F.when(F.col("depth") == d, F.col("n_here") - 1).otherwise(0)).alias(f"a_{d}") for d in range(lowest, most + 1)])
    stops = stop_depth(company, lowest, most, trees, threshold, recall)
    met = paths.distinct().join(stops, "rid").withColumn("asks", F.col("depth") == F.col("stop"))
    met = common.table(met.select("node", "rid", "asks", "n_here"), "jaccard-meetings")
    asked = common.table(met.where("asks").select(F.col("node").alias("q_node")).distinct(), "jaccard-asked")
    return common.join_small(met, asked, F.col("node") == F.col("q_node"), "left_semi")


def chunked(rows: DataFrame, key: list[str], chunks: Column) -> DataFrame:
    """Rows of a group, with its number of chunks, for each pair of chunks (i <= j) they are in; side tells which."""
    rows = rows.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("chunks")).cast("int"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("i", F.least("own", "x").cast("int")).withColumn("j", F.greatest("own", "x").cast("int"))
    rows = rows.withColumn("second", F.col("own") > F.col("x")).drop("own", "x", "chunks")
    return rows.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j", "second")


def _tasks(batches: Iterator[pa.RecordBatch], key: int, work: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """work's results on each run of rows that agree in the first `key` columns."""
    held, last, out, n = [], None, [], 0
    for batch in (b.slice(k, TASK_ROWS) for b in batches for k in range(0, b.num_rows, TASK_ROWS)):
        pdf = batch.to_pandas()
        if not len(pdf):
            continue
        ids = pdf.iloc[:, :key].to_numpy()
        cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(pdf)]):
            now = tuple(ids[a])
            if held and now != last:
                out.append(work(pd.concat(held) if len(held) > 1 else held[0]))
                n += len(out[-1])
                held = []
            last = now
            held.append(pdf.iloc[a:b])
        if n > 10_000:
            yield pd.concat(out)
            out, n = [], 0
    if held:
        out.append(work(pd.concat(held) if len(held) > 1 else held[0]))
    if out:
        yield pd.concat(out)


def _least(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each row is connected to by a symmetric matrix of links."""
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(links, label[None, :], np.iinfo(np.int64).max).min(1))
        if (new == label).all():
            return label
        label = new


def _square(a: np.ndarray, second: np.ndarray, both: bool) -> np.ndarray:
    """Of a task's links only those between its two chunks, or within its only one, without the diagonal."""
    keep = (second[:, None] != second[None, :]) if both else np.ones_like(a)
    out = a & keep
    np.fill_diagonal(out, False)
    return out


def rough_edges(pdf: pd.DataFrame, rough: float = ROUGH) -> pd.DataFrame:
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), -1)
    ids = pdf["rid"].to_numpy()
    second, asks = pdf["second"].to_numpy(), pdf["asks"].to_numpy(bool)
    if not asks.any():
        return pd.DataFrame({"u": ids[:0], "v": ids[:0]})
    like = np.zeros((len(ids), len(ids)), np.uint16)
    for k in range(sig.shape[1]):
        like += sig[:, k, None] == sig[None, :, k]
    links = (like >= rough * sig.shape[1]) & (asks[:, None] | asks[None, :])
    least = _least(_square(links, second, pdf["i"].iloc[0] != pdf["j"].iloc[0]), ids)
    at = least < ids
    return pd.DataFrame({"u": ids[at], "v": least[at]})


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the common parts of each two sets, by products of incidence matrices over COLUMNS members at a time."""
    sizes = np.array([len(s) for s in sets])
    codes, uniques = pd.factorize(np.concatenate(sets))
    shared = np.bincount(codes, minlength=len(uniques)) > 1
    renamed = (np.cumsum(shared) - 1)[codes]
    keep = shared[codes]
    row, col = np.repeat(np.arange(len(sets)), sizes)[keep], renamed[keep]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for a in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(col, [a, a + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[lo:hi], col[lo:hi] - a] = 1
        out += m @ m.T
    return out


def verified(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Per text of a task: the rows it links to and the least text it is connected to."""
    sets = [np.frombuffer(x, np.int64) for x in pdf["shingles"]]
    n = np.array([len(s) for s in sets], float)
    common_ = intersections(sets)
    links = _square(common_ >= threshold * (n[:, None] + n[None, :] - common_) - 1e-9, pdf["second"].to_numpy(), pdf["i"].iloc[0] != pdf["j"].iloc[0])
    ids = pdf["rid"].to_numpy()
    out = pd.DataFrame({"rid": ids, "links": links @ pdf["size"].to_numpy(), "least": _least(links, ids)})
    return out[out["links"] > 0]


def join(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """did, tk, class_id, n_links for each distinct (id, text)."""
    signed = common.table(sign(_keyed(docs), words, trees, MAX_DEPTH), "jaccard-signed")
    reps = signed.groupBy("set_a", "set_b").agg(F.min(F.struct("did", "tk")).alias("rep"), F.count("*").alias("size"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    reps = common.table(reps.select(F.col("set_a").alias("rid"), "set_b", F.col("rep.did").alias("did"), F.col("rep.tk").alias("tk"), "size", "sig", "n"), "jaccard-classes")

    met = meetings(reps.select("rid", "sig"), threshold, trees, recall)
    rows = met.join(reps.select("rid", "sig"), "rid")
    rows = chunked(rows.select("node", "rid", "sig", "asks", "n_here"), ["node"], F.ceil(F.col("n_here") / CHUNK_TEXTS))

    def rough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in _tasks(batches, 3, rough_edges):
            yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)
        common.release()

    edges = rows.select("node", "i", "j", "second", "rid", "asks", "sig").mapInArrow(rough, "u long, v long").distinct()
    groups = common.table(components(edges, "jaccard-rough").withColumnRenamed("root", "grp"), "jaccard-groups")

    members = reps.join(groups, F.col("rid") == F.col("node")).select("rid", "grp", "did", "tk", "size", "n")
    members = common.table(members, "jaccard-members")
    sizes = members.groupBy(F.col("grp").alias("s_grp")).agg(F.greatest(F.ceil(F.count("*") / CHUNK_TEXTS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).alias("parts"))
    wanted = common.join_small(members, common.table(sizes, "jaccard-sizes"), F.col("grp") == F.col("s_grp")).select(F.col("did").alias("m_did"), F.col("tk").alias("m_tk"), "rid", "grp", "size", "parts")
    texts = common.join_small(_keyed(docs), wanted, (F.col("did") == F.col("m_did")) & (F.col("tk") == F.col("m_tk")))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, some in _slices(batch, 4):
                h, n = shingle_sets(some, words)
                ends = np.cumsum(n)
                sets = [h[e - k : e].tobytes() for e, k in zip(ends, n)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(4)), pa.array(sets, pa.binary())], ["grp", "rid", "size", "parts", "shingles"])
        common.release()

    sets = texts.select("grp", "rid", "size", "parts", "text").mapInArrow(shingles, "grp long, rid long, size long, parts long, shingles binary")
    sets = sets.dropDuplicates(["rid"])  # a repeated row stands for its class once
    tasks = chunked(sets, ["grp"], F.col("parts")).select("grp", "i", "j", "second", "rid", "size", "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in _tasks(batches, 3, lambda task: verified(task, threshold)):
            yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)
        common.release()

    found = common.table(tasks.mapInArrow(verify, "rid long, links long, least long"), "jaccard-links")
    linked = found.groupBy("rid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rid").alias("u"), F.col("least").alias("v")), "jaccard-linked")
    classes = reps.join(linked, "rid", "left").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    classes = common.table(classes.select("rid", "set_b", "did", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rid").alias("root")).where("n_links > 0"), "jaccard-rows")
    first = classes.groupBy("root").agg(F.min("did").alias("class_id"))
    classes = classes.join(first, "root").select(F.col("rid").alias("set_a"), "set_b", "n_links", "class_id")
    out = common.join_small(signed.select("did", "tk", F.col("set_a").alias("a"), F.col("set_b").alias("b")).dropDuplicates(["did", "tk"]), common.table(classes, "jaccard-found"), (F.col("a") == F.col("set_a")) & (F.col("b") == F.col("set_b")))
    return out.select("did", "tk", "class_id", "n_links")


def _outer(docs: DataFrame, found: DataFrame, cols: list[Column]) -> DataFrame:
    """docs' rows with what was found for their id and text."""
    rows = docs.select(*cols, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("r_did"), common.text_key().alias("r_tk"))
    return common.join_small(rows, found, (F.col("r_did") == F.col("did")) & (F.col("r_tk") == F.col("tk")), "left")


def classes_of(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id, n_links: a row per row of docs."""
    out = _outer(docs, common.settled("jaccard-result", lambda: join(docs, **how)), ["doc_id"])
    return out.select("doc_id", F.coalesce(F.when(F.col("class_id") != LAST_ID, F.col("class_id")), F.col("doc_id").cast("long")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents, of each class only one: the first by id and text."""
    found = common.settled("jaccard-result", lambda: join(docs, **how))
    stays = found.groupBy("class_id").agg(F.min(F.struct("did", "tk")).alias("one")).select(F.col("one.did").alias("o_did"), F.col("one.tk").alias("o_tk"))
    goes = found.join(stays, (F.col("did") == F.col("o_did")) & (F.col("tk") == F.col("o_tk")), "left").select("did", "tk", F.col("o_did").isNotNull().alias("stays"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = _outer(docs, common.table(goes, "jaccard-goes"), [row.alias("row")])
    once = rows.where("stays").dropDuplicates(["r_did", "r_tk"])  # the row that stays may itself be repeated
    return rows.where("stays IS NULL").unionByName(once).select("row.*")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_of(common.read(spark, sf_dir, "documents"))


#: All pairs of small tables: shared shingles counted per pair, then everything that links reach.
OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
s AS (SELECT i, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS sh FROM d),
e AS (SELECT i, len(sh) AS n, unnest(sh) AS x FROM s),
c AS (SELECT a.i AS u, b.i AS v, count(*) AS c, any_value(a.n) AS m, any_value(b.n) AS n FROM e a JOIN e b ON a.x = b.x AND a.i <> b.i GROUP BY a.i, b.i),
l AS MATERIALIZED (SELECT u, v FROM c WHERE c >= 0.8 * (m + n - c) - 1e-9),
r AS (SELECT i AS u, i AS v FROM s UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT s.doc_id, min(t.doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.u = s.i) AS n_links
FROM s JOIN r ON r.u = s.i JOIN s t ON t.i = r.v GROUP BY s.i, s.doc_id
"""
