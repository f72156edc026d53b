"""Pairs of token sets with a Jaccard of at least t, all of them, without a shuffled row per candidate.

What candidates need grows with their number, far faster than the corpus, so they stay within a task:
token sets are written once, by size, to blocks in the shared folder, and a task reads two blocks and
returns their pairs. Two blocks meet only if sets of their sizes can match. Within a task the rarest
tokens of either set find candidates (two sets that match share one of the first n - c + 1 tokens of
each, where c is what they must have in common), the place of that token bounds what they can share,
parities of token bits bound how far they differ, and whole sets decide. Every step is a bound, so
no pair is lost. Rarity is counted for the RANKED most frequent tokens; the others stand before them
in the order of their hashes, as any one order will do. Tokens are told apart by 63 bits of a hash.

Sets with equal tokens are one class, by the least id. Rows without an id or without tokens take no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from vellum.functions import match as M
from vellum.sources.scratch import place, remove, stored

#: Most tokens whose frequency is known to every task, tokens of a block, and candidates or tokens looked at together.
RANKED, BLOCK, CHUNK = 1 << 18, 1 << 22, 1 << 21
#: Room for rounding in bounds, which then let pass a little more.
SLACK = 1e-6
RARE = np.int64(-(2**63))


def token_hashes(title: Column) -> Column:
    return F.transform(F.array_distinct(F.split(M.norm_title(title), " ")), lambda t: F.xxhash64(t))


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent tokens, ascending, and their ranks, the rarest of them first."""
    counts = stored(rows.select(F.explode("h").alias("t")).groupBy("t").count().withColumn("level", F.floor(8 * F.log2("count"))), "token-counts")
    cut, room = None, RANKED
    for level, n in sorted(map(tuple, counts.groupBy("level").agg(F.count("*")).collect()), reverse=True):
        if n > room:
            break
        cut, room = level, room - n
    top = counts.where(F.lit(False) if cut is None else F.col("level") >= cut).select("t", "count").toArrow()
    remove(counts)
    t, n = top["t"].to_numpy(), top["count"].to_numpy()
    rank = np.empty(len(t), np.int64)
    rank[np.lexsort((t, n))] = np.arange(len(t))
    order = np.argsort(t)
    return t[order], rank[order]


def list_of(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(flat))


def coded(batch: pa.RecordBatch, blank: int, hashes: np.ndarray, ranks: np.ndarray) -> list:
    """Columns key, n, id, rare, common: the tokens of a set, the rarest first; key tells sets apart."""
    h = batch.column("h")
    n = h.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = h.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(n) - n
    full = n > 0
    full[full] = (n[full] > 1) | (flat[first[full]] != blank)
    flat, n, ids = flat[np.repeat(full, n)], n[full], batch.column("id").filter(pa.array(full))
    code = flat | RARE
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
        code = np.where(hashes[at] == flat, ranks[at], code)
    doc = np.repeat(np.arange(len(n)), n)
    code = code[np.lexsort((code, doc))]
    raw, ends = code.tobytes(), 8 * np.cumsum(n)
    keys = [hashlib.blake2b(raw[e - 8 * k : e], digest_size=16).digest() for e, k in zip(ends.tolist(), n.tolist())]
    rare = code < 0
    n_rare = np.bincount(doc[rare], minlength=len(n)).astype(np.int64)
    return [pa.array(keys, pa.binary()), pa.array(n.astype(np.int32)), ids, list_of(code[rare], n_rare), list_of(code[~rare].astype(np.int32), n - n_rare)]


def token_sets(titles: DataFrame) -> DataFrame:
    """key, n, id, rare, common of every row that has tokens, copies included."""
    spark = titles.sparkSession
    rows = titles.where("id IS NOT NULL").select("id", token_hashes(F.col("title")).alias("h"))
    blank = spark.range(1).select(F.xxhash64(F.lit(""))).first()[0]  # one row
    table = spark.sparkContext.broadcast(frequent(rows))
    fields = ["key", "n", "id", "rare", "common"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, len(batch) * CHUNK // max(CHUNK, len(batch.column("h").flatten())))
            for at in range(0, len(batch), step):
                yield pa.RecordBatch.from_arrays(coded(batch.slice(at, step), blank, *table.value), fields)

    kind = S.StructType([S.StructField("key", S.BinaryType()), S.StructField("n", S.IntegerType()), titles.schema["id"], S.StructField("rare", S.ArrayType(S.LongType())), S.StructField("common", S.ArrayType(S.IntegerType()))])
    return stored(rows.mapInArrow(run, kind), "token-sets")


def plan_blocks(sizes: list[tuple[int, int]], most: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """sizes: n and the number of sets of n tokens, ascending. Gives (n, first block, blocks) and the least and largest n of every block.

    Later blocks hold no smaller sets; a size with more tokens than a block has several of its own.
    """
    places, blocks, held = [], [], 0
    for n, count in sizes:
        parts = min(count, math.ceil(n * count / most))
        if parts > 1 or not blocks or held + n * count > most:
            places.append((n, len(blocks), parts))
            blocks += [(n, n)] * parts
            held = most if parts > 1 else n * count
        else:
            places.append((n, len(blocks) - 1, 1))
            blocks[-1] = (blocks[-1][0], n)
            held += n * count
    return places, blocks


class Block:
    """Sets of a block, flat: code has their tokens, the rarest first, from first[i] on n[i] of them."""

    def __init__(self, path: str, number: int):
        from pyarrow import fs, parquet

        system, root = fs.FileSystem.from_uri(f"{path}/block={number}")
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".parquet"))
        self.n = np.empty(0, np.int64)
        if not files:  # blocks of one size are dealt by hash
            return
        table = pa.concat_tables([parquet.ParquetFile(system.open_input_file(f)).read(["id", "rare", "common"]) for f in files]).combine_chunks()
        rare, common = (table[c].combine_chunks() for c in ("rare", "common"))
        self.ids = table["id"].combine_chunks()
        n_rare, n_common = (x.value_lengths().to_numpy().astype(np.int64) for x in (rare, common))
        self.rare = rare.flatten().to_numpy()
        self.n = n_rare + n_common
        self.first = np.cumsum(self.n) - self.n
        self.doc = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        self.place = (np.arange(len(self.doc)) - self.first[self.doc]).astype(np.int32)
        self.code = np.empty(len(self.doc), np.int64)
        is_rare = self.place < n_rare[self.doc]
        self.code[is_rare], self.code[~is_rare] = self.rare, common.flatten().to_numpy()

    def tokens(self, rare: np.ndarray) -> np.ndarray:
        """Tokens as numbers within two blocks; rare: the rare ones of both, ascending."""
        out = self.code + len(rare)
        out[self.code < 0] = np.searchsorted(rare, self.rare)
        return out

    def parities(self, log_bits: int) -> np.ndarray:
        """A row of bits for each set, each the parity of the tokens that fall on it: two rows differ in no more bits than their sets differ in tokens."""
        words = np.zeros((len(self.n), 1 << (log_bits - 6)), np.uint64)
        bit = (self.code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - log_bits)
        np.bitwise_xor.at(words.reshape(-1), self.doc.astype(np.int64) * words.shape[1] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        return words


def candidates(a: Block, b: Block, tok_a: np.ndarray, tok_b: np.ndarray, limits: tuple[int, int], same: bool, t: float) -> np.ndarray:
    """Pairs as i * len(b.n) + j that share one of their rarest tokens at a place that leaves enough. No set of a is larger than one of b; limits: the least sizes of a and b."""
    c = t / (1 + t)

    def prefix(x: Block, other: np.ndarray) -> np.ndarray:
        """Rows of the tokens that a match with a set of at least so many tokens must touch."""
        return np.flatnonzero(x.place <= (x.n - np.ceil(c * (x.n + other) - SLACK))[x.doc])

    of_a, of_b = prefix(a, np.maximum(a.n, limits[1])), prefix(b, np.maximum(t * b.n, limits[0]))
    of_a = of_a[np.argsort(tok_a[of_a], kind="stable")]
    keys = tok_a[of_a]
    left = np.searchsorted(keys, tok_b[of_b], "left")
    count = np.searchsorted(keys, tok_b[of_b], "right") - left
    of_b, left, count = (x[count > 0] for x in (of_b, left, count))
    doc_a, n_a, rest_a = a.doc[of_a], a.n[a.doc[of_a]].astype(np.int32), (a.n[a.doc[of_a]] - a.place[of_a]).astype(np.int32)
    doc_b, n_b, rest_b = b.doc[of_b], b.n[b.doc[of_b]].astype(np.int32), (b.n[b.doc[of_b]] - b.place[of_b]).astype(np.int32)
    found, held, total = [np.empty(0, np.int64)], 0, np.cumsum(count)
    at = 0
    while at < len(count):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, "right")))
        j = np.repeat(np.arange(at, end), count[at:end])
        i = np.arange(len(j)) - np.repeat(total[at:end] - count[at:end] - (total[at - 1] if at else 0) - left[at:end], count[at:end])
        m, n = n_a[i], n_b[j]
        fits = np.minimum(rest_a[i], rest_b[j]) >= c * (m + n) - SLACK
        if same:
            fits &= (m < n) | ((m == n) & (doc_a[i] < doc_b[j]))
        found.append(np.unique(doc_a[i[fits]].astype(np.int64) * len(b.n) + doc_b[j[fits]]))
        held += len(found[-1])
        if held > 4 * CHUNK:
            found = [np.unique(np.concatenate(found))]
            held = 0
        at = end
    return np.unique(np.concatenate(found))


def linked_blocks(a: Block, b: Block, limits: tuple[int, int], same: bool, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the sets that match."""
    c = t / (1 + t)
    rare = np.unique(np.concatenate([a.rare, b.rare]))
    tok_a, tok_b = a.tokens(rare), b.tokens(rare)
    i, j = np.divmod(candidates(a, b, tok_a, tok_b, limits, same, t), len(b.n))
    log_bits = max(6, int(b.n.mean()).bit_length())
    bits_a, bits_b = a.parities(log_bits), b.parities(log_bits)
    differ = a.n[i] + b.n[j] - 2 * np.ceil(c * (a.n[i] + b.n[j]) - SLACK)
    close, step = np.zeros(len(i), bool), max(1, CHUNK // bits_a.shape[1])
    for at in range(0, len(i), step):
        s = slice(at, at + step)
        close[s] = np.bitwise_count(bits_a[i[s]] ^ bits_b[j[s]]).sum(1, dtype=np.int64) <= differ[s]
    i, j = i[close], j[close]
    span = int(max(tok_a.max(initial=0), tok_b.max(initial=0))) + 1
    keys = b.doc * np.int64(span) + tok_b
    ends, common, at = np.cumsum(a.n[i]), np.zeros(len(i), np.int64), 0
    while at < len(i):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        n = a.n[i[at:end]]
        pair = np.repeat(np.arange(at, end), n)
        asked = j[pair] * span + tok_a[np.arange(len(pair)) - np.repeat(np.cumsum(n) - n - a.first[i[at:end]], n)]
        hit = keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked
        common[at:end] = np.bincount(pair[hit] - at, minlength=end - at)
        at = end
    match = common >= t * (a.n[i] + b.n[j] - common) - 1e-9
    return i[match], j[match]


def linked_sets(titles: DataFrame, threshold: float = M.TITLE_JACCARD, block: int | None = None) -> DataFrame:
    """id, title -> l_id, r_id of classes of equal token sets that match, each pair once, l_id < r_id. block: tokens of a block."""
    spark = titles.sparkSession
    sets = token_sets(titles)
    sizes = sorted((r.n, r["count"]) for r in sets.select("n", "key").distinct().groupBy("n").count().collect())  # a row per size
    places, blocks = plan_blocks(sizes, block or BLOCK)
    path = place(spark, "token-blocks")
    firsts = sets.groupBy("key").agg(F.min_by(F.struct("id", "n", "rare", "common"), "id").alias("x")).select("key", "x.*")
    where_to = F.broadcast(spark.createDataFrame(places, "n int, at int, parts int"))
    number = (F.col("at") + F.pmod(F.xxhash64("key"), F.col("parts"))).cast("int")
    firsts.join(where_to, "n").select("id", "rare", "common", number.alias("block")).repartition("block").write.partitionBy("block").parquet(path)
    remove(sets)
    meet = [(i, j) for i, (_, most) in enumerate(blocks) for j in range(i, len(blocks)) if threshold * blocks[j][0] <= most + SLACK]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, None
        for batch in batches:
            for k in batch.column(0).to_pylist():
                i, j = meet[k]
                a = a if i == last else Block(path, i)
                last, b = i, a if i == j else Block(path, j)
                if not len(a.n) or not len(b.n):
                    continue
                l, r = linked_blocks(a, b, (blocks[i][0], blocks[j][0]), i == j, threshold)
                yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(l)), b.ids.take(pa.array(r))], ["a", "b"])

    id_ = titles.schema["id"].dataType
    kind = S.StructType([S.StructField("a", id_), S.StructField("b", id_)])
    pairs = spark.range(0, len(meet), 1, max(1, min(len(meet), 4096))).mapInArrow(run, kind)
    out = stored(pairs.where("a <> b").select(F.least("a", "b").alias("l_id"), F.greatest("a", "b").alias("r_id")), "token-pairs")
    remove(path, spark)
    return out
