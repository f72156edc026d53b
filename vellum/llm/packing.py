"""Best-fit packing of tokenised documents into sequences, under several capacities at once.

A sequence has a capacity of tokens, of documents and of attention cost (the sum of squared piece
lengths). Pieces are placed in decreasing length; each goes to the open sequence that has room in
every dimension and scores best by a weighted dot-product of demand and residual, or by the
weighted norm of the residual it would leave (the default; over tokens this is best fit).

Pieces of one length are alike, so the choice is made on their counts: a histogram of at most
`tokens` rows reaches the driver, whatever the corpus holds, and sequences with equal residuals
form one group. Each decision "the next n pieces of this length go, one each, to sequences
lo..lo+n at this offset" is an event. A piece finds its event by its rank within its length;
ranks are counted within (length, bucket) and shifted by the buckets before. A length has a bucket
per BUCKET_ROWS of its pieces, so none is a hot group however many there are, and each bucket gets
only the events that its ranks meet. Where a piece fills a sequence, nothing is chosen: pieces of the
full length, most of a corpus of long texts, get a sequence each without rank or shuffle.

Defined cases: a null or empty text is the end token alone; a very long text is cut into pieces like any
other, its ids held by one task; a null id is an id like others; pieces that tie in length, rows that repeat
an id or all of it, are packed as often as they occur, in any order; an empty table gives an empty result;
only doc_id and text are read, whatever other columns are named.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TOKENS = 1024
#: Never bind in the registered query: a piece has at least one token, and squared lengths sum to at most TOKENS squared.
DOCUMENTS = 1024
COST = TOKENS * TOKENS
WEIGHTS = (1.0, 1e-6, 1e-6)
BUCKET_ROWS = 200_000
END = 2
SPECIAL = "<|endoftext|>"


@cache
def _tokenizer(json_path: str | None, ranks_path: str | None):
    """text -> ids as the tokenizer file gives them. The rank file holds the same vocabulary and is faster; texts with the special string, or that it can't take, go to the tokenizer itself."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    full = cache(lambda: Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json")))
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if SPECIAL not in text:
            try:
                return fast.encode_ordinary(text)
            except Exception:  # its pattern engine gives up on some very long runs
                pass
        return full().encode(text, add_special_tokens=False).ids

    return ids


def cuts(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of `most` but the first, which may be shorter."""
    first = n - most * ((n - 1) // most)
    return [(0, first), *((s, most) for s in range(first, n, most))]


def tokenise(docs: DataFrame, tokens: int = TOKENS, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(json_path, ranks_path)
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END], dtype="<u4")
                for k, (start, length) in enumerate(cuts(len(ids), tokens)):
                    at.append(i)
                    rows.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])
        common.release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def events(counts: dict[int, int], tokens: int, documents: int, cost: int, weights=WEIGHTS, rule: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, n, first sequence, offset): where the counted pieces go."""
    full = np.array([tokens, documents, cost], dtype=float)
    w = np.array(weights)
    residual, first, size = np.zeros((0, 3)), np.zeros(0, int), np.zeros(0, int)  # a row per group of sequences with one residual
    out, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1.0, float(length) ** 2])
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        each = int((full // need).min())  # such pieces in an empty sequence
        while left:
            fits = np.flatnonzero((residual >= need).all(1))
            if not len(fits):
                sizes = [(left // each, each), (1, left % each)]
                for n, rounds in sizes:
                    if n and rounds:
                        for k in range(rounds):
                            out.append((length, rank, n, opened, k * length))
                            rank += n
                        residual, first, size = np.vstack([residual, full - rounds * need]), np.append(first, opened), np.append(size, n)
                        opened += n
                break
            r = residual[fits] / full
            score = (w * (r - need / full) ** 2).sum(1) if rule == "norm" else -(w * r * need / full).sum(1)
            g = fits[np.lexsort((first[fits], score))[0]]
            n = int(min(left, size[g]))
            out.append((length, rank, n, int(first[g]), int(tokens - residual[g, 0])))
            residual, first, size = np.vstack([residual, residual[g] - need]), np.append(first, first[g]), np.append(size, n)
            first[g], size[g] = first[g] + n, size[g] - n
            keep = (size > 0) & (residual > 0).all(1)
            residual, first, size = residual[keep], first[keep], size[keep]
            left, rank = left - n, rank + n
    return out


def pack(pieces: DataFrame, tokens: int = TOKENS, documents: int = DOCUMENTS, cost: int = COST, **how) -> DataFrame:
    """Written-out pieces -> the same rows with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `tokens` rows
    alone = histogram.pop(tokens, 0) if documents >= 1 and cost >= tokens * tokens else 0
    if not histogram:
        return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows = pieces.where(F.col("length") != tokens) if alone else pieces
    lengths = spark.createDataFrame([(n, max(1, -(-c // BUCKET_ROWS))) for n, c in histogram.items()], "b_length long, b_n long")
    rows = rows.join(F.broadcast(lengths), F.col("length") == F.col("b_length")).withColumn("bucket", F.pmod(F.monotonically_increasing_id(), F.col("b_n")))
    rows = common.table(rows.drop("b_length", "b_n"), "pack-rows")
    counted = rows.groupBy(F.col("length").alias("c_length"), F.col("bucket").alias("c_bucket")).count()
    before = Window.partitionBy("c_length").orderBy("c_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = counted.select("c_length", "c_bucket", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    plan, opened = [], 0
    for length, first, n, sequence, at in events(histogram, tokens, documents, cost, **how):
        plan.append((length, first, n, sequence, at))
        opened = max(opened, sequence + n)
    plan = spark.createDataFrame(plan, "e_length long, first long, n long, sequence long, at long")
    meets = (F.col("c_length") == F.col("e_length")) & (F.col("first") < F.col("shift") + F.col("count")) & (F.col("shift") < F.col("first") + F.col("n"))
    shift = shift.join(F.broadcast(plan), meets).groupBy("c_length", "c_bucket", "shift").agg(F.array_sort(F.collect_list(F.struct("first", "n", "sequence", "at"))).alias("places"))
    shift = common.table(shift, "pack-places")  # a row per length and bucket
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1)
    rows = common.join_small(rows, shift, (F.col("length") == F.col("c_length")) & (F.col("bucket") == F.col("c_bucket")))
    rows = rows.withColumn("rank", F.col("nth") + F.col("shift"))
    place = F.filter("places", lambda e: (e["first"] <= F.col("rank")) & (F.col("rank") < e["first"] + e["n"]))[0]
    out = rows.withColumn("place", place).select(*pieces.columns, (F.col("place.sequence") + F.col("rank") - F.col("place.first")).alias("sequence_id"), F.col("place.at").alias("offset"))
    if alone:
        full = pieces.where(F.col("length") == tokens)
        out = out.unionByName(full.select("*", (F.monotonically_increasing_id() + opened).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    return out


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    return pack(common.table(tokenise(docs, how.get("tokens", TOKENS)), "pack-pieces"), **how)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.read(spark, sf_dir, "documents"))
