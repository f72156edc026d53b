"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests.

A text's paragraphs are its lines; long lines are cut at sentence ends, and long sentences into
blocks of words. Each paragraph, numbered among equal ones, has a 64-bit digest that is added to
one cell in each of three parts of a table: a count, an XOR of digests and an XOR of checks. The
tables of two versions subtract cell by cell, and peeling cells that hold one digest recovers the
digests that only one version has. If peeling gets stuck, both are sketched again twice as large.

The fingerprint is the number of paragraphs and a table in base64. Its size follows the text: the
power of two, at least PART, that holds half as many cells a part as there are paragraphs, enough to
recover a difference of all of them. A table folds into one half as large by adding its halves, so
fingerprints of any two sizes subtract at the smaller one (`recover`). The likeness of two texts is
2 * common / (paragraphs of both), from the counts and the recovered difference; that of two texts
without paragraphs is 1 if they are equal.

Neighbours in id order are found without a global sort: documents go to ranges of (id, text hash)
of about RANGE_BYTES, the first of each range also to the range before (of the first, to the last), and
each range is streamed in order, holding a few documents at a time. Limits of ranges come from a
bounded sample of keys, which sets how even the ranges are and nothing else.

Defined cases: a null text is empty; a very long text is one document, held whole by its task; a null
id is last in order; ids that tie, and rows that repeat an id, are ordered by text hash, so many rows of one
id are many ranges; rows equal in id and text are each a document, next to one another in one range; the
only document is its own next one; an empty table gives no rows; other columns, whatever their names,
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PART = 8
LONG, BLOCK_WORDS = 120, 12
#: Cells worked on at a time.
CELLS = 3 << 20
#: Bytes of text of a range, sampled keys that its limits are chosen from, and ranges at most: of a larger corpus each streams more.
RANGE_BYTES, RANGE_KEYS, MOST_RANGES = 8 << 20, 20, 16_384
LAST_ID = (1 << 63) - 1
SENTENCE = re.compile(r"(?<=[.!?]) ")
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def paragraphs(text: str) -> list[str]:
    out = []
    for line in text.split("\n"):
        for s in SENTENCE.split(line) if len(line) > LONG else (line,):
            if len(s) > LONG:
                w = s.split(" ")
                out += [" ".join(w[i : i + BLOCK_WORDS]) for i in range(0, len(w), BLOCK_WORDS)]
            elif s:
                out.append(s)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def digests(texts: list[str]) -> list[np.ndarray]:
    """The paragraph digests of each text; the k-th of equal paragraphs has a digest of its own."""
    units = [paragraphs(t) for t in texts]
    flat = [u for us in units for u in us]
    h = pd.util.hash_array(np.array(flat, dtype=object), categorize=False) if flat else np.zeros(0, np.uint64)
    out, at = [], 0
    for us in units:
        d = h[at : at + len(us)].copy()
        at += len(us)
        if len(set(us)) < len(us):
            seen: dict[str, int] = {}
            nth = np.zeros(len(us), np.uint64)
            for i, u in enumerate(us):
                seen[u] = nth[i] = seen.get(u, -1) + 1
            d = np.where(nth > 0, _mix(d + nth), d)
        out.append(d)
    return out


def _cells(d: np.ndarray, part: int) -> np.ndarray:
    """The three cells of each digest, within a table of 3 * part."""
    return np.stack([(_mix(d ^ np.uint64(0x51ED2701 + j)) % np.uint64(part)).astype(np.int64) + j * part for j in range(3)], 1)


def _check(d: np.ndarray) -> np.ndarray:
    return (_mix(d ^ np.uint64(0xA5A5A5A5)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class Table:
    """Sketches of several texts, one after another in flat arrays."""

    def __init__(self, n: int, part: int):
        self.n, self.part = n, part
        self.count, self.key, self.check = np.zeros(n * 3 * part, np.int32), np.zeros(n * 3 * part, np.uint64), np.zeros(n * 3 * part, np.uint32)

    def add(self, row: np.ndarray, d: np.ndarray, sign: np.ndarray) -> None:
        at = (_cells(d, self.part) + row[:, None] * 3 * self.part).ravel()
        np.add.at(self.count, at, np.repeat(sign, 3).astype(np.int32))
        np.bitwise_xor.at(self.key, at, np.repeat(d, 3))
        np.bitwise_xor.at(self.check, at, np.repeat(_check(d), 3))

    def peel(self, found: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: whether it was emptied, and how many digests came out with sign 1 and -1."""
        plus, minus = np.zeros(self.n, int), np.zeros(self.n, int)
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            look = look[self.check[look] == _check(self.key[look])]
            if not len(look):
                break
            row, d, sign = look // (3 * self.part), self.key[look], self.count[look]
            one = _first(row, d)  # a digest may stand alone in several of its cells
            row, d, sign = row[one], d[one], sign[one]
            self.add(row, d, -sign)
            if found is not None:
                found.append((d, sign))
            np.add.at(plus, row[sign == 1], 1)
            np.add.at(minus, row[sign == -1], 1)
            look = np.unique((_cells(d, self.part) + row[:, None] * 3 * self.part).ravel())
            look = look[np.abs(self.count[look]) == 1]
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        return ~left.reshape(self.n, -1).any(1), plus, minus

    def texts(self, sizes: list[int]) -> list[str]:
        """Each sketch as a string, with its number of digests."""
        w = 3 * self.part
        return [base64.b64encode(struct.pack("<I", s) + self.count[i * w : i * w + w].astype("<i4").tobytes() + self.key[i * w : i * w + w].astype("<u8").tobytes() + self.check[i * w : i * w + w].astype("<u4").tobytes()).decode() for i, s in enumerate(sizes)]


def _first(row: np.ndarray, d: np.ndarray) -> np.ndarray:
    order = np.lexsort((d, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (d[order][1:] != d[order][:-1])
    return order[new]


def _join(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate([*sets, np.zeros(0, np.uint64)])


def part_for(n: int, part: int = PART) -> int:
    """Cells of each of the three parts of a fingerprint of n paragraphs."""
    while 2 * part < n:
        part *= 2
    return part


def sketches(sets: list[np.ndarray], part: int = PART) -> list[str]:
    """The fingerprint of each set of digests."""
    out, sizes = [""] * len(sets), np.array([part_for(len(s), part) for s in sets])
    for size in np.unique(sizes):
        group = np.flatnonzero(sizes == size)
        step = max(1, CELLS // (3 * int(size)))
        for some in (group[k : k + step] for k in range(0, len(group), step)):
            t = Table(len(some), int(size))
            row, d = _join([sets[i] for i in some])
            t.add(row, d, np.ones(len(d), np.int32))
            for i, said in zip(some, t.texts([len(sets[i]) for i in some])):
                out[i] = said
    return out


def recover(one: str, other: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The paragraph digests that only the first, and only the second, of two fingerprints holds; None where peeling gets stuck and larger ones are needed."""
    read = []
    for said in (one, other):
        raw = base64.b64decode(said)[4:]
        cells = len(raw) // 16
        read.append([np.frombuffer(raw, kind, cells, at * cells).reshape(3, -1) for kind, at in (("<i4", 0), ("<u8", 4), ("<u4", 12))])
    part = min(r[0].shape[1] for r in read)
    t = Table(1, part)
    for (count, key, check), sign in zip(read, (1, -1)):
        folded = lambda x: x.reshape(3, -1, part)
        t.count += (sign * folded(count).sum(1)).ravel().astype(np.int32)
        t.key ^= np.bitwise_xor.reduce(folded(key), 1).ravel()
        t.check ^= np.bitwise_xor.reduce(folded(check), 1).ravel()
    found: list = []
    fine, _, _ = t.peel(found)
    if not fine[0]:
        return None
    d, sign = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, int))
    return d[sign == 1], d[sign == -1]


def likeness(a: list[np.ndarray], b: list[np.ndarray], part: int = PART) -> np.ndarray:
    """Of each two sets of digests, at the size of the smaller fingerprint; those that can't be peeled are sketched again, twice as large."""
    both = np.array([len(x) + len(y) for x, y in zip(a, b)], float)
    out, todo = np.ones(len(a)), np.flatnonzero(both)
    size = np.array([part_for(min(len(x), len(y)), part) for x, y in zip(a, b)], int)
    while len(todo):
        stuck = []
        for now in np.unique(size[todo]):
            group = todo[size[todo] == now]
            step = max(1, CELLS // (3 * int(now)))
            for some in (group[k : k + step] for k in range(0, len(group), step)):
                t = Table(len(some), int(now))
                for sets, sign in ((a, 1), (b, -1)):
                    row, d = _join([sets[i] for i in some])
                    t.add(row, d, np.full(len(d), sign, np.int32))
                fine, plus, minus = t.peel()
                out[some[fine]] = (both[some] - plus - minus)[fine] / both[some[fine]]
                stuck.append(some[~fine])
        todo = np.concatenate(stuck)
        size[todo] *= 2
    return out


def _below(limits: list[tuple[int, int]], did: Column, tk: Column) -> Column:
    """How many of the sorted limits are at most (did, tk): first among every step-th, then within a step, so a row meets about two square roots of their number."""
    if not limits:
        return F.lit(0)
    step = max(1, int(len(limits) ** 0.5))
    groups = [limits[k : k + step] for k in range(0, len(limits), step)]
    lit = lambda xs: F.array(*[F.struct(F.lit(a).alias("d"), F.lit(b).alias("t")) for a, b in xs])
    held = lambda arr: F.size(F.filter(arr, lambda x: (x["d"] < did) | ((x["d"] == did) & (x["t"] <= tk))))
    coarse = held(lit([g[0] for g in groups]))
    fine = F.get(F.array(*[lit(g) for g in groups]), coarse - 1)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + held(fine))


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, range, look, text: the documents of each range in order, then (look) the one that follows them."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("did"), common.text_key().alias("tk"), F.coalesce("text", F.lit("")).alias("text"))
    keys = common.table(rows.select("did", "tk", F.octet_length("text").cast("long").alias("size")), "ranges-keys")
    size, n = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    wanted = max(1, min(n, MOST_RANGES, -(-size // RANGE_BYTES)))
    limits = []
    if wanted > 1:
        some = keys.sample(fraction=min(1.0, RANGE_KEYS * wanted / n), seed=7).select("did", "tk").distinct().sort("did", "tk").collect()  # about RANGE_KEYS a range
        limits = sorted({tuple(some[k * len(some) // wanted]) for k in range(1, wanted)} if some else ())
    number = lambda df: df.withColumn("range", _below(limits, F.col("did"), F.col("tk")))
    first = sorted(number(keys).groupBy("range").agg(F.min(F.struct("did", "tk")).alias("one")).collect())  # a row per range
    common.drop(keys)
    looks = spark.createDataFrame([(*r.one, first[i - 1].range) for i, r in enumerate(first)], "l_did long, l_tk long, l_range int")
    rows = number(rows).join(F.broadcast(looks), (F.col("did") == F.col("l_did")) & (F.col("tk") == F.col("l_tk")), "left")
    own = F.array(F.struct(F.col("range").alias("r"), F.lit(False).alias("look")))
    also = F.array(F.struct(F.col("l_range").alias("r"), F.lit(True).alias("look")))
    rows = rows.withColumn("x", F.explode(F.when(F.col("l_range").isNull(), own).otherwise(F.concat(own, also))))
    rows = rows.select("doc_id", F.col("x.r").alias("range"), F.col("x.look").alias("look"), "text", "did", "tk")
    return rows.repartition(max(1, len(first)), "range").sortWithinPartitions("range", "look", "did", "tk").select("doc_id", "range", "look", "text")


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the text that follows."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def fingerprint(docs: DataFrame, part: int = PART) -> DataFrame:
    """Each text's fingerprint beside that of its edited text, and its likeness to that and to the next document."""

    def rows(group: list[tuple], digest: list[np.ndarray]) -> pa.RecordBatch:
        """Of all documents of a run but the last, which is there as the next one."""
        ids, texts = [g[0] for g in group[:-1]], [g[1] for g in group]
        edited = [edit(t, f) for t, f in zip(texts, texts[1:])]
        new = digests(edited)
        equal = [float(t == e) for t, e in zip(texts, edited)]
        close = np.where([len(x) + len(y) for x, y in zip(digest, new)], likeness(digest[:-1], new, part), equal)
        equal = [float(t == f) for t, f in zip(texts, texts[1:])]
        next_ = np.where([len(x) + len(y) for x, y in zip(digest, digest[1:])], likeness(digest[:-1], digest[1:], part), equal)
        cols = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(sketches(digest[:-1], part)), pa.array(sketches(new, part)), pa.array(close, pa.float64()), pa.array(next_, pa.float64())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (doc_id, text); the last has not met its next one
        now, closed, chars = None, False, 0

        def flush():
            return rows(held, digests([t for _, t in held]))

        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, number, look, text = (batch.column(c)[i].as_py() for c in range(4))
                if number != now:
                    if len(held) > 1:
                        yield flush()
                    held, now, closed, chars = [], number, False, 0
                if closed:
                    continue  # the first document of the next range may be a repeated row
                held.append((doc_id, text))
                chars, closed = chars + len(text), look
                if chars > 2 << 20 and len(held) > 1:
                    yield flush()
                    held, chars = held[-1:], len(held[-1][1])
        if len(held) > 1:
            yield flush()

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(common.read(spark, sf_dir, "documents"))
