"""Small tables with every odd case: nulls, empty and very long texts, ties, repeated rows, extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    w = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in ("n", "r", "st", "", "l", "m", "nd")][:vocabulary]
    out = []
    for i in range(words):
        out.append(r.choice(w) + ("." if i % 11 == 10 else ""))
    return " ".join(out)


def documents(spark, rows, schema: str = SCHEMA):
    """rows of (doc_id, text[, lang, source])."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, *("en", "s")[len(row) - 2 :])[:4] if len(row) < 4 else row
        full.append((doc_id, text, lang, source, None if text is None else len(text)))
    return spark.createDataFrame(full, schema)


def odd(spark):
    long = prose(1, 30_000)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "b"), (4, long, "en", "a"), (5, "x", "de", "b"), (5, "x", "de", "b"), (5, "y z", "de", None), (None, "no id here", "en", "a"), (6, long, "en", "c"), (7, "𝒳 ünï — 　漢字 <|endoftext|> \x00 end", "zz", "c")]
    return documents(spark, rows)


#: Names that operators use inside themselves.
CLASHING = ["row", "did", "tk", "size", "rate", "seed", "n", "src", "target", "copy", "runs", "rid", "class_id", "perplexity", "keep", "length", "bucket", "rank", "Doc", "threshold", "h", "at"]


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
