"""License scans by diagonal voting.

Every rolling word k-gram of every text is hashed and joined to the k-grams of the templates (two
words for the short base phrases, three for the notices; equal words are demanded beside equal
hashes). A hit votes for a diagonal, its place in the text less its place in the template.
Diagonals whose offsets differ by a few words are merged, and of what they hold, parts that lie
close together are one place of an edited notice, whatever stray hit on another diagonal lies between. A place counts if its hits cover enough of the template within a span of about the
template's length; a base phrase counts if every one of its k-grams voted for one diagonal.

The templates are a fixed table of a few hundred rows, so that side is broadcast; grams that hit
nothing are dropped in the generating stage, and votes are pre-aggregated per text and diagonal and
written once.

Defined cases: a null or empty text has no words, no places, empty label strings and score 0; a very
long text is scanned whole, its grams a stream and its votes one row per template and diagonal; places
that tie in cover are all returned, in order of start, and one span may have several labels; rows that
repeat, an id or all of it, are each scanned and returned; a null id stays null; an empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

# Phrases and labels that must be found as they stand.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices, as their licenses word them, for the labels that the method adds.
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}
COVER = 0.7
STRETCH = 1.5
NEAR_DIAGONALS = 4
GAP = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(BREAK, text.translate(str.maketrans(UPPER, LOWER))) if w]


def words(text: str = "text") -> Column:
    return F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), BREAK), lambda w: w != "")


def templates(spark: SparkSession, notices: dict[str, str] = NOTICES) -> DataFrame:
    """A row per k-gram: t, label, base, t_at, grams (of the template), its words, t_hash; and one that the end of each text hits."""
    rows = [(-1, "", True, 0, 0, "", "", None)]
    for t, (label, text, k) in enumerate([*((v, p, 2) for p, v in BASE.items()), *((v, p, 3) for v, p in notices.items())]):
        w = words_of(text)
        rows += [(t, label, k == 2, i, len(w) - k + 1, *w[i : i + 2], w[i + 2] if k == 3 else None) for i in range(len(w) - k + 1)]
    df = spark.createDataFrame(rows, "t int, label string, base boolean, t_at int, grams int, t_a string, t_b string, t_c string")
    return df.withColumn("t_hash", F.xxhash64("t_a", "t_b"))


def votes(docs: DataFrame, notices: dict[str, str] = NOTICES) -> DataFrame:
    """A row per text, template and diagonal that got votes; template -1 tells the number of words."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), words().alias("w"))
    rows = rows.select("doc_id", "rid", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("at", "a"))
    b, c = (F.coalesce(F.get("w", F.col("at") + k), F.lit("")) for k in (1, 2))
    grams = rows.select("doc_id", "rid", "at", "a", b.alias("b"), c.alias("c"), F.xxhash64("a", b).alias("hash"))
    same = (F.col("hash") == F.col("t_hash")) & (F.col("a") == F.col("t_a")) & (F.col("b") == F.col("t_b")) & F.coalesce(F.col("c") == F.col("t_c"), F.lit(True))
    hits = grams.join(F.broadcast(templates(docs.sparkSession, notices)), same)
    diagonal = (F.col("at") - F.col("t_at")).alias("diagonal")
    return hits.groupBy("doc_id", "rid", "t", "label", "base", "grams", diagonal).agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.collect_set("t_at").alias("seen"))


def places(voted: DataFrame) -> DataFrame:
    """Neighbouring diagonals merged and their spans verified: doc_id, rid, t, label, base, start, end (word after the last), cover."""
    exact = voted.where(F.col("base") & (F.col("t") >= 0) & (F.size("seen") == F.col("grams")))
    exact = exact.select("doc_id", "rid", "t", "label", "base", F.col("diagonal").alias("start"), (F.col("hi") + 2).alias("end"), F.lit(1.0).alias("cover"))
    m = voted.where(~F.col("base"))
    w = Window.partitionBy("rid", "t").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(w) > NEAR_DIAGONALS
    m = m.withColumn("band", F.sum(F.coalesce(far, F.lit(True)).cast("int")).over(w))
    w = Window.partitionBy("rid", "t", "band").orderBy("lo", "diagonal")
    apart = F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) + GAP
    m = m.withColumn("island", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(w))
    m = m.groupBy("doc_id", "rid", "t", "label", "base", "grams", "band", "island").agg(F.min("lo").alias("start"), (F.max("hi") + 3).alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("n"))
    fits = F.col("end") - F.col("start") <= F.ceil(F.lit(STRETCH) * (F.col("grams") + 2))
    m = m.withColumn("cover", F.when(fits, F.col("n") / F.col("grams")).otherwise(0.0))
    return exact.unionByName(m.select(*exact.columns))


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, cover: float = COVER) -> DataFrame:
    voted = common.table(votes(docs, notices), "license-votes")
    ends = voted.where("t = -1").select("doc_id", "rid", F.lit(-1).alias("t"), "label", F.lit(None).cast("boolean").alias("base"), F.col("diagonal").alias("start"), F.col("hi").alias("end"), F.lit(0.0).alias("cover"))
    found = places(voted).unionByName(ends)
    is_base, held = F.col("base") & (F.col("t") >= 0), (F.col("t") >= 0) & (F.col("cover") >= cover)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return found.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"),
        F.max(F.when(F.col("t") == -1, F.col("end"))).cast("long").alias("n_words"),
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(is_base, F.col("label"))).alias("base_labels"),
        joined(F.when(held, F.col("label"))).alias("labels"),
        F.max("cover").alias("score"),
        F.array_sort(F.collect_list(F.when(held, F.struct("start", "end", "label", "cover")))).alias("spans"),
    ).drop("rid")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.read(spark, sf_dir, "documents")).drop("spans")
