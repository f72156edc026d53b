"""Numbers that cannot be: metrics out of bounds, splits that do not add up, prose and tables that differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T

from . import grammar
from .findings import finding, union

FAMILY = "numeric"
RATIO_GATE, DELTA_TOLERANCE, SPLIT_TOLERANCE = 2.0, 0.20, 0.01
EVIDENCE = 160

# Names of metrics, and the words around numbers that tell what they are.
FRACTION_METRICS = ["f1", "f-1", "f score", "f-score", "f-measure", "auc", "auroc", "au-roc", "roc-auc", "precision", "recall", "ap", "map", "miou", "iou", "dice", "mcc", "bleu", "rouge", "ndcg", "mrr", "r-squared", "r2", "pearson", "spearman", "kappa", "jaccard"]
PERCENT_METRICS = ["accuracy", "acc", "error rate", "top-1", "top-5", "top 1", "top 5"]
DELTA_BEFORE = r"(?i)(?:\bby\b|[+±]|\bgain\b|\bimprov\w*\b)\s*$"
DELTA_AFTER = r"(?i)^\s*(?:x\b|×|times|points?|pp\b|percentage points|fold\b|%)"
LABELS = {"train": r"train(?:ing)?", "val": r"val(?:idation)?|dev(?:elopment)?", "test": r"test(?:ing)?"}
AMOUNT = r"(\d[\d.,]*\s*[kKmM]?)"
TOTAL = rf"(?i)(?:a\s+)?total(?:ing)?\s+(?:of\s+)?{AMOUNT}|{AMOUNT}\s*(?:examples|samples|instances|images|sentences|documents|data\s*points)?\s*(?:in\s+total|total\b)|\bout\s+of\s+(?:a\s+total\s+of\s+)?{AMOUNT}"
MEAN_STD = r"(\d+(?:\.\d+)?)\s*(?:±|\\pm)\s*(\d+(?:\.\d+)?)\s*(%?)"
HYPERPARAMETERS = [("learning rate", r"(?:learning[ \-]?rate|lr)"), ("batch size", r"batch[ \-]?size"), ("epochs", r"(?:number of\s+)?epochs?")]
UNIT = r"\s*(?:%|points?|pp\b|percentage\s+points)"
ABSTRACT_DELTA = rf"(?i)\+\s*(\d+(?:\.\d+)?){UNIT}|\bby\s+(\d+(?:\.\d+)?){UNIT}|(?:gain|improvement|increase|boost)\s+of\s+(\d+(?:\.\d+)?){UNIT}|(\d+(?:\.\d+)?)[\s\-]point\b"
TABLE_DELTA = r"\+\s*(\d+(?:\.\d+)?)"


def _longest_first(words: list[str]) -> str:
    return T.any_of(sorted(words, key=len, reverse=True))


PERCENT_OF_METRIC = rf"(?i)\b({_longest_first(FRACTION_METRICS + PERCENT_METRICS)})\b[^.\n]{{0,15}}?(\d+(?:\.\d+)?)\s*%"
FRACTION_OF_METRIC = rf"(?i)\b({_longest_first(FRACTION_METRICS)})\b[ ]*(?:score|value)?[ ]*(?:of|is|was|are|were|=|:|reaches?|reached|at)?[ ]*(\d+\.\d+)"


def bounded_metrics(papers: DataFrame) -> DataFrame:
    """A percentage above 100; a fraction between 1 and 2 that is no difference or factor."""
    each = lambda p: papers.select("paper_id", "body", F.explode(T.spans(F.col("body"), p)).alias("s")).select("paper_id", "body", "s", F.regexp_extract("s.match", p, 1).alias("metric"), F.regexp_extract("s.match", p, 2).alias("number"))
    percent = each(PERCENT_OF_METRIC).where(F.col("number").cast("double") > 100)
    fraction = each(FRACTION_OF_METRIC)
    begin = F.col("s.end") - F.length("number")
    before = F.substring("body", F.greatest(F.lit(0), begin - 6) + 1, F.least(F.lit(6), begin))
    after = F.substring("body", F.col("s.end") + 1, F.lit(14))
    value = F.col("number").cast("double")
    fraction = fraction.where((value > 1) & (value < 2) & ~before.rlike(DELTA_BEFORE) & ~after.rlike(DELTA_AFTER))
    say = lambda unit, limit: F.concat(F.lit("a "), F.lower("metric"), F.lit(" of "), F.col("number"), F.lit(f"{unit} is above {limit}; check the number"))
    return union([finding(rows, FAMILY, "bounded_metric", [0, n, F.col("s.start")], detail=say(*said), evidence=T.shorten(F.col("s.match"), EVIDENCE)) for n, (rows, said) in enumerate([(percent, ("%", "100%")), (fraction, ("", "1.0"))])])


def labelled_number(sentence: Column, label: str) -> Column:
    """'N label' if there is one, else 'label N'."""
    before, after = rf"(?i){AMOUNT}\s+(?:{label})\b", rf"(?i)(?:{label})\b\s*(?:set\s*)?(?:of|:|=|with)?\s*{AMOUNT}\b"
    return T.to_number(F.coalesce(T.blank_to_null(F.regexp_extract(sentence, before, 1)), T.blank_to_null(F.regexp_extract(sentence, after, 1))))


def split_arithmetic(papers: DataFrame) -> DataFrame:
    """Train, validation and test sizes against a total that the sentence states."""
    rows = papers.select("paper_id", F.posexplode(F.split("body", r"(?<=[.!?])(?U:\s)+")).alias("n", "sentence"))
    rows = rows.select("paper_id", "n", "sentence", *[labelled_number(F.col("sentence"), p).alias(k) for k, p in LABELS.items()], T.to_number(T.first_of(F.col("sentence"), TOTAL, 3)).alias("total"))
    parts = F.col("train") + F.col("val") + F.col("test")
    rows = rows.where((F.col("train") != 0) & (F.col("val") != 0) & (F.col("test") != 0) & (F.col("total") > 0)).withColumn("parts", parts)
    rows = rows.where(F.abs(F.col("parts") - F.col("total")) / F.col("total") > SPLIT_TOLERANCE)
    whole = lambda c: F.col(c).cast("long").cast("string")
    detail = F.concat(F.lit("train+val+test = "), whole("train"), F.lit("+"), whole("val"), F.lit("+"), whole("test"), F.lit(" = "), whole("parts"), F.lit(", but the total is said to be "), whole("total"))
    return finding(rows, FAMILY, "split_mismatch", [1, F.col("n")], detail=detail, evidence=T.shorten(F.col("sentence"), EVIDENCE))


def mean_std(papers: DataFrame) -> DataFrame:
    """A mean above 100 beside a deviation, where a percent sign or a metric's name tells that 100 is the most."""
    tex = F.coalesce("tex_text", F.lit(""))
    rows = papers.select("paper_id", tex.alias("t"), F.explode(T.spans(tex, MEAN_STD)).alias("s"))
    part = lambda k: F.regexp_extract("s.match", MEAN_STD, k)
    first = F.greatest(F.lit(0), F.col("s.start") - 60)
    near = F.lower(F.substring("t", first + 1, F.col("s.start") - first))
    named = F.lit(False)
    for m in FRACTION_METRICS + PERCENT_METRICS:
        named = named | F.contains(near, F.lit(m))
    rows = rows.where(((part(3) == "%") | named) & (part(1).cast("double") > 100 + 1e-9))
    return finding(rows, FAMILY, "mean_std_range", [2, F.col("s.start")], detail=F.concat(F.lit("a mean of "), part(1), part(3), F.lit(" ± "), part(2), F.lit(" is above 100; check the number")), evidence=T.shorten(F.col("s.match"), EVIDENCE))


def values_of(text: Column, name: str) -> Column:
    pattern = rf"(?i){name}[\s:=&|~≈]*(?:set\s+to|of|is|was|are|were|to)?[\s:=&|~≈]*(\d*\.?\d+(?:[eE][-+]?\d+)?)"
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), T.to_number), lambda v: v.isNotNull() & (v > 0))


def _shown(rows: DataFrame, column: str, sign: str = "") -> DataFrame:
    """Adds column_said: the distinct values of an array, ascending, in %g form."""
    each = rows.select("key", F.posexplode(F.array_sort(F.array_distinct(column))).alias("n", "v"))
    each = each.select("key", "n", F.concat(F.lit(sign), grammar.general_format("v")).alias("v"))
    said = each.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]), ", ").alias(f"{column}_said"))
    return rows.join(said, "key")


def hyperparameter_drift(papers: DataFrame) -> DataFrame:
    """A hyperparameter whose every prose value is more than twice off every table value."""
    tables = F.array_join(T.table_bodies(F.coalesce("tex_text", F.lit(""))), "\n")
    each = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(name).alias("name"), values_of(F.col("body"), p).alias("prose"), values_of(tables, p).alias("table")) for i, (name, p) in enumerate(HYPERPARAMETERS)])
    rows = papers.select("paper_id", F.explode(each).alias("h")).select("paper_id", "h.*").where((F.size("prose") > 0) & (F.size("table") > 0))
    ratio = F.array_min(F.flatten(F.transform("prose", lambda p: F.transform("table", lambda t: F.greatest(p, t) / F.least(p, t)))))
    rows = rows.where(ratio > RATIO_GATE).withColumn("key", F.struct("paper_id", "n"))
    rows = _shown(_shown(rows, "prose"), "table")
    detail = F.concat("name", F.lit(": prose says "), "prose_said", F.lit(", a table says "), "table_said", F.lit("; more than 2 times apart"))
    return finding(rows, FAMILY, "hyperparam_drift", [3, F.col("n")], detail=detail, evidence=F.lit(""))


def delta_matches(a: Column, b: Column) -> Column:
    scale = F.greatest(F.abs(a), F.abs(b))
    return F.when(scale == 0, True).otherwise(F.abs(a - b) / F.when(scale != 0, scale) <= DELTA_TOLERANCE)


def abstract_delta(papers: DataFrame) -> DataFrame:
    """A gain that the abstract claims and no table comes near, where tables state gains at all."""
    said = F.transform(F.regexp_extract_all(F.coalesce("abstract", F.lit("")), F.lit(ABSTRACT_DELTA), F.lit(0)), lambda m: T.to_number(T.first_of(m, ABSTRACT_DELTA, 4)))
    there = F.transform(F.flatten(F.transform(T.table_bodies(F.coalesce("tex_text", F.lit(""))), lambda b: F.regexp_extract_all(b, F.lit(TABLE_DELTA), F.lit(1)))), T.to_number)
    rows = papers.select("paper_id", F.filter(said, lambda v: v.isNotNull()).alias("said"), there.alias("there")).where(F.size("there") > 0)
    rows = rows.select("paper_id", "there", F.posexplode("said").alias("n", "delta")).where(~F.exists("there", lambda t: delta_matches(F.col("delta"), t)))
    rows = _shown(rows.withColumn("key", F.struct("paper_id", "n")), "there", "+")
    detail = F.concat(F.lit("the abstract claims +"), grammar.general_format("delta"), F.lit(", but tables show "), "there_said")
    return finding(rows, FAMILY, "abstract_table_delta", [4, F.col("n")], detail=detail, evidence=F.lit(""))


DETECTORS = {"bounded_metric": bounded_metrics, "split_arithmetic": split_arithmetic, "mean_std": mean_std, "hyperparameter_drift": hyperparameter_drift, "abstract_table_delta": abstract_delta}


def audit(papers: DataFrame) -> DataFrame:
    """paper_id, body, abstract, tex_text -> the findings of every detector, in fixed order."""
    return union([d(papers) for d in DETECTORS.values()])
