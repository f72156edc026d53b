"""The reproducibility checklist: items, their consistency, and claims that the paper gives no sign of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import match as M
from vellum.functions import text as T

from . import grammar
from .findings import finding

# The unfilled answer, and what counts as evidence.
UNFILLED = "type your response here"
REPOSITORY_HOSTS = ["github.com", "gitlab.com", "bitbucket.org", "zenodo.org", "osf.io", "huggingface.co", "codeocean.com"]
DATASET_HOSTS = ["huggingface.co/datasets", "kaggle.com", "openml.org", "zenodo.org", "figshare.com", "data.mendeley.com", "paperswithcode.com/dataset"]
DATASET_NAMES = ["imagenet", "cifar", "mnist", "coco", "squad", "glue", "wikitext", "librispeech", "penn treebank", "ptb", "wmt", "conll", "snli", "mnli", "celeba", "svhn"]
HARDWARE = r"(?i)\b(gpu|cpu|tpu|a100|h100|v100|a6000|a40|rtx|gtx|titan|tesla|cuda|nvidia|\d+\s*gb|cores?|ram|gpu[- ]hours?)\b"
RUNS = r"(?i)(\b\d+\s+(?:runs|trials|seeds|repetitions|replicates)\b|\brandom seeds?\b|\bseeds?\b|\baveraged over\b|\bindependent runs?\b|\bstandard deviation\b|\bstd\.?\b|±)"
#: number, needles, exclusion, name of the evidence, which evidence.
CLAIMS = [
    (0, ["source code", "publicly available"], None, "public repository URL", "repository"),
    (1, ["computing infrastructure"], None, "hardware details", "hardware"),
    (2, ["number of algorithm runs"], None, "statement of runs or seeds", "runs"),
    (3, ["datasets", "publicly available"], "not publicly available", "dataset URL or known dataset name", "dataset"),
]
FAMILY = "checklist"


def items(manuscripts: DataFrame) -> DataFrame:
    """paper_id, checklist_text -> a row per question: item_ord, section, question, options, response, is_gate, gate_question."""
    rows = manuscripts.withColumn("found", grammar.parse_checklist("checklist_text")).select("paper_id", "found", F.posexplode("found").alias("item_ord", "i"))
    question = T.flatten_answer(F.col("i.question"))
    options = F.transform(F.regexp_extract_all("i.options", F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    gate = T.flatten_answer(F.get("found", F.col("i.gate"))["question"])
    return rows.select("paper_id", "item_ord", T.flatten_answer(F.col("i.section")).alias("section"), question.alias("question"), options.alias("options"), T.flatten_answer(F.col("i.response")).alias("response"), ((options == F.array(F.lit("yes"), F.lit("no"))) & question.rlike("(?i)^does this paper")).alias("is_gate"), F.when(F.col("i.gate").isNotNull(), gate).alias("gate_question"))


def is_blank(response: Column) -> Column:
    r = F.lower(T.strip(response))
    return (r == "") | F.contains(r, F.lit(UNFILLED))


def answer(response: Column) -> Column:
    """The first word, lower-cased; 'N/A' is na; null if blank or without a word."""
    words = F.regexp_extract_all(F.lower(response), F.lit("[a-z]+"), F.lit(0))
    spelled = F.forall(words, lambda w: F.length(w) == 1) & (F.size(words) <= 3)
    return F.when(is_blank(response) | (F.size(words) == 0), None).when(spelled, F.array_join(words, "")).otherwise(F.get(words, F.lit(0)))


def consistency(items: DataFrame) -> DataFrame:
    """unanswered, invalid_response and gate_inconsistency."""
    rows = items.withColumn("answer", answer(F.col("response"))).withColumn("blank", is_blank(F.col("response")))
    gates = rows.where("is_gate").groupBy("paper_id", F.col("question").alias("gate_question")).agg(F.max_by("answer", "item_ord").alias("given"))
    rows_ = rows.join(gates, ["paper_id", "gate_question"], "left").where("gate_question IS NULL OR given IS NULL OR given <> 'no'")
    said = T.strip(F.col("response"))
    blank = finding(rows_.where("blank"), FAMILY, "unanswered", [0, F.col("item_ord")], section=F.col("section"), question=F.col("question"), response=said)
    invalid = rows_.where(~F.col("blank") & (F.size("options") > 0) & F.col("answer").isNotNull() & ~F.array_contains("options", F.col("answer")))
    invalid = finding(invalid, FAMILY, "invalid_response", [0, F.col("item_ord")], section=F.col("section"), question=F.col("question"), response=said, detail=F.concat(F.lit("allowed: "), F.array_join("options", ", ")))
    points = rows.where("gate_question IS NOT NULL").groupBy("paper_id", "gate_question").agg(F.count_if(~F.col("blank") & ~F.col("answer").eqNullSafe(F.lit("na"))).alias("answered"), F.bool_and("blank").alias("all_blank"))
    whole = rows.where("is_gate").drop("gate_question").withColumn("gate_question", F.col("question")).join(points, ["paper_id", "gate_question"]).join(gates, ["paper_id", "gate_question"])
    no, yes = (F.col("given") == "no") & (F.col("answered") > 0), (F.col("given") == "yes") & F.col("all_blank")
    detail = F.when(no, F.concat(F.lit('answered "no", but '), F.col("answered").cast("string"), F.lit(" of its points have answers of substance"))).otherwise('answered "yes", but every one of its points is blank')
    gate = finding(whole.where(no | yes), FAMILY, "gate_inconsistency", [1, F.col("item_ord")], section=F.col("section"), question=F.col("question"), response=said, detail=detail)
    return blank.unionByName(invalid).unionByName(gate)


def evidence(papers: DataFrame, links: DataFrame) -> DataFrame:
    """paper_id, which: the kinds of evidence that a paper or its links show."""
    body = F.coalesce("body", F.lit(""))
    by_body = F.array_compact(F.array(
        F.when(M.contains_any(body, REPOSITORY_HOSTS), F.lit("repository")),
        F.when(body.rlike(HARDWARE), F.lit("hardware")),
        F.when(body.rlike(RUNS), F.lit("runs")),
        F.when(M.contains_any(body, DATASET_HOSTS + DATASET_NAMES), F.lit("dataset")),
    ))
    by_link = F.array_compact(F.array(F.when(M.contains_any(F.col("url"), REPOSITORY_HOSTS), F.lit("repository")), F.when(M.contains_any(F.col("url"), DATASET_HOSTS), F.lit("dataset"))))
    return papers.select("paper_id", F.explode(by_body).alias("which")).union(links.select("paper_id", F.explode(by_link).alias("which"))).distinct()


def claims(items: DataFrame, papers: DataFrame, links: DataFrame) -> DataFrame:
    """Affirmed items for which the paper shows none of the evidence sought."""
    rules = items.sparkSession.createDataFrame(CLAIMS, "rule int, needles array<string>, exclude string, sought string, which string")
    rows = items.where(answer(F.col("response")).isin("yes", "partial")).withColumn("q", F.lower("question"))
    asked = F.forall("needles", lambda n: F.contains(F.col("q"), n)) & F.coalesce(~F.contains("q", "exclude"), F.lit(True))
    rows = rows.join(F.broadcast(rules), asked)  # four rules
    rows = rows.join(evidence(papers, links), ["paper_id", "which"], "left_anti")
    return finding(rows, FAMILY, "claim_unsupported", [2, F.col("item_ord"), F.col("rule")], section=F.col("section"), question=F.col("question"), response=T.strip(F.col("response")), detail=F.concat(F.lit("no "), F.col("sought"), F.lit(" found in the paper; check")))


def audit(items: DataFrame, papers: DataFrame, links: DataFrame) -> DataFrame:
    return consistency(items).unionByName(claims(items, papers, links))


def kind_counts(findings: DataFrame) -> DataFrame:
    """Per paper the number of findings of each kind, zeros included."""
    kinds = ["unanswered", "invalid_response", "gate_inconsistency", "claim_unsupported"]
    return findings.where(F.col("family") == FAMILY).groupBy("paper_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
