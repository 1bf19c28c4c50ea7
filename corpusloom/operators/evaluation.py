"""Comparison of extracted facts with gold facts, summaries of answers, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import vocabulary as V
from corpusloom.functions import text as T


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)


def set_comparison(gold: DataFrame, candidate: DataFrame, sample: str, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """``(sample, tp, fp, fn)`` of distinct facts, per value of ``by`` too; one grouped pass instead of a full join."""
    tagged = gold.select(sample, *keys).withColumn("g", F.lit(1)).withColumn("c", F.lit(0)).unionByName(candidate.select(sample, *keys).withColumn("g", F.lit(0)).withColumn("c", F.lit(1)))
    facts = tagged.groupBy(sample, *keys).agg(F.max("g").alias("g"), F.max("c").alias("c"))
    return facts.groupBy(sample, *(by or [])).agg(F.count_if(F.expr("g = 1 AND c = 1")).alias("tp"), F.count_if(F.expr("g = 0 AND c = 1")).alias("fp"), F.count_if(F.expr("g = 1 AND c = 0")).alias("fn"))


def micro_average(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and accuracy (share of shared facts among all) of summed counts."""
    total = counts.groupBy(*(by or [])).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return total.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn)).withColumn("accuracy", ratio(tp, tp + fp + fn))


def answer_summary(rows: DataFrame) -> DataFrame:
    """Per question type: answers, share failed, share refused, mean seconds, of ``(question_type, answer, error, latency_seconds)``."""
    kind = F.when(T.trim(T.empty_if_null(F.col("question_type"))) == "", "未分类").otherwise(F.col("question_type"))
    return rows.groupBy(kind.alias("question_type")).agg(
        F.count("*").alias("answers"),
        F.avg(F.when(T.empty_if_null(F.col("error")) != "", 1.0).otherwise(0.0)).alias("failure_rate"),
        F.avg(F.when(T.is_refusal(F.col("answer")), 1.0).otherwise(0.0)).alias("refusal_rate"),
        F.avg("latency_seconds").alias("mean_latency"),
    )


def weighted_judgment(scores: list[Column], weights: tuple[float, ...] = V.JUDGE_WEIGHTS) -> Column:
    """Weighted sum of scores, each clipped to 1..5."""
    total = F.lit(0.0)
    for score, weight in zip(scores, weights):
        total = total + F.least(F.greatest(score, F.lit(1.0)), F.lit(5.0)) * weight
    return total


def hit_at(hits: DataFrame, relevant: Column, k: int) -> DataFrame:
    """``(queries, hit_rate, precision)``: share of queries with a relevant hit among the first ``k``, and share of relevant hits."""
    per = hits.filter(F.col("rank") <= k).groupBy("query_id").agg(F.max(relevant.cast("int")).alias("hit"), F.avg(relevant.cast("double")).alias("p"))
    return per.agg(F.count("*").alias("queries"), F.avg("hit").alias("hit_rate"), F.avg("p").alias("precision"))


def missing_references(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the left table that the right one lacks."""
    return left.select(key).filter(F.col(key).isNotNull()).distinct().join(right.select(key).distinct(), key, "left_anti")


def stratum(kind: Column, relation: Column) -> Column:
    """Whether a fact follows from the metadata alone: some relations, and attributes with some prefixes."""
    structured = ((kind == "triple") & relation.isin(*V.STRUCTURED_RELATIONS)) | ((kind == "attribute") & relation.rlike("^(?:" + "|".join(V.STRUCTURED_ATTRIBUTES) + ")"))
    return F.when(kind == "entity", "all").when(structured, "structured").otherwise("unstructured")


def review_scores(reviews: DataFrame, by: list[str]) -> DataFrame:
    """Reviewed, accepted, rejected and pending rows of ``verdict``, and the share accepted; null where none is reviewed."""
    verdict = F.lower(T.trim(T.empty_if_null(F.col("verdict"))))
    counts = reviews.groupBy(*by).agg(F.count_if(verdict == "accepted").alias("accepted"), F.count_if(verdict == "rejected").alias("rejected"), F.count("*").alias("n"))
    reviewed = F.col("accepted") + F.col("rejected")
    return counts.select(*by, reviewed.alias("reviewed"), "accepted", "rejected", (F.col("accepted") / F.nullif(reviewed, F.lit(0))).alias("precision"), (F.col("n") - reviewed).alias("pending"))


def gold_hits(gold: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    """Of the gold facts ``(query_id, fact)``: how many there are, and how many stand among the first ``k`` of ``(query_id, fact, rank)``."""
    found = retrieved.filter(F.col("rank") <= k).select("query_id", "fact").distinct().withColumn("hit", F.lit(1))
    rows = gold.select("query_id", "fact").distinct().join(found, ["query_id", "fact"], "left")
    return rows.agg(F.count("*").alias("facts"), F.count("hit").alias("hits"), ratio(F.count("hit"), F.count("*")).alias("rate"))
