"""Problem 9: mixing sources to target shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.catalog.p8 import byt5_tokens
from corpusloom.llm.mixing import mix, mix_plan, mix_report
from corpusloom.session import materialise, read


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a known source and size; a text that occurs several times shares its weight among its copies."""
    rows = read(spark, sf_dir, "documents").filter("text IS NOT NULL AND source IS NOT NULL").select("doc_id", "source", byt5_tokens(F.col("text")).alias("tokens"), F.xxhash64("text").alias("h"))
    rows = materialise(rows)
    repeats = rows.groupBy("source", "h").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(repeats, ["source", "h"], "left").select("doc_id", "source", "tokens", F.coalesce(1 / F.col("n"), F.lit(1.0)).alias("weight"))


def _plan(documents: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(mix_plan(documents, read(spark, sf_dir, "mix_target")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(_documents(spark, sf_dir), spark, sf_dir).filter("unreachable").select("mix_id", "source").distinct()


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each mix uses each document."""
    documents = materialise(_documents(spark, sf_dir))
    return mix(documents, _plan(documents, spark, sf_dir))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares."""
    documents = materialise(_documents(spark, sf_dir))
    plan = _plan(documents, spark, sf_dir)
    return mix_report(mix(documents, plan), plan)


QUERIES = {"p9_found": p9_found, "p9_mix": p9_mix, "p9_report": p9_report}
ORACLE = {
    "p9_found": "SELECT mix_id, source FROM mix_target LEFT JOIN (SELECT source, sum(strlen(text) + 1) AS held FROM documents WHERE text IS NOT NULL GROUP BY source) USING (source) "
    "WHERE coalesce(held, 0) * max_repeat * 1000 < target_permille::BIGINT * total_tokens",
}
