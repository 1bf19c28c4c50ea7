"""Problem 4: broken prompt and response pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.qa_defects import flag_defects
from corpusloom.session import read


def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer with its question; predictions of unknown questions keep a null question."""
    demo = read(spark, sf_dir, "demo")
    questions = demo.groupBy("question_id").agg(F.min_by("question", "pair_no").alias("question"))
    own = demo.select(F.lit("demo").alias("tab"), F.col("pair_no").alias("pair_id"), "question", "answer")
    predicted = read(spark, sf_dir, "qaprediction").select("question_id", "pred_no", "answer").join(questions, "question_id", "left")
    return own.unionByName(predicted.select(F.lit("qaprediction").alias("tab"), F.col("pred_no").alias("pair_id"), "question", "answer"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_defects(answer_pairs(spark, sf_dir))


QUERIES = {"p4_found": p4_found}
ORACLE: dict[str, str] = {}
