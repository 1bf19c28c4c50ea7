"""Problem 3: garbled text from wrong character encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.mojibake import garbled_fields
from corpusloom.session import read


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected fields with their restored text."""
    corpus = read(spark, sf_dir, "demo_corpus")
    return garbled_fields(corpus, "rec_no", {f: F.col(f"meta.{f}") for f in ("title", "abstract")}).withColumnRenamed("id", "rec_no")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_repaired(spark, sf_dir).select("rec_no", "field")


QUERIES = {"p3_found": p3_found, "p3_repaired": p3_repaired}
ORACLE: dict[str, str] = {}
