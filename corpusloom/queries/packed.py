"""Queries of problem 7: several values packed in one field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.packed_values import packed_items
from corpusloom.session import read

FIELDS = ("authors", "organ", "keywords")


def corpus_items(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Every value of the packed fields of the corpus, single ones too."""
    corpus = read(spark, sf_dir, "demo_corpus")
    return packed_items(corpus, "rec_no", {f: F.col(f"meta.{f}") for f in fields}).withColumnRenamed("id", "rec_no")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_items(spark, sf_dir).filter("n_items > 1").select("rec_no", "field", "pos", "item")


QUERIES = {"p7_found": p7_found}
ORACLE: dict[str, str] = {}
