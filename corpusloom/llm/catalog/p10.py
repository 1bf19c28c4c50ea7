"""Problem 10: missing or wrong language labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.language import languages, train
from corpusloom.session import read


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and segment, with confidence."""
    documents = read(spark, sf_dir, "documents")
    return languages(documents, train(documents, read(spark, sf_dir, "lang_seed")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose label is missing or wrong, and all segments."""
    return p10_languages(spark, sf_dir).filter("seg_no > 0 OR label IS NULL OR label <> lang").select("doc_id", "seg_no", "lang")


QUERIES = {"p10_found": p10_found, "p10_languages": p10_languages}
ORACLE: dict[str, str] = {}
