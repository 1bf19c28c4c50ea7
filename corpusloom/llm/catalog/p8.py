"""Problem 8: filling containers of fixed capacity with documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.packing import pack, packing_report
from corpusloom.session import read


def byt5_tokens(text: Column) -> Column:
    """Size in tokens of the public ByT5 tokenizer: the UTF-8 bytes and one end token."""
    return F.octet_length(text).cast("bigint") + 1


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """The kinds of containers: a fixed table of a few rows."""
    return {r["pack_id"]: r["capacity_tokens"] for r in read(spark, sf_dir, "pack_config").collect()}


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return pack(documents.select("doc_id", byt5_tokens(F.col("text")).alias("tokens")), _capacities(spark, sf_dir))


def p8_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which piece of which document lies in which container."""
    return _placed(spark, sf_dir)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are split, from the packing of all documents."""
    return _placed(spark, sf_dir).filter("n_pieces > 1 AND piece = 1").select("pack_id", "doc_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(_placed(spark, sf_dir), _capacities(spark, sf_dir))


QUERIES = {"p8_found": p8_found, "p8_bins": p8_bins, "p8_report": p8_report}
ORACLE = {
    "p8_found": "SELECT pack_id, doc_id FROM documents, pack_config WHERE strlen(text) + 1 > capacity_tokens",
}
