"""Problem 6: keywords that appear together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.cooccurrence import item_pairs
from corpusloom.operators.packed_values import packed_arrays
from corpusloom.session import read

MIN_ROWS = 5
MIN_LIFT = 4


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword pairs of at least five rows with counts, lift and PMI."""
    rows = packed_arrays(read(spark, sf_dir, "demo_corpus"), "rec_no", {"keywords": F.col("meta.keywords")})
    return item_pairs(rows, F.transform("items", F.lower), MIN_ROWS).withColumnsRenamed({"item_a": "kw_a", "item_b": "kw_b"})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # in whole numbers, so that a lift of exactly four counts
    pairs = p6_pairs(spark, sf_dir).filter(F.col("n_ab") * F.col("n_baskets") >= MIN_LIFT * F.col("n_a") * F.col("n_b"))
    return pairs.select("kw_a", "kw_b")


QUERIES = {"p6_found": p6_found, "p6_pairs": p6_pairs}
ORACLE: dict[str, str] = {}
