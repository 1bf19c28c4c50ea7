"""Problem 2: variant spellings of authors and organisations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.name_variants import name_variants, variant_pairs
from corpusloom.queries.packed import corpus_items
from corpusloom.session import materialise, read


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = corpus_items(spark, sf_dir, ("authors", "organ"))
    kind = F.when(F.col("field") == "authors", "author").otherwise("organ")
    return materialise(items.groupBy(kind.alias("kind"), F.col("item").alias("name")).agg(F.count("*").alias("n")))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the entity it denotes."""
    return name_variants(_spellings(spark, sf_dir), read(spark, sf_dir, "given_alias"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(materialise(p2_entities(spark, sf_dir)))


QUERIES = {"p2_found": p2_found, "p2_entities": p2_entities}
ORACLE: dict[str, str] = {}
