"""All core queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.queries import documents, evidence, graphs, groups, packed

QUERIES = {**packed.QUERIES, **documents.QUERIES, **graphs.QUERIES, **groups.QUERIES, **evidence.QUERIES}
ORACLE = {**packed.ORACLE, **documents.ORACLE, **graphs.ORACLE, **groups.ORACLE, **evidence.ORACLE}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best edges of every paper that a prediction retrieved."""
    return graphs.anchors(spark, sf_dir)
