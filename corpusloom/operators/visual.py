"""Selection of the part of a graph that is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = {"paper": "论文", "author": "作者", "organ": "机构", "journal": "期刊", "keyword": "关键词", "community": "主题社区"}


def link_tier(src_kind: Column, relation: Column, dst_kind: Column) -> Column:
    """Authorship first, then publication, affiliation, other links of papers, the rest, attributes, communities."""
    return (
        F.when((src_kind == "author") & (relation == "撰写") & (dst_kind == "paper"), 0)
        .when((src_kind == "paper") & (relation == "发表于") & (dst_kind == "journal"), 1)
        .when((src_kind == "author") & (relation == "隶属") & (dst_kind == "organ"), 2)
        .when((src_kind == "paper") | (dst_kind == "paper"), 3)
        .when(relation == "has_attribute", 5)
        .when((src_kind == "community") | (dst_kind == "community"), 6)
        .otherwise(4)
    )


def node_size(kind: Column, degree: Column) -> Column:
    return F.when(kind == "paper", F.when(degree <= 2, 18.0).otherwise(F.least(F.lit(24.0), 18 + 0.6 * degree))).otherwise(F.least(F.lit(30.0), 16 + 0.8 * degree))


def ranked_links(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """Links with tier and combined degree, in the order of preference."""
    kind = lambda c: F.substring_index(c, "::", 1)
    rows = edges.select("src", "relation", "dst").distinct()
    rows = rows.join(degrees.select(F.col("node_id").alias("src"), F.col("degree").alias("ds")), "src").join(degrees.select(F.col("node_id").alias("dst"), F.col("degree").alias("dt")), "dst")
    return rows.select("src", "relation", "dst", link_tier(kind("src"), F.col("relation"), kind("dst")).alias("tier"), (F.col("ds") + F.col("dt")).alias("weight"))


def select_links(links: DataFrame, max_links: int) -> DataFrame:
    """The first ``max_links`` links: of each tier its best link, then by preference.

    A report of bounded size: Spark keeps ``max_links`` rows per task and merges them."""
    first = Window.partitionBy("tier").orderBy(F.desc("weight"), "src", "dst", "relation")
    best = links.withColumn("r", F.row_number().over(first)).filter(F.col("r") == 1).drop("r").withColumn("phase", F.lit(0))
    rest = links.withColumn("phase", F.lit(1))
    both = best.unionByName(rest).groupBy("src", "relation", "dst", "tier", "weight").agg(F.min("phase").alias("phase"))
    return both.orderBy("phase", "tier", F.desc("weight"), "src", "dst", "relation").limit(max_links)
