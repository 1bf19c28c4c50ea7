"""Groups of similar nodes: members, context, names and super nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.vectors import cluster_count, cosine, k_means

# Types that name a community, and types that do not.
PREFERRED_TYPES = ("研究主题", "技术", "研究方法", "教学场景", "教育领域")
EXCLUDED_TYPES = ("论文", "作者", "机构", "期刊")
MAX_MEMBERS = 100
MAX_COMMUNITIES = 100


def detect(vectors: DataFrame, threshold: float = 0.5, max_members: int = MAX_MEMBERS, max_communities: int = MAX_COMMUNITIES, seed: int = 42) -> DataFrame:
    """``(id, community)``: k-means clusters, near ones merged, the largest kept.

    There are at most 200 cluster centres, so pairs of centres are few; a centre joins
    the most similar larger one if both stay within ``max_members``."""
    clustered = k_means(vectors, cluster_count(vectors.count()), seed)
    sums = clustered.select("cluster", "id", F.posexplode("vec").alias("i", "x")).groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centers = sums.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("center"))
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("n"))
    table = centers.join(sizes, "cluster")
    pairs = table.alias("a").join(table.alias("b"), (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.cluster") > F.col("b.cluster"))))
    near = pairs.select(F.col("a.cluster").alias("cluster"), F.col("b.cluster").alias("to"), (F.col("a.n") + F.col("b.n")).alias("size"), cosine(F.col("a.center"), F.col("b.center")).alias("sim"))
    best = near.filter((F.col("sim") >= threshold) & (F.col("size") <= max_members)).groupBy("cluster").agg(F.max_by("to", F.struct("sim", -F.col("to"))).alias("to"))
    # a cluster that itself moves receives none, so merged groups stay pairs of a target and its followers
    target = best.join(best.select(F.col("cluster").alias("to")), "to", "left_anti")
    renamed = clustered.join(target, "cluster", "left").select("id", F.coalesce("to", "cluster").alias("community"))
    kept = renamed.groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(max_communities)
    return renamed.join(kept.select("community"), "community", "left_semi").select("id", "community")


def context(members: DataFrame, per_list: int = 8) -> DataFrame:
    """``(community, concepts, titles)`` of ``(community, name, type, score)``: preferred types, else types not excluded, by score."""
    pool = F.when(F.col("type").isin(*PREFERRED_TYPES), 0).when(~F.col("type").isin(*EXCLUDED_TYPES), 1).when(F.col("type") == "论文", 2).otherwise(3)
    rows = members.withColumn("pool", pool)
    concept_pool = rows.filter("pool < 2").groupBy("community").agg(F.min("pool").alias("use"))
    order = Window.partitionBy("community", "pool").orderBy(F.desc("score"), "name")
    ranked = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_list).join(concept_pool, "community", "left")
    listed = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("r", "name")))), lambda s: s["name"])
    return ranked.groupBy("community").agg(listed(F.col("pool") == F.col("use")).alias("concepts"), listed(F.col("pool") == 2).alias("titles"))


def named(contexts: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """Adds ``name`` and ``description``: a proposed name if it is valid, else one made from the concepts."""
    rows = contexts
    if proposals is not None:
        rows = rows.join(proposals.select("community", T.community_name(F.col("proposed")).alias("proposed")), "community", "left")
        proposed = F.when(T.is_community_name(F.col("proposed"), F.concat("concepts", "titles")), F.col("proposed"))
    else:
        proposed = F.lit(None).cast("string")
    rows = rows.withColumn("name", F.coalesce(proposed, T.fallback_community_name(F.col("concepts"), F.col("titles"))))
    # The four sentences that describe a community.
    head, papers = F.array_join(F.slice("concepts", 1, 3), ", "), F.array_join(F.slice("titles", 1, 2), ", ")
    description = (
        F.when((F.size("concepts") > 0) & (F.size("titles") > 0), F.concat(F.lit("该社区围绕"), head, F.lit("等主题展开，代表论文包括"), papers, F.lit("。")))
        .when(F.size("concepts") > 0, F.concat(F.lit("该社区主要聚焦"), head, F.lit("等相近主题与应用方向。")))
        .when(F.size("titles") > 0, F.concat(F.lit("该社区汇聚了一组相近研究议题，代表论文包括"), papers, F.lit("。")))
        .otherwise(F.concat(F.lit("该社区聚焦与“"), "name", F.lit("”相关的一组相近节点。")))
    )
    return rows.withColumn("description", description)


def super_nodes(members: DataFrame, names: DataFrame, level: int = 4) -> tuple[DataFrame, DataFrame]:
    """Community nodes of at least two members, and ``member_of`` edges to them."""
    sizes = members.groupBy("community").agg(F.count("*").alias("n")).filter("n > 1")
    node = F.concat(F.lit(f"comm_{level}_"), F.col("community").cast("string"))
    nodes = names.join(sizes, "community").select(node.alias("node_id"), F.lit("community").alias("label"), F.lit(level).alias("level"), "name", "description")
    edges = members.join(sizes.select("community"), "community", "left_semi").select(F.col("id").alias("src"), F.lit("member_of").alias("relation"), node.alias("dst"))
    return nodes, edges
