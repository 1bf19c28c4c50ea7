"""Queries over communities, bridges and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import allocation, communities, graph
from corpusloom.operators.sampling import random_key, sample_strata
from corpusloom.queries import sql as S
from corpusloom.queries.documents import corpus_docs
from corpusloom.queries.graphs import _KW, _plain_pool, _vectors
from corpusloom.session import materialise, read


def _members(spark, sf_dir):
    """Papers grouped by their first keyword; their other keywords are concepts, scored by frequency."""
    docs = corpus_docs(spark, sf_dir).select("doc_uid", "title", T.split_keywords(F.col("keywords")).alias("kws")).withColumn("community", F.coalesce(F.lower(F.get("kws", F.lit(0))), F.lit("misc")))
    concepts = docs.select("community", F.explode(F.slice("kws", F.lit(2), F.greatest(F.size("kws") - 1, F.lit(0)))).alias("name")).groupBy("community", "name").agg(F.count("*").cast("double").alias("score")).withColumn("type", F.lit("技术"))
    papers = docs.filter("title IS NOT NULL AND title <> ''").select("community", F.col("title").alias("name")).distinct().withColumn("score", F.lit(0.0)).withColumn("type", F.lit("论文"))
    return concepts.unionByName(papers)


def community_names(spark, sf_dir):
    named = communities.named(communities.context(_members(spark, sf_dir)))
    return named.select("community", "name", "description", F.size("concepts").alias("n_concepts"), F.size("titles").alias("n_titles"))


def detected_communities(spark, sf_dir):
    """Communities of the vectors, with their sizes."""
    return communities.detect(_vectors(spark, sf_dir)).groupBy("community").agg(F.count("*").alias("members"))


#: Relations of bridges; the first stands for two or more keywords in common.
BRIDGE_RELATIONS = ("扩展", "对比", "复用")
#: Confidence of a bridge that rests on common keywords; the gate's usual threshold of 0.75 admits none.
OVERLAP_CONFIDENCE = 0.55


def bridges(spark, sf_dir):
    """Bridges between any two papers that share at least two keywords, at most two per paper, heavy ones first."""
    docs = corpus_docs(spark, sf_dir).filter(T.trim(T.empty_if_null(F.col("title"))) != "")  # only such papers are nodes
    papers = materialise(docs.select("doc_uid", F.transform(T.split_keywords(F.col("keywords")), F.lower).alias("keys")))
    found = graph.overlap_bridges(papers.withColumnRenamed("doc_uid", "node"))
    triples = found.select(F.col("a").alias("head"), F.lit(BRIDGE_RELATIONS[0]).alias("relation"), F.col("b").alias("tail"), F.lit(OVERLAP_CONFIDENCE).alias("confidence"), F.array("a", "b").alias("source_paper_ids"), "weight")
    passed = graph.bridge_gate(triples, papers, BRIDGE_RELATIONS, OVERLAP_CONFIDENCE)
    return passed.select(F.col("head").alias("a"), F.col("tail").alias("b"), "weight")


def stratified_sample(spark, sf_dir):
    """A tenth of each run's papers by year and bin, one of each stratum at least."""
    pool = _plain_pool(spark, sf_dir).distinct()
    pool = materialise(pool)
    quotas = allocation.allocate_runs(pool.groupBy("run_id", "year", "length_bin").agg(F.count("*").alias("members")), 0.1)
    return sample_strata(pool, materialise(quotas), ["run_id", "year", "length_bin"], random_key(42, "run_id", "id"))


def document_strata(spark, sf_dir):
    """Documents by language label and length bin."""
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy(T.year_label(F.col("lang")).alias("lang"), T.length_bin(F.length(T.empty_if_null(F.col("text")))).alias("length_bin")).agg(F.count("*").alias("n"), F.sum(F.length(T.empty_if_null(F.col("text")))).alias("chars"))


def orders_by_place(spark, sf_dir):
    """Order value by region, nation and market segment, with subtotals: a star join whose small tables Spark broadcasts by size."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations, regions = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUERIES = {
    "q_community_name": community_names, "q_communities": detected_communities, "q_bridge_gate": bridges, "q_stratified_sample": stratified_sample, "q_document_strata": document_strata,
    "q_rollup_places": orders_by_place,
}

ORACLE = {
    "q_community_name": f"WITH {S.DOCS}, k AS (SELECT title, {_KW} AS v FROM docs), m AS (SELECT coalesce(lower(v[1]), 'misc') AS community, title, v FROM k), "
    "c AS (SELECT community, name, count(*) AS score FROM (SELECT community, unnest(v[2:]) AS name FROM m) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, name) <= 8), "
    "p AS (SELECT DISTINCT community, title AS name FROM m WHERE title <> '' QUALIFY dense_rank() OVER (PARTITION BY community ORDER BY title) <= 8), "
    "cc AS (SELECT community, list(name ORDER BY score DESC, name) AS cs FROM c GROUP BY 1), pp AS (SELECT community, list(name ORDER BY name) AS ts FROM p GROUP BY 1), "
    "j AS (SELECT community, coalesce(cs, []) AS cs, coalesce(ts, []) AS ts FROM cc FULL JOIN pp USING (community)), "
    "n AS (SELECT community, cs, ts, CASE WHEN len(cs) > 0 THEN array_to_string(cs[1:2], ' · ') WHEN len(ts) > 0 THEN '相关研究议题' ELSE '相关主题' END AS name FROM j) "
    "SELECT community, name, CASE WHEN len(cs) > 0 AND len(ts) > 0 THEN '该社区围绕' || array_to_string(cs[1:3], ', ') || '等主题展开，代表论文包括' || array_to_string(ts[1:2], ', ') || '。' WHEN len(cs) > 0 THEN '该社区主要聚焦' || array_to_string(cs[1:3], ', ') || '等相近主题与应用方向。' "
    "WHEN len(ts) > 0 THEN '该社区汇聚了一组相近研究议题，代表论文包括' || array_to_string(ts[1:2], ', ') || '。' ELSE '该社区聚焦与“' || name || '”相关的一组相近节点。' END AS description, len(cs) AS n_concepts, len(ts) AS n_titles FROM n",
    "q_document_strata": f"SELECT CASE WHEN {S.trim('coalesce(lang, ' + chr(39) * 2 + ')')} = '' THEN 'UNKNOWN' ELSE {S.trim('lang')} END AS lang, {S.length_bin('length(coalesce(text, ' + chr(39) * 2 + '))')} AS length_bin, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY 1, 2",
    "q_rollup_places": "SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)",
}
