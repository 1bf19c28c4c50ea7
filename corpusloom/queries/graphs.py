"""Queries over the metadata graph, vectors, retrieved evidence and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import allocation, batches, evaluation, graph, retrieval, vectors, visual
from corpusloom.operators.ranking import trailing_count
from corpusloom.queries import sql as S
from corpusloom.queries.documents import corpus_docs
from corpusloom.session import materialise, read

#: Every vector whose id is divisible by this is a query against all vectors.
SEED_SHARE = 20


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.metadata_edges(corpus_docs(spark, sf_dir))


def unique_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's edges, written once, as most queries go over them several times."""
    return materialise(graph.deduplicate(graph_edges(spark, sf_dir)))


def seed_nodes(edges: DataFrame) -> DataFrame:
    """The papers and authors of every record whose number is divisible by ``SEED_SHARE``."""
    return edges.filter(F.col("pos") % SEED_SHARE == 0).select(F.col("src").alias("node_id")).distinct()


def metadata_edges(spark, sf_dir):
    return graph_edges(spark, sf_dir).select("src", "relation", "dst", "confidence", "doc_uid", "pos")


def affiliations(spark, sf_dir):
    return graph_edges(spark, sf_dir).filter("relation = '隶属'").select("src", "dst", "pos")


def triple_dedup(spark, sf_dir):
    return unique_edges(spark, sf_dir).select("src", "relation", "dst", "confidence", F.size("evidence").alias("n_evidence"), "pos")


def degree(spark, sf_dir):
    return graph.degrees(unique_edges(spark, sf_dir))


def one_hop(spark, sf_dir):
    edges = unique_edges(spark, sf_dir)
    return graph.one_hop(edges, seed_nodes(edges))


def khop3(spark, sf_dir):
    edges = unique_edges(spark, sf_dir)
    return graph.k_hop(edges, seed_nodes(edges), 3)


def paths_depth2(spark, sf_dir):
    edges = unique_edges(spark, sf_dir)
    journals = edges.filter("relation = '发表于'").select(F.col("dst").alias("node_id")).distinct()
    return graph.paths_to(edges, seed_nodes(edges), journals)


def one_hop_all(spark, sf_dir):
    """The edges of every node, each node being a query."""
    return graph.one_hop_each(unique_edges(spark, sf_dir))


def khop3_all(spark, sf_dir):
    """What every node reaches in three hops."""
    return graph.k_hop_each(unique_edges(spark, sf_dir), 3)


def paths_depth2_all(spark, sf_dir):
    """Paths from every node to the journals."""
    edges = unique_edges(spark, sf_dir).select("src", "relation", "dst")
    journals = edges.filter("relation = '发表于'").select(F.col("dst").alias("node_id")).distinct()
    return graph.paths_to(edges, graph.nodes_of(edges), journals)


def components(spark, sf_dir):
    """Authors and papers connected through authorship."""
    found = graph.components(unique_edges(spark, sf_dir).filter("relation = '撰写'"))
    return found.groupBy("component").agg(F.count("*").alias("nodes"))


def graph_export(spark, sf_dir):
    """The graph in nested form and read back; nodes told apart by label and name."""
    edges = unique_edges(spark, sf_dir)
    _, back = graph.import_rows(graph.export_rows(edges, graph.nodes_of(edges)))
    return back.select("src", "relation", "dst", "confidence", F.array_join("source_paper_ids", ",").alias("papers"))


def node_identity(spark, sf_dir):
    """Nodes by label and name against nodes by label, name and id, in the nested form."""
    edges = unique_edges(spark, sf_dir)
    nodes, _ = graph.import_rows(graph.export_rows(edges, graph.nodes_of(edges)))
    return nodes.groupBy("label").agg(F.count("*").alias("by_name"), F.sum("ends").alias("ends"))


def inverted_index(spark, sf_dir):
    index = graph.term_index(graph.nodes_of(unique_edges(spark, sf_dir)))
    return index.groupBy("term").agg(F.count("*").alias("nodes"))


def keyword_nodes(spark, sf_dir):
    words = read(spark, sf_dir, "demo").select("question_id", F.explode(T.char_keywords(F.col("question"))).alias("term"))
    index = graph.term_index(graph.nodes_of(unique_edges(spark, sf_dir)))
    return graph.nodes_for_terms(index, words).groupBy("question_id").agg(F.count("*").alias("hits"), F.count_distinct("node_id").alias("nodes"))


def named_keywords(spark, sf_dir):
    """Keywords of at least four characters that a question contains."""
    words = corpus_docs(spark, sf_dir).select(F.explode(T.split_keywords(F.col("keywords"))).alias("kw")).select(F.lower("kw").alias("name")).distinct()
    return retrieval.named_in(read(spark, sf_dir, "demo"), words.select(F.col("name").alias("node_id"), "name"))


def exact_titles(spark, sf_dir):
    """Papers whose whole title a question contains."""
    titles = corpus_docs(spark, sf_dir).select(F.col("doc_uid").alias("node_id"), F.col("title").alias("name"))
    return retrieval.named_in(read(spark, sf_dir, "demo"), titles)


def fact_units(spark, sf_dir):
    return graph.fact_units(unique_edges(spark, sf_dir))


def first_keyword_clusters(spark, sf_dir):
    words = T.split_keywords(F.col("keywords"))
    return corpus_docs(spark, sf_dir).groupBy(F.coalesce(F.lower(F.get(words, F.lit(0))), F.lit("misc")).alias("cluster")).agg(F.count("*").alias("papers"))


def keyword_bridges(spark, sf_dir):
    docs = corpus_docs(spark, sf_dir).select("doc_uid", "pos", T.split_keywords(F.col("keywords")).alias("keywords"))
    return graph.keyword_bridges(docs)


def unit_batches(spark, sf_dir):
    """Papers of one year in batches of at most twelve papers and 3,000 characters."""
    docs = corpus_docs(spark, sf_dir)
    units = docs.groupBy("doc_uid").agg(F.min(T.year_label(F.col("year"))).alias("cluster"), F.max(F.length(T.empty_if_null(F.col("abstract")))).cast("bigint").alias("size"))
    return batches.pack_batches(units.withColumnRenamed("doc_uid", "unit"), 12, 3000)


def graph_quality(spark, sf_dir):
    edges = unique_edges(spark, sf_dir)
    return graph.structure_metrics(graph.nodes_of(edges), edges)


def link_priority(spark, sf_dir):
    edges = unique_edges(spark, sf_dir)
    return visual.ranked_links(edges, graph.degrees(edges))


def shown_links(spark, sf_dir):
    """The links that are shown: at most 200."""
    edges = unique_edges(spark, sf_dir)
    return visual.select_links(visual.ranked_links(edges, graph.degrees(edges)), 200).select("src", "relation", "dst", "tier", "weight")


# vectors


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), "label", F.col("embedding").alias("vec"))


def _queries(spark, sf_dir):
    return _vectors(spark, sf_dir).filter(F.col("id") % SEED_SHARE == 0)


def _hits(spark, sf_dir, k, same_label=False):
    return vectors.top_k(_queries(spark, sf_dir), _vectors(spark, sf_dir), k, same_label)


def vector_topk(spark, sf_dir):
    return _hits(spark, sf_dir, 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def vector_topk_filtered(spark, sf_dir):
    return _hits(spark, sf_dir, 10, True).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def adaptive_candidates(spark, sf_dir):
    return vectors.adaptive_candidates(_hits(spark, sf_dir, 20), 10).groupBy("query_id").agg(F.count("*").alias("kept"), F.max("strict").alias("strict"))


def centroid_rank(spark, sf_dir):
    """The ten members of each label nearest to its mean."""
    rows = _vectors(spark, sf_dir)
    near = rows.join(vectors.centroids(rows), "label").withColumn("score", F.round(vectors.cosine(F.col("vec"), F.col("center")), 9))
    order = Window.partitionBy("label").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(order)).filter("rank <= 10").select("label", "id", "rank", F.round("score", 6).alias("score"))


def source_overlap(spark, sf_dir):
    """Journals by the overlap of their keywords."""
    words = corpus_docs(spark, sf_dir).filter("source IS NOT NULL").select("source", F.explode(T.split_keywords(F.col("keywords"))).alias("kw")).select("source", F.lower("kw").alias("kw"))
    return vectors.jaccard(words, "source", "kw", 0.2)


def label_clusters(spark, sf_dir):
    """K-means clusters against labels."""
    rows = _vectors(spark, sf_dir)
    return vectors.k_means(rows, vectors.cluster_count(rows.count())).groupBy("cluster").agg(F.count("*").alias("members"), F.count_distinct("label").alias("labels"))


def hit_at_k(spark, sf_dir):
    labels = _vectors(spark, sf_dir)
    found = _hits(spark, sf_dir, 5).join(labels.select("id", F.col("label").alias("found")), "id").join(labels.select(F.col("id").alias("query_id"), "label"), "query_id")
    return evaluation.hit_at(found, F.col("label") == F.col("found"), 5)


# retrieved evidence


def _triples(spark, sf_dir):
    return retrieval.parsed_triples(read(spark, sf_dir, "qaprediction"))


def triple_parse(spark, sf_dir):
    return _triples(spark, sf_dir).select("pred_no", "pos", "head", "relation", "tail", "score")


def merge_results(spark, sf_dir):
    """The five best distinct triples of each question over all its predictions."""
    merged = retrieval.merge_best(_triples(spark, sf_dir), ["question_id", "head", "relation", "tail"])
    return retrieval.best_per_question(merged, 5, ["head", "relation", "tail"])


def score_adjust(spark, sf_dir):
    questions = read(spark, sf_dir, "demo").select("question_id", "question")
    merged = retrieval.merge_best(_triples(spark, sf_dir), ["question_id", "head", "relation", "tail"]).join(questions, "question_id")
    exact = F.lower("question").contains(F.lower("head")) | F.lower("question").contains(F.lower("tail"))
    score = retrieval.adjusted_score(F.col("score"), F.col("relation"), T.has_fact_intent(F.col("question")), F.coalesce(exact, F.lit(False)))
    return merged.select("question_id", "head", "relation", "tail", F.round(score, 6).alias("score"))


def hybrid_rerank(spark, sf_dir):
    ranked = retrieval.hybrid_rerank(_triples(spark, sf_dir), read(spark, sf_dir, "demo"), 2)
    return ranked.select("pred_no", "rank", "pos")


def chunk_rerank(spark, sf_dir):
    texts = corpus_docs(spark, sf_dir).groupBy(F.col("base_id").alias("chunk_id")).agg(F.min_by(T.chunk_text(F.col("title"), F.col("abstract")), "pos").alias("text"))
    chunks = read(spark, sf_dir, "qaprediction").select("pred_no", "question_id", F.posexplode("retrieved_chunks").alias("pos", "chunk_id"))
    return retrieval.keyword_rerank(chunks.join(texts, "chunk_id", "left"), read(spark, sf_dir, "demo"), 1)


def context_by_paper(spark, sf_dir):
    titles = corpus_docs(spark, sf_dir).groupBy(F.col("base_id").alias("chunk_id")).agg(F.min_by(T.empty_if_null(F.col("title")), "pos").alias("title"))
    chunks = read(spark, sf_dir, "qaprediction").select("pred_no", F.posexplode("retrieved_chunks").alias("pos", "chunk_id"))
    title = F.coalesce(F.col("title"), F.concat(F.lit("[Missing content for chunk "), "chunk_id", F.lit("]")))
    return retrieval.context_by_paper(chunks.join(titles, "chunk_id", "left").withColumn("title", title))


def fallback(spark, sf_dir):
    return retrieval.needs_fallback(read(spark, sf_dir, "qaprediction"), 4)


def anchors(spark, sf_dir):
    """Two edges of every paper that a prediction retrieved."""
    docs = materialise(corpus_docs(spark, sf_dir).select("doc_uid", "base_id", "pos", "title", "source", "authors", "organ"))
    edges = materialise(graph.deduplicate(graph.metadata_edges(docs)))
    hits = read(spark, sf_dir, "qaprediction").select(F.explode("retrieved_chunks").alias("base_id")).distinct()
    papers = docs.join(hits, "base_id", "left_semi").select(F.concat(F.lit("paper::"), "doc_uid").alias("node_id")).distinct()
    return retrieval.anchor_triples(edges, papers)


def latest_prediction(spark, sf_dir):
    """The last delivered prediction of each question."""
    rows = read(spark, sf_dir, "qaprediction")
    return rows.groupBy("question_id").agg(F.max_by("pred_no", F.struct("predicted_at", "pred_no")).alias("pred_no"), F.count("*").alias("predictions"))


def resume(spark, sf_dir):
    """Questions that have no prediction without error yet."""
    done = read(spark, sf_dir, "qaprediction").filter("error IS NULL OR error = ''").select("question_id").distinct()
    return read(spark, sf_dir, "demo").join(done, "question_id", "left_anti").select("question_id", "pair_no")


# evaluation


def _keyword_facts(spark, sf_dir):
    """Keywords of the first record of an id (gold) and of its other records (candidates)."""
    docs = corpus_docs(spark, sf_dir)
    first = docs.groupBy("base_id").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1")
    words = docs.join(first, "base_id").select("base_id", (F.col("pos") == F.col("first")).alias("gold"), F.explode(T.split_keywords(F.col("keywords"))).alias("kw"))
    words = words.select("base_id", "gold", T.name_key(F.col("kw")).alias("fact")).filter("fact <> ''")
    return words.filter("gold"), words.filter("NOT gold")


def prf(spark, sf_dir):
    gold, candidate = _keyword_facts(spark, sf_dir)
    return evaluation.set_comparison(gold, candidate, "base_id", ["fact"])


def prf_micro(spark, sf_dir):
    return evaluation.micro_average(prf(spark, sf_dir))


def qa_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "qaprediction").join(read(spark, sf_dir, "demo").select("question_id", "question_type"), "question_id")
    s = evaluation.answer_summary(rows)
    return s.select("question_type", "answers", *[F.round(c, 6).alias(c) for c in ("failure_rate", "refusal_rate", "mean_latency")])


def judgment(spark, sf_dir):
    """Five judged dimensions made from a user's events: the weighted score."""
    by_user = read(spark, sf_dir, "events").groupBy("user_id").agg(*[F.avg(F.least(F.col("value") / 20 + i, F.lit(9.0))).alias(f"d{i}") for i in range(5)])
    return by_user.select("user_id", F.round(evaluation.weighted_judgment([F.coalesce(F.col(f"d{i}"), F.lit(0.0)) for i in range(5)]), 6).alias("score"))


def lowest_highest(spark, sf_dir):
    """The five slowest and the five fastest answers."""
    rows = read(spark, sf_dir, "qaprediction").filter("latency_seconds IS NOT NULL").select("pred_no", "latency_seconds")
    slow = rows.orderBy(F.desc("latency_seconds"), "pred_no").limit(5).withColumn("end", F.lit("highest"))
    return slow.unionByName(rows.orderBy("latency_seconds", "pred_no").limit(5).withColumn("end", F.lit("lowest")))


def _plain_pool(spark, sf_dir):
    """Papers of the sampling pool with what their year and bin say literally."""
    return read(spark, sf_dir, "kgval_pool").filter("id IS NOT NULL AND id <> ''").select("run_id", "id", T.year_label(F.col("year")).alias("year"), T.year_label(F.col("length_bin")).alias("length_bin"))


def strata_counts(spark, sf_dir):
    """Papers by year, by length bin and by both, in one pass."""
    pool = _plain_pool(spark, sf_dir)
    year, bin_ = F.col("year"), F.col("length_bin")
    sets = pool.groupingSets([[year], [bin_], [year, bin_]], year, bin_)
    return sets.agg(F.count("*").alias("n"), F.grouping("year").alias("no_year"), F.grouping("length_bin").alias("no_bin"))


def strata_allocation(spark, sf_dir):
    """Quotas for a tenth of each run."""
    strata = _plain_pool(spark, sf_dir).groupBy("run_id", "year", "length_bin").agg(F.count("*").alias("members"))
    return allocation.allocate_runs(strata, 0.1)


def rate_window(spark, sf_dir):
    """Events of a user within the last 60 seconds, the event itself included."""
    return trailing_count(read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")), 60_000_000).select("event_id", "recent")


def cross_tab(spark, sf_dir):
    """Event value by type and day: both totals and the grand total."""
    return read(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).cube("event_type", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


QUERIES = {
    "q_metadata_edges": metadata_edges, "q_positional_affiliation": affiliations, "q_triple_dedup": triple_dedup, "q_degree": degree, "q_one_hop": one_hop, "q_khop3": khop3,
    "q_one_hop_all": one_hop_all, "q_khop3_all": khop3_all, "q_paths_depth2_all": paths_depth2_all,
    "q_paths_depth2": paths_depth2, "q_components": components, "q_graph_export": graph_export, "q_node_identity": node_identity, "q_inverted_index": inverted_index, "q_keyword_nodes": keyword_nodes,
    "q_named_keywords": named_keywords, "q_exact_title_match": exact_titles, "q_fact_units": fact_units, "q_first_keyword_cluster": first_keyword_clusters, "q_keyword_overlap_bridges": keyword_bridges, "q_unit_batches": unit_batches,
    "q_graph_quality": graph_quality, "q_link_priority": link_priority, "q_shown_links": shown_links,
    "q_vector_topk": vector_topk, "q_vector_topk_filtered": vector_topk_filtered, "q_cosine_threshold_adaptive": adaptive_candidates, "q_centroid_rank": centroid_rank, "q_jaccard": source_overlap,
    "q_kmeans": label_clusters, "q_hit_at_k": hit_at_k,
    "q_triple_parse": triple_parse, "q_merge_results": merge_results, "q_score_adjust": score_adjust, "q_hybrid_rerank": hybrid_rerank, "q_chunk_rerank": chunk_rerank, "q_context_by_paper": context_by_paper,
    "q_fallback_trigger": fallback, "q_anchor_injection": anchors, "q_latest_prediction": latest_prediction, "q_resume_antijoin": resume,
    "q_prf_entities": prf, "q_prf_micro": prf_micro, "q_qa_summary": qa_summary, "q_weighted_judgment": judgment, "q_lowest_highest": lowest_highest,
    "q_strata_counts": strata_counts, "q_strata_allocation": strata_allocation, "q_rate_window": rate_window, "q_events_cube": cross_tab,
}

_E = f"WITH {S.EDGES}"
_SEEDS = "seeds AS (SELECT DISTINCT src AS node_id FROM dedup WHERE pos % 20 = 0)"
_NODES = "ends AS (SELECT src AS node_id FROM dedup UNION SELECT dst FROM dedup), nodes AS (SELECT node_id, split_part(node_id, '::', 1) AS kind, regexp_replace(node_id, '^[a-z]+::', '') AS name FROM ends)"
_DEG = "b AS (SELECT src AS node_id, dst AS other FROM dedup UNION ALL SELECT dst, src FROM dedup), degrees AS (SELECT node_id, count(*) AS degree, count(DISTINCT other) AS neighbours FROM b GROUP BY node_id)"
_INDEX = "idx AS (SELECT DISTINCT node_id, term FROM (SELECT node_id, unnest(regexp_split_to_array(lower(name), '\\s+')) AS term FROM nodes) WHERE length(term) > 2)"
_TIER = (
    "CASE WHEN src LIKE 'author::%' AND relation = '撰写' AND dst LIKE 'paper::%' THEN 0 WHEN src LIKE 'paper::%' AND relation = '发表于' AND dst LIKE 'journal::%' THEN 1 "
    "WHEN src LIKE 'author::%' AND relation = '隶属' AND dst LIKE 'organ::%' THEN 2 WHEN src LIKE 'paper::%' OR dst LIKE 'paper::%' THEN 3 WHEN relation = 'has_attribute' THEN 5 "
    "WHEN src LIKE 'community::%' OR dst LIKE 'community::%' THEN 6 ELSE 4 END"
)
_LINKS = f"links AS (SELECT src, relation, dst, {_TIER} AS tier, (s.degree + t.degree)::BIGINT AS weight FROM dedup JOIN degrees s ON s.node_id = src JOIN degrees t ON t.node_id = dst)"
_KW = f"list_filter(list_transform(regexp_split_to_array(coalesce(keywords, ''), '[;；,，|/\\\\]+'), lambda p: {S.trim('p')}), lambda p: p <> '')"
_SIM = "list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[])"
_TOP = f"top AS (SELECT q.vec_id AS query_id, r.vec_id AS id, {_SIM} AS score, q.label AS ql, r.label AS rl, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, r.vec_id) AS rank FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)"
_BEST = "best AS (SELECT question_id, head, relation, tail, max(score) AS score, count(*) AS hits FROM triples GROUP BY question_id, head, relation, tail)"
_CHUNKS = "ch AS (SELECT pred_no, question_id, unnest(range(len(retrieved_chunks))) AS pos, unnest(retrieved_chunks) AS chunk_id FROM qaprediction)"
_FACTS = (
    f"WITH {S.DOCS}, g AS (SELECT base_id, min(pos) AS first FROM docs GROUP BY base_id HAVING count(*) > 1), w AS (SELECT base_id, pos = first AS gold, unnest({_KW}) AS kw FROM docs JOIN g USING (base_id)), "
    f"f AS (SELECT base_id, {S.name_key('kw')} AS fact, bool_or(gold) AS g, bool_or(NOT gold) AS c FROM w GROUP BY 1, 2), "
    "p AS (SELECT base_id, count(*) FILTER (WHERE g AND c) AS tp, count(*) FILTER (WHERE c AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT c) AS fn FROM f WHERE fact <> '' GROUP BY base_id)"
)
_POOL = f"pool AS (SELECT run_id, CASE WHEN {S.trim(chr(99) + 'oalesce(year, ' + chr(39) * 2 + ')')} = '' THEN 'UNKNOWN' ELSE {S.trim('year')} END AS year, CASE WHEN {S.trim('coalesce(length_bin, ' + chr(39) * 2 + ')')} = '' THEN 'UNKNOWN' ELSE {S.trim('length_bin')} END AS length_bin FROM kgval_pool WHERE id IS NOT NULL AND id <> '')"
_INTENT = "regexp_matches(lower(coalesce(question, '')), '谁|作者|撰写|提出|框架|方法|期刊|发表于|是什么|who|author|framework|method')"
_Q = S.CHAR_KEYWORDS.format(q="question")
ORACLE = {
    "q_metadata_edges": f"{_E} SELECT src, relation, dst, confidence, doc_uid, pos FROM edges",
    "q_positional_affiliation": f"{_E} SELECT src, dst, pos FROM edges WHERE relation = '隶属'",
    "q_triple_dedup": f"{_E} SELECT src, relation, dst, confidence, len(evidence) AS n_evidence, pos FROM dedup",
    "q_degree": f"{_E}, {_DEG} SELECT * FROM degrees",
    "q_one_hop": f"{_E}, {_SEEDS} SELECT DISTINCT src, relation, dst FROM dedup WHERE src IN (SELECT node_id FROM seeds) OR dst IN (SELECT node_id FROM seeds)",
    "q_khop3": f"{_E}, {_SEEDS}, h1 AS (SELECT DISTINCT dst AS node_id FROM dedup JOIN seeds ON src = node_id), h2 AS (SELECT DISTINCT dst AS node_id FROM dedup JOIN h1 ON src = node_id), "
    "h3 AS (SELECT DISTINCT dst AS node_id FROM dedup JOIN h2 ON src = node_id), a AS (SELECT node_id, 0 AS d FROM seeds UNION ALL SELECT node_id, 1 FROM h1 UNION ALL SELECT node_id, 2 FROM h2 UNION ALL SELECT node_id, 3 FROM h3) "
    "SELECT node_id, min(d) AS depth FROM a GROUP BY node_id",
    "q_paths_depth2": f"{_E}, {_SEEDS}, l AS (SELECT DISTINCT src, dst FROM dedup), j AS (SELECT DISTINCT dst FROM dedup WHERE relation = '发表于') "
    "SELECT l.src AS start, NULL AS middle, l.dst AS target FROM l JOIN seeds ON l.src = node_id WHERE l.dst IN (SELECT dst FROM j) "
    "UNION ALL SELECT a.src, a.dst, b.dst FROM l a JOIN seeds ON a.src = node_id JOIN l b ON a.dst = b.src WHERE b.dst IN (SELECT dst FROM j) AND a.src <> b.dst",
    "q_one_hop_all": f"{_E} SELECT DISTINCT src AS node_id, src, relation, dst FROM dedup UNION SELECT dst, src, relation, dst FROM dedup",
    "q_khop3_all": f"{_E}, l AS (SELECT DISTINCT src, dst FROM dedup), n AS (SELECT src AS node_id FROM l UNION SELECT dst FROM l), h1 AS (SELECT src AS seed, dst AS node_id FROM l), "
    "h2 AS (SELECT DISTINCT seed, dst AS node_id FROM h1 JOIN l ON src = node_id), h3 AS (SELECT DISTINCT seed, dst AS node_id FROM h2 JOIN l ON src = node_id), "
    "a AS (SELECT node_id AS seed, node_id, 0 AS d FROM n UNION ALL SELECT seed, node_id, 1 FROM h1 UNION ALL SELECT seed, node_id, 2 FROM h2 UNION ALL SELECT seed, node_id, 3 FROM h3) "
    "SELECT seed, node_id, min(d) AS depth FROM a GROUP BY seed, node_id",
    "q_paths_depth2_all": f"{_E}, l AS (SELECT DISTINCT src, dst FROM dedup), j AS (SELECT DISTINCT dst FROM dedup WHERE relation = '发表于') "
    "SELECT src AS start, NULL AS middle, dst AS target FROM l WHERE dst IN (SELECT dst FROM j) "
    "UNION ALL SELECT a.src, a.dst, b.dst FROM l a JOIN l b ON a.dst = b.src WHERE b.dst IN (SELECT dst FROM j) AND a.src <> b.dst",
    "q_graph_export": f"{_E} SELECT replace(src, '::', '|') AS src, relation, replace(dst, '::', '|') AS dst, confidence, array_to_string(evidence, ',') AS papers FROM dedup",
    "q_node_identity": f"{_E}, e AS (SELECT src AS n FROM dedup UNION ALL SELECT dst FROM dedup) SELECT split_part(n, '::', 1) AS label, count(DISTINCT n) AS by_name, count(*) AS ends FROM e GROUP BY 1",
    "q_inverted_index": f"{_E}, {_NODES}, {_INDEX} SELECT term, count(*) AS nodes FROM idx GROUP BY term",
    "q_keyword_nodes": f"{_E}, {_NODES}, {_INDEX}, k AS (SELECT term, node_id FROM idx QUALIFY row_number() OVER (PARTITION BY term ORDER BY node_id) <= 50), w AS (SELECT question_id, unnest(list_distinct({_Q})) AS term FROM demo) "
    "SELECT question_id, count(*) AS hits, count(DISTINCT node_id) AS nodes FROM w JOIN k USING (term) GROUP BY question_id",
    "q_exact_title_match": f"WITH {S.DOCS}, n AS (SELECT doc_uid, trim(regexp_replace(replace(lower(title), 'ς', 'σ'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ') AS key FROM docs), "
    "q AS (SELECT question_id, trim(regexp_replace(replace(lower(coalesce(question, '')), 'ς', 'σ'), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' ') AS q FROM demo) "
    "SELECT DISTINCT question_id, doc_uid AS node_id FROM q JOIN n ON length(key) >= 4 AND contains(q, key)",
    "q_named_keywords": f"WITH {S.DOCS}, k AS (SELECT DISTINCT lower(unnest({_KW})) AS name FROM docs), n AS (SELECT name, trim(regexp_replace(replace(lower(name), 'ς', 'σ'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ') AS key FROM k), "
    "q AS (SELECT question_id, trim(regexp_replace(replace(lower(coalesce(question, '')), 'ς', 'σ'), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' ') AS q FROM demo) "
    "SELECT DISTINCT question_id, name AS node_id FROM q JOIN n ON length(key) >= 4 AND contains(q, key)",
    "q_fact_units": f"{_E}, f AS (SELECT src AS paper, 0 AS dir, src, relation, dst FROM dedup WHERE src LIKE 'paper::%' UNION ALL SELECT dst, 1, src, relation, dst FROM dedup WHERE dst LIKE 'paper::%') "
    "SELECT paper, row_number() OVER (PARTITION BY paper ORDER BY dir, relation, src, dst) AS r, concat_ws(' ', regexp_replace(src, '^[a-z]+::', ''), relation, regexp_replace(dst, '^[a-z]+::', '')) AS fact FROM f QUALIFY r <= 8",
    "q_first_keyword_cluster": f"WITH {S.DOCS}, k AS (SELECT {_KW} AS v FROM docs) SELECT coalesce(lower(v[1]), 'misc') AS cluster, count(*) AS papers FROM k GROUP BY 1",
    "q_keyword_overlap_bridges": f"WITH {S.DOCS}, k AS (SELECT doc_uid, pos, {_KW} AS v FROM docs), b AS (SELECT doc_uid, v, coalesce(lower(v[1]), 'misc') AS cluster, row_number() OVER (PARTITION BY coalesce(lower(v[1]), 'misc') ORDER BY doc_uid, pos) AS rn FROM k), "
    "c AS (SELECT concat_ws('#', cluster, ((rn - 1) // 12)::VARCHAR) AS batch, rn, doc_uid, v FROM b), w AS (SELECT DISTINCT batch, rn, doc_uid, lower(unnest(v)) AS kw FROM c), "
    "p AS (SELECT x.batch, x.rn AS i, y.rn AS j, x.doc_uid AS a, y.doc_uid AS b, count(*) AS shared FROM w x JOIN w y ON x.batch = y.batch AND x.kw = y.kw AND x.rn < y.rn GROUP BY ALL) "
    "SELECT batch, a, b, shared FROM p QUALIFY row_number() OVER (PARTITION BY batch ORDER BY i, j) <= 4",
    "q_graph_quality": f"{_E}, {_NODES}, g AS (SELECT kind, {S.name_key('name')} AS key, count(*) AS n FROM nodes GROUP BY 1, 2), d AS (SELECT sum(n)::BIGINT AS primary_nodes, sum(n - 1)::BIGINT AS duplicates, count(*) FILTER (WHERE n > 1) AS alias_groups, coalesce(sum(n) FILTER (WHERE kind = 'paper'), 0)::BIGINT AS papers FROM g), "
    "e AS (SELECT count(*) AS edges, count(*) FILTER (WHERE len(evidence) > 1) AS cross_doc_edges FROM dedup) SELECT d.*, e.*, duplicates / greatest(primary_nodes, 1) AS duplicate_rate FROM d, e",
    "q_link_priority": f"{_E}, {_DEG}, {_LINKS} SELECT * FROM links",
    "q_shown_links": f"{_E}, {_DEG}, {_LINKS}, p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY tier ORDER BY weight DESC, src, dst, relation) = 1 THEN 0 ELSE 1 END AS phase FROM links) "
    "SELECT src, relation, dst, tier, weight FROM p ORDER BY phase, tier, weight DESC, src, dst, relation LIMIT 200",
    "q_vector_topk": f"WITH {_TOP} SELECT query_id, id, rank, round(score, 6) AS score FROM top WHERE rank <= 10",
    "q_vector_topk_filtered": f"SELECT q.vec_id AS query_id, r.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, r.vec_id) AS rank, round({_SIM}, 6) AS score FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id AND q.label = r.label WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10",
    "q_cosine_threshold_adaptive": f"WITH {_TOP}, t AS (SELECT *, count(*) FILTER (WHERE score > 0.25::DOUBLE) OVER (PARTITION BY query_id) >= 5 AS strict FROM top WHERE rank <= 20) "
    "SELECT query_id, count(*) AS kept, bool_or(strict) AS strict FROM t WHERE score > CASE WHEN strict THEN 0.25::DOUBLE ELSE 0.1::DOUBLE END GROUP BY query_id",
    "q_centroid_rank": "WITH u AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY label, i), c AS (SELECT label, list(x ORDER BY i) AS center FROM m GROUP BY label), "
    "s AS (SELECT label, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], center), 9) AS score FROM embeddings JOIN c USING (label)) "
    "SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 10",
    "q_jaccard": f"WITH {S.DOCS}, w AS (SELECT DISTINCT source, lower(kw) AS kw FROM (SELECT source, unnest({_KW}) AS kw FROM docs WHERE source IS NOT NULL)), n AS (SELECT source, count(*) AS n FROM w GROUP BY source), "
    "p AS (SELECT x.source AS a, y.source AS b, count(*) AS both_n FROM w x JOIN w y USING (kw) WHERE x.source < y.source GROUP BY 1, 2) "
    "SELECT a, b, both_n / (na.n + nb.n - both_n) AS jaccard FROM p JOIN n na ON a = na.source JOIN n nb ON b = nb.source WHERE both_n / (na.n + nb.n - both_n) >= 0.2",
    "q_hit_at_k": f"WITH {_TOP}, p AS (SELECT query_id, max((ql = rl)::INT) AS hit, avg((ql = rl)::INT) AS p FROM top WHERE rank <= 5 GROUP BY query_id) SELECT count(*) AS queries, avg(hit) AS hit_rate, avg(p) AS precision FROM p",
    "q_triple_parse": f"WITH {S.TRIPLES} SELECT pred_no, pos, head, relation, tail, score FROM triples",
    "q_merge_results": f"WITH {S.TRIPLES}, {_BEST} SELECT question_id, head, relation, tail, score, hits, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, head, relation, tail) AS rank FROM best QUALIFY rank <= 5",
    "q_score_adjust": f"WITH {S.TRIPLES}, {_BEST} SELECT question_id, head, relation, tail, round(score + CASE WHEN relation IN ('member_of', 'keyword_of', 'describes', 'represented_by', 'kw_filter_by') THEN CASE WHEN {_INTENT} THEN -1.5::DOUBLE * 0.2::DOUBLE ELSE -0.2::DOUBLE END ELSE 0 END "
    f"+ CASE WHEN {_INTENT} THEN CASE relation WHEN '撰写' THEN 0.15::DOUBLE WHEN '提出' THEN 0.12::DOUBLE WHEN '定义' THEN 0.10::DOUBLE WHEN '发表于' THEN 0.08::DOUBLE WHEN '应用于' THEN 0.06::DOUBLE WHEN '聚焦' THEN 0.04::DOUBLE ELSE 0 END ELSE 0 END "
    "+ CASE WHEN contains(lower(question), lower(head)) OR contains(lower(question), lower(tail)) THEN 1.0::DOUBLE + CASE WHEN relation IN ('撰写', '提出', '发表于', '采用', '聚焦') THEN 0.2::DOUBLE ELSE 0 END ELSE 0 END, 6) AS score FROM best JOIN demo USING (question_id)",
    "q_hybrid_rerank": f"WITH {S.TRIPLES}, w AS (SELECT question_id, list_distinct({_Q}) AS words FROM demo), r AS (SELECT pred_no, pos, CASE WHEN count(*) OVER (PARTITION BY pred_no) > 2 THEN 0.6::DOUBLE * coalesce(score, 0) + 0.4::DOUBLE * len(list_filter(words, lambda x: contains(lower(triple), x))) / greatest(len(words), 1) END AS combined FROM triples JOIN w USING (question_id)) "
    "SELECT pred_no, row_number() OVER (PARTITION BY pred_no ORDER BY combined DESC NULLS LAST, pos) AS rank, pos FROM r QUALIFY rank <= 2",
    "q_chunk_rerank": f"WITH {S.DOCS}, {_CHUNKS}, t AS (SELECT base_id AS chunk_id, arg_min('Title: ' || coalesce(title, '') || chr(10) || 'Abstract: ' || coalesce(abstract, ''), pos) AS text FROM docs GROUP BY 1), w AS (SELECT question_id, list_distinct({_Q}) AS words FROM demo), "
    "r AS (SELECT pred_no, ch.pos, chunk_id, len(list_filter(words, lambda x: contains(lower(coalesce(text, '')), x))) AS hits, count(*) OVER (PARTITION BY pred_no) AS n FROM ch LEFT JOIN t USING (chunk_id) JOIN w USING (question_id)) "
    "SELECT pred_no, row_number() OVER (PARTITION BY pred_no ORDER BY CASE WHEN n > 1 THEN hits ELSE 0 END DESC, pos) AS rank, chunk_id, hits FROM r QUALIFY rank <= 1",
    "q_context_by_paper": f"WITH {S.DOCS}, {_CHUNKS}, t AS (SELECT base_id AS chunk_id, arg_min(coalesce(title, ''), pos) AS title FROM docs GROUP BY 1), r AS (SELECT pred_no, ch.pos, chunk_id, coalesce(title, '[Missing content for chunk ' || chunk_id || ']') AS title FROM ch LEFT JOIN t USING (chunk_id)), "
    "g AS (SELECT pred_no, title, min(pos) AS f, string_agg(chunk_id, ',' ORDER BY pos) AS chunk_ids FROM r GROUP BY pred_no, title) SELECT pred_no, row_number() OVER (PARTITION BY pred_no ORDER BY f, title) AS paper_no, title, chunk_ids FROM g",
    "q_fallback_trigger": f"WITH {S.TRIPLES}, k AS (SELECT DISTINCT pred_no FROM triples WHERE relation IN ('撰写', '提出', '定义', '应用于', '聚焦')) SELECT pred_no, question_id, concat_ws(',', CASE WHEN len(coalesce(retrieved_chunks, [])) = 0 THEN 'no_chunk_hits' END, "
    "CASE WHEN pred_no NOT IN (SELECT pred_no FROM k) THEN 'no_key_fact_relations' END, CASE WHEN len(coalesce(retrieved_triples, [])) < 2 THEN 'low_triple_count' END) AS reasons, "
    "len(coalesce(retrieved_chunks, [])) = 0 OR pred_no NOT IN (SELECT pred_no FROM k) OR len(coalesce(retrieved_triples, [])) < 2 AS fallback FROM qaprediction",
    "q_anchor_injection": f"{_E}, h AS (SELECT DISTINCT unnest(retrieved_chunks) AS base_id FROM qaprediction), p AS (SELECT DISTINCT 'paper::' || doc_uid AS paper FROM docs WHERE base_id IN (SELECT base_id FROM h)), "
    "f AS (SELECT src AS paper, 0 AS dir, src, relation, dst FROM dedup UNION ALL SELECT dst, 1, src, relation, dst FROM dedup) SELECT paper, row_number() OVER (PARTITION BY paper ORDER BY dir, relation, src, dst) AS r, src, relation, dst FROM f JOIN p USING (paper) QUALIFY r <= 2",
    "q_latest_prediction": "SELECT question_id, arg_max(pred_no, struct_pack(a := predicted_at, b := pred_no)) AS pred_no, count(*) AS predictions FROM qaprediction GROUP BY question_id",
    "q_resume_antijoin": "SELECT question_id, pair_no FROM demo WHERE question_id NOT IN (SELECT question_id FROM qaprediction WHERE (error IS NULL OR error = '') AND question_id IS NOT NULL)",
    "q_prf_entities": f"{_FACTS} SELECT * FROM p",
    "q_prf_micro": f"{_FACTS}, t AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM p) SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, tp / (tp + fp + fn) AS accuracy FROM t",
    "q_qa_summary": f"WITH j AS (SELECT CASE WHEN {S.trim('coalesce(question_type, ' + chr(39) * 2 + ')')} = '' THEN '未分类' ELSE question_type END AS question_type, p.answer AS answer, p.error AS error, latency_seconds FROM qaprediction p JOIN demo USING (question_id)) "
    "SELECT question_type, count(*) AS answers, round(avg(CASE WHEN coalesce(error, '') <> '' THEN 1.0::DOUBLE ELSE 0 END), 6) AS failure_rate, round(avg(CASE WHEN regexp_matches(lower(coalesce(answer, '')), '无法回答|不能回答|现有资料不足|insufficient|cannot answer|not enough information') THEN 1.0::DOUBLE ELSE 0 END), 6) AS refusal_rate, round(avg(latency_seconds), 6) AS mean_latency FROM j GROUP BY 1",
    "q_weighted_judgment": "WITH d AS (SELECT user_id, avg(least(value / 20 + 0, 9)) AS d0, avg(least(value / 20 + 1, 9)) AS d1, avg(least(value / 20 + 2, 9)) AS d2, avg(least(value / 20 + 3, 9)) AS d3, avg(least(value / 20 + 4, 9)) AS d4 FROM events GROUP BY user_id) "
    "SELECT user_id, round(0.3::DOUBLE * least(greatest(coalesce(d0, 0), 1), 5) + 0.2::DOUBLE * least(greatest(coalesce(d1, 0), 1), 5) + 0.2::DOUBLE * least(greatest(coalesce(d2, 0), 1), 5) + 0.15::DOUBLE * least(greatest(coalesce(d3, 0), 1), 5) + 0.15::DOUBLE * least(greatest(coalesce(d4, 0), 1), 5), 6) AS score FROM d",
    "q_lowest_highest": "(SELECT pred_no, latency_seconds, 'highest' AS \"end\" FROM qaprediction WHERE latency_seconds IS NOT NULL ORDER BY latency_seconds DESC, pred_no LIMIT 5) UNION ALL (SELECT pred_no, latency_seconds, 'lowest' FROM qaprediction WHERE latency_seconds IS NOT NULL ORDER BY latency_seconds, pred_no LIMIT 5)",
    "q_strata_counts": f"WITH {_POOL} SELECT year, length_bin, count(*) AS n, grouping(year) AS no_year, grouping(length_bin) AS no_bin FROM pool GROUP BY GROUPING SETS ((year), (length_bin), (year, length_bin))",
    "q_rate_window": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS recent FROM events",
    "q_events_cube": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY CUBE (event_type, strftime(ts, '%Y-%m-%d'))",
}
