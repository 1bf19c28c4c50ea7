"""Queries over reranked evidence, attributes, node texts and gold facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evaluation, graph, retrieval, vectors
from corpusloom.queries import sql as S
from corpusloom.queries.documents import corpus_docs
from corpusloom.queries.graphs import _BEST, _E, _KW, _NODES, _Q, _SIM, _TOP, SEED_SHARE, _hits, _queries, _triples, _vectors, seed_nodes, unique_edges
from corpusloom.session import materialise, read


def _attributed(spark, sf_dir) -> DataFrame:
    """Metadata edges and attribute edges, once each."""
    docs = corpus_docs(spark, sf_dir)
    return materialise(graph.deduplicate(graph.metadata_edges(docs).unionByName(graph.attribute_edges(docs))))


def attribute_edges(spark, sf_dir):
    return graph.attribute_edges(corpus_docs(spark, sf_dir)).select("src", "relation", "dst", "confidence", "doc_uid", "pos")


def khop3_edges(spark, sf_dir):
    """The edges that leave what the seeds reach in three hops."""
    edges = unique_edges(spark, sf_dir)
    return graph.reached_edges(edges, graph.k_hop(edges, seed_nodes(edges), 3))


def neighbourhood_texts(spark, sf_dir):
    return graph.neighbourhood_texts(unique_edges(spark, sf_dir))


def orphan_filter(spark, sf_dir):
    """The graph among nodes that stand on records whose number is divisible by ``SEED_SHARE`` or have two neighbours."""
    edges = unique_edges(spark, sf_dir)
    nodes = graph.degrees(edges).filter("neighbours > 1").select("node_id").union(seed_nodes(edges)).distinct()
    kept, links = graph.without_orphans(nodes, edges)
    per_kind = kept.select(F.substring_index("node_id", "::", 1).alias("kind"), F.lit("node").alias("part")).unionByName(links.select(F.col("relation").alias("kind"), F.lit("link").alias("part")))
    return per_kind.groupBy("part", "kind").agg(F.count("*").alias("n"))


def category_totals(spark, sf_dir):
    return graph.nodes_of(_attributed(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


def _mentions(spark, sf_dir) -> DataFrame:
    """Names with the type of the place they stand in: authors before organisations before journals before keywords."""
    docs = corpus_docs(spark, sf_dir)
    places = [("作者", T.split_metadata(F.col("authors"))), ("机构", T.split_metadata(F.col("organ"))), ("期刊", F.array(T.trim(T.empty_if_null(F.col("source"))))), ("研究主题", T.split_keywords(F.col("keywords")))]
    parts = [docs.select("pos", F.explode(names).alias("name")).select("name", F.lit(kind).alias("type"), F.lit(i).alias("priority"), "pos") for i, (kind, names) in enumerate(places)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def entity_types(spark, sf_dir):
    """Every name has one type, however many places it stands in."""
    return graph.first_types(_mentions(spark, sf_dir))


def gold_refine(spark, sf_dir):
    """Metadata triples of every record, every third record's turned round, put right by the types of their ends."""
    edges = unique_edges(spark, sf_dir).select(F.col("pos").cast("string").alias("sample"), "src", "relation", "dst", (F.col("pos") % 3 == 0).alias("turned"))
    names = {"paper": "论文", "author": "作者", "organ": "机构", "journal": "期刊"}
    kinds = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    triples = edges.select("sample", F.when(F.col("turned"), F.col("dst")).otherwise(F.col("src")).alias("head"), "relation", F.when(F.col("turned"), F.col("src")).otherwise(F.col("dst")).alias("tail"))
    ends = edges.select("sample", F.explode(F.array("src", "dst")).alias("name")).distinct()
    types = ends.filter(~F.col("name").startswith("journal::") | (F.length("name") % 2 == 0)).select("sample", "name", kinds[F.substring_index("name", "::", 1)].alias("type"))
    return graph.refine_triples(triples, types).groupBy("relation", "swapped").agg(F.count("*").alias("n"))


def node_texts(spark, sf_dir):
    """A paper's text for retrieval and for the index: title and abstract, with what stands in for missing ones."""
    docs = corpus_docs(spark, sf_dir)
    return docs.select("pos", T.node_text(F.col("doc_uid"), F.col("title"), F.col("abstract")).alias("retrieved"), T.indexed_text(F.col("title"), F.col("abstract")).alias("indexed"))


def triple_texts(spark, sf_dir):
    """Edges as the text that is indexed and the text that is reranked; nodes of the metadata graph have no description."""
    edges = unique_edges(spark, sf_dir)
    head, tail = graph.name_of(F.col("src")), graph.name_of(F.col("dst"))
    none = F.lit(None).cast("string")
    indexed = F.concat_ws(",", T.indexed_text(head, none), "relation", T.indexed_text(tail, none))
    return edges.select("src", "relation", "dst", indexed.alias("indexed"), F.concat_ws(" ", T.node_text(F.col("src"), head, none), "relation", T.node_text(F.col("dst"), tail, none)).alias("reranked"))


def title_enrich(spark, sf_dir):
    """Authors, source and year of the last record of the same title, whatever its case."""
    docs = corpus_docs(spark, sf_dir).select("pos", "title", "authors", "source", "year").withColumn("key", F.lower(T.trim(T.empty_if_null(F.col("title"))))).filter("key <> ''")
    last = docs.groupBy("key").agg(F.max_by(F.struct(*[T.empty_if_null(F.col(c)).alias(c) for c in ("authors", "source", "year")]), "pos").alias("l"))
    return docs.select("pos", "key").join(last, "key").select("pos", "l.*")


# vectors


def triple_relevance(spark, sf_dir):
    """For each query vector the relevant ones of its own label, among the first hits over all labels."""
    hits = _hits(spark, sf_dir, 50)
    candidates = _queries(spark, sf_dir).select(F.col("id").alias("query_id"), "label").join(_vectors(spark, sf_dir).select("id", "label"), "label").filter("id <> query_id").select("query_id", "id")
    return retrieval.relevant(hits, candidates, 10, 0.1).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def chunk_weighted_rerank(spark, sf_dir):
    """The first twenty hits reranked by index score and cosine."""
    rows = _vectors(spark, sf_dir)
    hits = _hits(spark, sf_dir, 20).select("query_id", "id", "score")
    both = hits.join(rows.select("id", F.col("vec").alias("a")), "id").join(rows.select(F.col("id").alias("query_id"), F.col("vec").alias("b")), "query_id")
    ranked = retrieval.rerank_chunks(both.select("query_id", "id", "score", vectors.cosine(F.col("a"), F.col("b")).alias("cosine")), 5)
    return ranked.select("query_id", "id", "rank", F.round("combined", 6).alias("combined"))


def type_filtered_merge(spark, sf_dir):
    """Hits of the query's own label above 0.25, for queries with fewer than five of them all labels' hits too."""
    typed = _hits(spark, sf_dir, 10, True).filter("score > 0.25").select("query_id", "id", "score")
    merged = retrieval.with_fallback(typed, _hits(spark, sf_dir, 10).select("query_id", "id", "score"), 10, 5)
    return merged.select("query_id", "id", "typed", "rank", F.round("score", 6).alias("score"))


def community_keywords(spark, sf_dir):
    """The five members of each label that stand for it: how often they are hit, and how near they are to the mean."""
    hits = _hits(spark, sf_dir, 10).groupBy("id").agg(F.count("*").alias("degree"))
    rows = _vectors(spark, sf_dir)
    near = rows.join(vectors.centroids(rows), "label").join(hits, "id", "left").select("label", "id", F.coalesce("degree", F.lit(0)).alias("degree"), vectors.cosine(F.col("vec"), F.col("center")).alias("cosine"))
    most = near.groupBy("label").agg(F.greatest(F.max("degree"), F.lit(1)).alias("most"))
    score = F.round(0.3 * F.col("degree") / F.col("most") + 0.7 * F.col("cosine"), 9)
    ranked = near.join(most, "label").withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "id")))
    return ranked.filter("rank <= 5").select("label", "id", "rank", F.round("score", 6).alias("score"))


def combined_similarity(spark, sf_dir):
    """Journals by their keywords: 0.3 of the overlap of the sets and 0.7 of the cosine of the counts, for overlaps of at least 0.2."""
    words = corpus_docs(spark, sf_dir).filter("source IS NOT NULL").select("source", F.explode(T.split_keywords(F.col("keywords"))).alias("kw")).groupBy("source", F.lower("kw").alias("kw")).agg(F.count("*").cast("double").alias("n"))
    words = materialise(words)
    pairs = materialise(vectors.jaccard(words, "source", "kw", 0.2))
    # products of the counts of shared keywords, for the pairs in question only
    left = pairs.join(words.select(F.col("source").alias("a"), "kw", F.col("n").alias("x")), "a")
    dots = left.join(words.select(F.col("source").alias("b"), "kw", F.col("n").alias("y")), ["b", "kw"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    norms = words.groupBy("source").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    both = pairs.join(dots, ["a", "b"]).join(norms.select(F.col("source").alias("a"), F.col("norm").alias("na")), "a").join(norms.select(F.col("source").alias("b"), F.col("norm").alias("nb")), "b")
    return both.select("a", "b", F.round(0.3 * F.col("jaccard") + 0.7 * F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("similarity"))


# evidence


def triple_rerank(spark, sf_dir):
    merged = retrieval.merge_best(_triples(spark, sf_dir), ["question_id", "head", "relation", "tail"])
    return retrieval.rerank_triples(merged).select("question_id", "head", "relation", "tail", "rank", F.round("final", 6).alias("final"))


def case_blind_dedup(spark, sf_dir):
    return retrieval.distinct_triples(_triples(spark, sf_dir))


def ordered_chunks(spark, sf_dir):
    """Chunks of every prediction: first those a keyword of the question names, then its own, then those of the question's other predictions."""
    docs = corpus_docs(spark, sf_dir)
    own = read(spark, sf_dir, "qaprediction").select("pred_no", "question_id", F.posexplode("retrieved_chunks").alias("pos", "chunk_id"))
    keywords = docs.select(F.col("base_id").alias("chunk_id"), F.explode(T.split_keywords(F.col("keywords"))).alias("kw")).select("chunk_id", F.lower("kw").alias("kw")).filter(F.length("kw") >= 4).distinct()
    asked = read(spark, sf_dir, "demo").select("question_id", F.lower(T.empty_if_null(F.col("question"))).alias("q"))
    named = own.join(keywords, "chunk_id").join(asked, "question_id").filter(F.col("q").contains(F.col("kw"))).select("pred_no", F.lit(0).alias("source"), "pos", "chunk_id").distinct()
    others = own.select("pred_no", "question_id").distinct().join(own.groupBy("question_id", "chunk_id").agg(F.min("pred_no").alias("pos")), "question_id").select("pred_no", F.lit(2).alias("source"), F.col("pos").cast("int").alias("pos"), "chunk_id")
    parts = named.unionByName(own.select("pred_no", F.lit(1).alias("source"), "pos", "chunk_id")).unionByName(others)
    return retrieval.ordered_union(parts, "pred_no", "chunk_id")


def _node_candidates(spark, sf_dir, edges: DataFrame) -> DataFrame:
    """Nodes a question's words find, by the share of its words they hold."""
    questions = read(spark, sf_dir, "demo").select("question_id", T.char_keywords(F.col("question")).alias("words"))
    terms = questions.select("question_id", F.explode("words").alias("term"))
    found = graph.nodes_for_terms(graph.term_index(graph.nodes_of(edges)), terms).groupBy("question_id", "node_id").agg(F.count("*").alias("n"))
    sizes = questions.select("question_id", F.size("words").alias("all")).groupBy("question_id").agg(F.max("all").alias("all"))
    return found.join(sizes, "question_id").select("question_id", "node_id", (F.col("n") / F.col("all")).alias("score"), (~F.col("node_id").startswith("attribute::")).cast("int").alias("is_entity"))


def entity_first(spark, sf_dir):
    ranked = retrieval.entities_first(_node_candidates(spark, sf_dir, _attributed(spark, sf_dir)), 15)
    return ranked.select("question_id", "node_id", "is_entity", "rank", F.round("score", 6).alias("score"))


def neighbour_expansion(spark, sf_dir):
    """The edges around the nodes each question finds, towards neighbours that it does not find or that hold a fifth of its words."""
    edges = _attributed(spark, sf_dir)
    candidates = materialise(_node_candidates(spark, sf_dir, edges))
    top = retrieval.entities_first(candidates, 15).select("question_id", "node_id")
    found = retrieval.expand(edges, top, candidates.select("question_id", "node_id", F.col("score").alias("sim")))
    return found.groupBy("question_id", "relation").agg(F.count("*").alias("edges"))


def retrieval_diagnostics(spark, sf_dir):
    """Per question type: predictions, chunks, triples, empty ones, decompositions that fell back."""
    kinds = read(spark, sf_dir, "demo").select("question_id", "question_type")
    rows = read(spark, sf_dir, "qaprediction").join(kinds, "question_id")
    chunks, triples = (F.when(F.col(c).isNull(), 0).otherwise(F.size(c)) for c in ("retrieved_chunks", "retrieved_triples"))
    return rows.groupBy("question_type").agg(
        F.count("*").alias("predictions"), F.sum(chunks).alias("chunks"), F.sum(triples).alias("triples"), F.count_if(chunks == 0).alias("no_chunks"), F.count_if(triples == 0).alias("no_triples"),
        F.count_if(F.coalesce("decompose_fallback", F.lit(False))).alias("fallbacks"), F.count_distinct("question_id").alias("questions"),
    )


# evaluation


def _facts(spark, sf_dir) -> DataFrame:
    """``(base_id, gold, kind, relation, fact)``: what the first record of an id says (gold) and what its other records say."""
    docs = corpus_docs(spark, sf_dir)
    first = docs.groupBy("base_id").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1")
    rows = docs.join(first, "base_id").withColumn("gold", F.col("pos") == F.col("first"))
    fact = lambda kind, relation, text: F.struct(F.lit(kind).alias("kind"), relation.alias("relation"), text.alias("fact"))
    authors, keywords = T.split_metadata(F.col("authors")), T.split_keywords(F.col("keywords"))
    listed = F.concat(
        F.transform(authors, lambda a: fact("entity", F.lit("作者"), a)), F.transform(authors, lambda a: fact("triple", F.lit("撰写"), a)), F.transform(keywords, lambda k: fact("triple", F.lit("聚焦"), k)),
        F.transform(keywords, lambda k: fact("attribute", F.concat(F.lit("关键词: "), k), k)), F.array(fact("attribute", F.lit("摘要: "), T.empty_if_null(F.col("abstract")))),
    )
    return rows.select("base_id", "gold", F.explode(listed).alias("f")).select("base_id", "gold", "f.kind", "f.relation", T.name_key(F.col("f.fact")).alias("fact")).filter("fact <> ''")


def fact_strata(spark, sf_dir):
    """Facts shared and missed, by kind and by whether they follow from the metadata alone."""
    facts = materialise(_facts(spark, sf_dir).withColumn("stratum", evaluation.stratum(F.col("kind"), F.col("relation"))))
    keys = ["kind", "stratum", "fact"]
    counts = evaluation.set_comparison(facts.filter("gold"), facts.filter("NOT gold"), "base_id", keys, by=["kind", "stratum"])
    total = evaluation.micro_average(counts, ["kind", "stratum"])
    return total.select("kind", "stratum", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


def review_scores(spark, sf_dir):
    """Predictions as reviews, per question type: without error accepted, timed out rejected, the rest pending."""
    kinds = read(spark, sf_dir, "demo").select("question_id", "question_type")
    verdict = F.when(F.col("error").isNull(), " Accepted ").when(F.col("error") == "timeout", "REJECTED").otherwise("")
    scores = evaluation.review_scores(read(spark, sf_dir, "qaprediction").join(kinds, "question_id").withColumn("verdict", verdict), ["question_type"])
    return scores.select("question_type", "reviewed", "accepted", "rejected", "pending", F.round("precision", 6).alias("precision"))


def status_counts(spark, sf_dir):
    """Predictions by their trimmed error text."""
    return read(spark, sf_dir, "qaprediction").groupBy(T.trim(T.empty_if_null(F.col("error"))).alias("status")).agg(F.count("*").alias("n"))


def gold_triple_hits(spark, sf_dir):
    """Triples of the first prediction of a question (gold) among the first ten of its later ones."""
    rows = _triples(spark, sf_dir).select("question_id", "pred_no", "pos", F.concat_ws("|", *[T.name_key(F.col(c)) for c in ("head", "relation", "tail")]).alias("fact"))
    rows = materialise(rows)
    first = rows.groupBy("question_id").agg(F.min("pred_no").alias("first"))
    told = rows.join(first, "question_id").withColumnRenamed("question_id", "query_id")
    later = told.filter("pred_no > first").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pred_no", "pos")))
    hits = evaluation.gold_hits(told.filter("pred_no = first"), later, 10)
    return hits.select("facts", "hits", F.round("rate", 6).alias("rate"))


def review_sample(spark, sf_dir):
    """A hundred edges that several records support, drawn by hash, in order of their ends: a sample for reviewers."""
    edges = unique_edges(spark, sf_dir).filter(F.size("evidence") > 1).select("src", "relation", "dst", F.size("evidence").alias("records"))
    return edges.withColumn("key", F.md5(F.concat_ws("|", F.lit("42"), "src", "relation", "dst"))).orderBy("key").limit(100).drop("key")


def readiness(spark, sf_dir):
    """What a data set holds, in one row: relations, records with text for a chunk, questions and predictions."""
    edges = unique_edges(spark, sf_dir).agg(F.count("*").alias("relations"))
    text = T.trim(F.concat(T.empty_if_null(F.col("title")), T.empty_if_null(F.col("abstract"))))
    chunks = corpus_docs(spark, sf_dir).agg(F.count_if(text != "").alias("chunks"))
    questions, predictions = read(spark, sf_dir, "demo").agg(F.count("*").alias("questions")), read(spark, sf_dir, "qaprediction").agg(F.count("*").alias("predictions"))
    parts = [p.withColumn("one", F.lit(1)) for p in (edges, chunks, questions, predictions)]  # a row each
    return parts[0].join(parts[1], "one").join(parts[2], "one").join(parts[3], "one").drop("one")


QUERIES = {
    "q_attribute_edges": attribute_edges, "q_khop3_edges": khop3_edges, "q_neighbourhood_texts": neighbourhood_texts, "q_orphan_filter": orphan_filter, "q_category_totals": category_totals,
    "q_entity_types": entity_types, "q_gold_refine": gold_refine, "q_node_texts": node_texts, "q_triple_texts": triple_texts, "q_title_enrich": title_enrich,
    "q_triple_relevance": triple_relevance, "q_chunk_weighted_rerank": chunk_weighted_rerank, "q_type_filtered_merge": type_filtered_merge, "q_community_keywords": community_keywords, "q_combined_similarity": combined_similarity,
    "q_triple_rerank": triple_rerank, "q_case_blind_dedup": case_blind_dedup, "q_ordered_chunks": ordered_chunks, "q_entity_first": entity_first, "q_neighbour_expansion": neighbour_expansion, "q_retrieval_diagnostics": retrieval_diagnostics,
    "q_fact_strata": fact_strata, "q_review_scores": review_scores, "q_status_counts": status_counts, "q_gold_triple_hits": gold_triple_hits, "q_review_sample": review_sample, "q_readiness": readiness,
}

_N = "regexp_replace({x}, '^[a-z]+::', '')"
_SRC, _DST = _N.format(x="src"), _N.format(x="dst")
_ATTR = (
    f"attr AS (SELECT 'paper::' || doc_uid AS src, 'has_attribute' AS relation, 'attribute::关键词: ' || kw AS dst, 0.95::DOUBLE AS confidence, doc_uid, pos FROM (SELECT doc_uid, pos, unnest(list_distinct({_KW})) AS kw FROM docs WHERE {S.trim('coalesce(title, ' + chr(39) * 2 + ')')} <> '') "
    f"UNION ALL SELECT 'paper::' || doc_uid, 'has_attribute', 'attribute::年份: ' || {S.trim('year')}, 0.95::DOUBLE, doc_uid, pos FROM docs WHERE {S.trim('coalesce(title, ' + chr(39) * 2 + ')')} <> '' AND {S.trim('coalesce(year, ' + chr(39) * 2 + ')')} <> '')"
)
_ALL = f"{_E}, {_ATTR}, every AS (SELECT src, dst, relation FROM dedup UNION SELECT src, dst, relation FROM attr), ends AS (SELECT src AS node_id FROM every UNION SELECT dst FROM every), nodes AS (SELECT node_id, split_part(node_id, '::', 1) AS kind, regexp_replace(node_id, '^[a-z]+::', '') AS name FROM ends)"
_INDEX = "idx AS (SELECT DISTINCT node_id, term FROM (SELECT node_id, unnest(regexp_split_to_array(lower(name), '\\s+')) AS term FROM nodes) WHERE length(term) > 2)"
_CAND = (
    f"k AS (SELECT term, node_id FROM idx QUALIFY row_number() OVER (PARTITION BY term ORDER BY node_id) <= 50), qs AS (SELECT question_id, list_distinct({_Q}) AS words FROM demo), w AS (SELECT question_id, unnest(words) AS term FROM qs), "
    "sz AS (SELECT question_id, max(len(words)) AS a FROM qs GROUP BY 1), cand AS (SELECT question_id, node_id, count(*) / any_value(a) AS score, (node_id NOT LIKE 'attribute::%')::INT AS is_entity FROM w JOIN k USING (term) JOIN sz USING (question_id) GROUP BY 1, 2), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY is_entity DESC, score DESC, node_id) AS rank FROM cand QUALIFY rank <= 15)"
)
_DEG = "b AS (SELECT src AS node_id, dst AS other FROM dedup UNION ALL SELECT dst, src FROM dedup), degrees AS (SELECT node_id, count(DISTINCT other) AS neighbours FROM b GROUP BY node_id)"
_KEY3 = ", ".join(f"lower({S.trim('coalesce(' + c + ', ' + chr(39) * 2 + ')')}) AS {c}_key" for c in ("head", "relation", "tail"))
_FACT = (
    f"WITH {S.DOCS}, g AS (SELECT base_id, min(pos) AS first FROM docs GROUP BY base_id HAVING count(*) > 1), r AS (SELECT base_id, pos = first AS gold, {S.in_order(S.split_metadata('authors'))} AS a, {_KW} AS k, coalesce(abstract, '') AS db FROM docs JOIN g USING (base_id)), "
    "u AS (SELECT base_id, gold, 'entity' AS kind, 'all' AS stratum, unnest(a) AS fact FROM r UNION ALL SELECT base_id, gold, 'triple', 'structured', unnest(a) FROM r UNION ALL SELECT base_id, gold, 'triple', 'unstructured', unnest(k) FROM r "
    "UNION ALL SELECT base_id, gold, 'attribute', 'structured', unnest(k) FROM r UNION ALL SELECT base_id, gold, 'attribute', 'unstructured', db FROM r), "
    f"f AS (SELECT base_id, kind, stratum, {S.name_key('fact')} AS fact, bool_or(gold) AS g, bool_or(NOT gold) AS c FROM u GROUP BY 1, 2, 3, 4), "
    "t AS (SELECT kind, stratum, count(*) FILTER (WHERE g AND c) AS tp, count(*) FILTER (WHERE c AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT c) AS fn FROM f WHERE fact <> '' GROUP BY 1, 2)"
)
ORACLE = {
    "q_attribute_edges": f"{_E}, {_ATTR} SELECT src, relation, dst, confidence, doc_uid, pos FROM attr",
    "q_khop3_edges": f"{_E}, seeds AS (SELECT DISTINCT src AS node_id FROM dedup WHERE pos % {SEED_SHARE} = 0), h1 AS (SELECT DISTINCT dst AS node_id FROM dedup JOIN seeds ON src = node_id), h2 AS (SELECT DISTINCT dst AS node_id FROM dedup JOIN h1 ON src = node_id), "
    "h3 AS (SELECT DISTINCT dst AS node_id FROM dedup JOIN h2 ON src = node_id), a AS (SELECT node_id FROM seeds UNION SELECT node_id FROM h1 UNION SELECT node_id FROM h2 UNION SELECT node_id FROM h3) SELECT DISTINCT src, relation, dst FROM dedup WHERE src IN (SELECT node_id FROM a)",
    "q_neighbourhood_texts": f"{_E}, {_NODES}, f AS (SELECT DISTINCT src AS node_id, concat_ws(' ', {_SRC}, relation, {_DST}) AS fact FROM dedup), p AS (SELECT node_id, fact, row_number() OVER (PARTITION BY node_id ORDER BY fact) AS r FROM f QUALIFY r <= 8), "
    f"j AS (SELECT node_id, string_agg(fact, ' ' ORDER BY r) AS text FROM p GROUP BY 1) SELECT node_id, rtrim(left({S.spaces('coalesce(text, name)')}, 360)) AS text FROM nodes LEFT JOIN j USING (node_id)",
    "q_orphan_filter": f"{_E}, {_DEG}, n AS (SELECT node_id FROM degrees WHERE neighbours > 1 UNION SELECT src FROM dedup WHERE pos % {SEED_SHARE} = 0), l AS (SELECT src, relation, dst FROM dedup WHERE src IN (SELECT node_id FROM n) AND dst IN (SELECT node_id FROM n)), "
    "e AS (SELECT src AS node_id FROM l UNION SELECT dst FROM l) SELECT 'node' AS part, split_part(node_id, '::', 1) AS kind, count(*) AS n FROM n SEMI JOIN e USING (node_id) GROUP BY 1, 2 UNION ALL SELECT 'link', relation, count(*) FROM l GROUP BY 1, 2",
    "q_category_totals": f"{_ALL} SELECT kind, count(*) AS n FROM nodes GROUP BY kind",
    "q_entity_types": f"WITH {S.DOCS}, m AS (SELECT unnest({S.in_order(S.split_metadata('authors'))}) AS name, '作者' AS type, 0 AS priority, pos FROM docs UNION ALL SELECT unnest({S.in_order(S.split_metadata('organ'))}), '机构', 1, pos FROM docs "
    f"UNION ALL SELECT {S.trim('coalesce(source, ' + chr(39) * 2 + ')')}, '期刊', 2, pos FROM docs UNION ALL SELECT unnest({_KW}), '研究主题', 3, pos FROM docs) SELECT name, arg_min(type, priority) AS type, min(priority) AS priority FROM m WHERE {S.trim('name')} <> '' GROUP BY name",
    "q_gold_refine": f"{_E}, t AS (SELECT relation, pos % 3 = 0 AS swapped, length(CASE WHEN src LIKE 'journal::%' THEN src ELSE dst END) AS n, src LIKE 'journal::%' OR dst LIKE 'journal::%' AS j FROM dedup) SELECT relation, swapped, count(*) AS n FROM t WHERE NOT j OR n % 2 = 0 GROUP BY 1, 2",
    "q_node_texts": f"WITH {S.DOCS}, x AS (SELECT pos, doc_uid, {S.trim('coalesce(title, ' + chr(39) * 2 + ')')} AS t, {S.trim('coalesce(abstract, ' + chr(39) * 2 + ')')} AS d FROM docs) "
    "SELECT pos, CASE WHEN t = '' AND d = '' THEN '[Node: ' || doc_uid || ']' ELSE trim(t || ' ' || d) END AS retrieved, coalesce(nullif(t, ''), 'none') || ',' || coalesce(nullif(d, ''), 'none') AS indexed FROM x",
    "q_triple_texts": f"{_E}, x AS (SELECT src, relation, dst, {S.trim(_SRC)} AS h, {S.trim(_DST)} AS t FROM dedup) SELECT src, relation, dst, coalesce(nullif(h, ''), 'none') || ',none,' || relation || ',' || coalesce(nullif(t, ''), 'none') || ',none' AS indexed, "
    "CASE WHEN h = '' THEN '[Node: ' || src || ']' ELSE h END || ' ' || relation || ' ' || CASE WHEN t = '' THEN '[Node: ' || dst || ']' ELSE t END AS reranked FROM x",
    "q_title_enrich": f"WITH {S.DOCS}, k AS (SELECT pos, lower({S.trim('coalesce(title, ' + chr(39) * 2 + ')')}) AS key, coalesce(authors, '') AS authors, coalesce(source, '') AS source, coalesce(year, '') AS year FROM docs), "
    "l AS (SELECT key, arg_max(authors, pos) AS authors, arg_max(source, pos) AS source, arg_max(year, pos) AS year FROM k WHERE key <> '' GROUP BY key) SELECT pos, l.authors, l.source, l.year FROM k JOIN l USING (key)",
    "q_triple_relevance": f"WITH {_TOP}, n AS (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY label), c AS (SELECT query_id, id, score, rank FROM top JOIN n ON ql = label WHERE ql = rl AND rank <= least(2 * n, 50) AND score >= 0.1::DOUBLE) "
    "SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, round(score, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c.rank) <= 10",
    "q_chunk_weighted_rerank": f"WITH {_TOP}, c AS (SELECT query_id, top.id, 0.35::DOUBLE * score + 0.65::DOUBLE * greatest(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0) AS combined FROM top JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = top.id WHERE rank <= 20) "
    "SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(combined, 9) DESC, id) AS rank, round(combined, 6) AS combined FROM c QUALIFY rank <= 5",
    "q_type_filtered_merge": f"WITH {_TOP}, s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, {_SIM} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, r.vec_id) AS rank FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id AND q.label = r.label WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10), "
    "f AS (SELECT query_id, id, score FROM s WHERE score > 0.25::DOUBLE), n AS (SELECT query_id, count(*) AS n FROM f GROUP BY 1), u AS (SELECT query_id, id, score, 1 AS typed FROM f UNION ALL SELECT query_id, id, score, 0 FROM top LEFT JOIN n USING (query_id) WHERE rank <= 10 AND coalesce(n, 0) < 5), "
    "b AS (SELECT query_id, id, max(score) AS score, max(typed) AS typed FROM u GROUP BY 1, 2) SELECT query_id, id, typed, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, round(score, 6) AS score FROM b QUALIFY rank <= 10",
    "q_community_keywords": f"WITH {_TOP}, h AS (SELECT id, count(*) AS degree FROM top WHERE rank <= 10 GROUP BY 1), u AS (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY label, i), "
    "c AS (SELECT label, list(x ORDER BY i) AS center FROM m GROUP BY label), s AS (SELECT label, vec_id AS id, coalesce(degree, 0) AS degree, list_cosine_similarity(embedding::DOUBLE[], center) AS cosine FROM embeddings JOIN c USING (label) LEFT JOIN h ON h.id = vec_id), "
    "z AS (SELECT label, id, round(0.3::DOUBLE * degree / greatest(max(degree) OVER (PARTITION BY label), 1) + 0.7::DOUBLE * cosine, 9) AS score FROM s) SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rank, round(score, 6) AS score FROM z QUALIFY rank <= 5",
    "q_combined_similarity": f"WITH {S.DOCS}, w AS (SELECT source, lower(kw) AS kw, count(*)::DOUBLE AS n FROM (SELECT source, unnest({_KW}) AS kw FROM docs WHERE source IS NOT NULL) GROUP BY 1, 2), s AS (SELECT source, count(*) AS k, sqrt(sum(n * n)) AS norm FROM w GROUP BY 1), "
    "p AS (SELECT x.source AS a, y.source AS b, count(*) AS c, sum(x.n * y.n) AS dot FROM w x JOIN w y USING (kw) WHERE x.source < y.source GROUP BY 1, 2), j AS (SELECT a, b, c / (sa.k + sb.k - c) AS jaccard, dot / (sa.norm * sb.norm) AS cosine FROM p JOIN s sa ON a = sa.source JOIN s sb ON b = sb.source) "
    "SELECT a, b, round(0.3::DOUBLE * jaccard + 0.7::DOUBLE * cosine, 6) AS similarity FROM j WHERE jaccard >= 0.2",
    "q_triple_rerank": f"WITH {S.TRIPLES}, {_BEST}, r AS (SELECT question_id, head, relation, tail, greatest(coalesce(score, 0) + CASE WHEN lower(relation) IN ('is', 'was', 'has', 'had', 'contains', 'located', 'born', 'died') THEN 0.1::DOUBLE ELSE 0 END, 0) AS final FROM best) "
    "SELECT question_id, head, relation, tail, row_number() OVER (PARTITION BY question_id ORDER BY final DESC, head, relation, tail) AS rank, round(final, 6) AS final FROM r WHERE final > 0.15::DOUBLE",
    "q_case_blind_dedup": f"WITH {S.TRIPLES}, k AS (SELECT question_id, pred_no, pos, {_KEY3} FROM triples) SELECT question_id, head_key, relation_key, tail_key, min(pred_no) AS pred_no, arg_min(pos, struct_pack(a := pred_no, b := pos)) AS pos, count(*) AS n FROM k GROUP BY 1, 2, 3, 4",
    "q_ordered_chunks": f"WITH {S.DOCS}, ch AS (SELECT pred_no, question_id, unnest(range(len(retrieved_chunks))) AS pos, unnest(retrieved_chunks) AS chunk_id FROM qaprediction), kw AS (SELECT DISTINCT base_id AS chunk_id, lower(unnest({_KW})) AS kw FROM docs), "
    "n AS (SELECT DISTINCT pred_no, 0 AS source, ch.pos, chunk_id FROM ch JOIN kw USING (chunk_id) JOIN demo USING (question_id) WHERE length(kw) >= 4 AND contains(lower(coalesce(question, '')), kw)), o AS (SELECT question_id, chunk_id, min(pred_no) AS pos FROM ch GROUP BY 1, 2), "
    "u AS (SELECT * FROM n UNION ALL SELECT pred_no, 1, pos, chunk_id FROM ch UNION ALL SELECT p.pred_no, 2, o.pos, o.chunk_id FROM (SELECT DISTINCT pred_no, question_id FROM ch) p JOIN o USING (question_id)), f AS (SELECT pred_no, chunk_id, min(struct_pack(s := source, p := pos)) AS a FROM u GROUP BY 1, 2) "
    "SELECT pred_no, chunk_id, row_number() OVER (PARTITION BY pred_no ORDER BY a, chunk_id) AS rank FROM f",
    "q_entity_first": f"{_ALL}, {_INDEX}, {_CAND} SELECT question_id, node_id, is_entity, rank, round(score, 6) AS score FROM ranked",
    "q_neighbour_expansion": f"{_ALL}, {_INDEX}, {_CAND}, p AS (SELECT DISTINCT question_id, src, dst FROM ranked JOIN every ON src = node_id), t AS (SELECT p.question_id, src, dst FROM p LEFT JOIN cand c ON c.question_id = p.question_id AND c.node_id = dst WHERE score IS NULL OR score >= 0.2 OR dst LIKE 'community::%'), "
    "d AS (SELECT question_id, src, dst FROM t UNION SELECT question_id, dst, src FROM t) SELECT question_id, relation, count(*) AS edges FROM d JOIN every USING (src, dst) GROUP BY 1, 2",
    "q_retrieval_diagnostics": "SELECT question_type, count(*) AS predictions, sum(coalesce(len(retrieved_chunks), 0))::BIGINT AS chunks, sum(coalesce(len(retrieved_triples), 0))::BIGINT AS triples, count(*) FILTER (WHERE coalesce(len(retrieved_chunks), 0) = 0) AS no_chunks, "
    "count(*) FILTER (WHERE coalesce(len(retrieved_triples), 0) = 0) AS no_triples, count(*) FILTER (WHERE decompose_fallback) AS fallbacks, count(DISTINCT question_id) AS questions FROM qaprediction JOIN demo USING (question_id) GROUP BY 1",
    "q_fact_strata": f"{_FACT} SELECT kind, stratum, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, "
    "round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END, 6) AS accuracy FROM t",
    "q_review_scores": "WITH v AS (SELECT question_type, CASE WHEN error IS NULL THEN 'accepted' WHEN error = 'timeout' THEN 'rejected' END AS v FROM qaprediction JOIN demo USING (question_id)), c AS (SELECT question_type, count(v) AS reviewed, count(*) FILTER (WHERE v = 'accepted') AS accepted, count(*) FILTER (WHERE v = 'rejected') AS rejected, count(*) - count(v) AS pending FROM v GROUP BY 1) "
    "SELECT *, round(accepted / nullif(reviewed, 0), 6) AS precision FROM c",
    "q_status_counts": f"SELECT {S.trim('coalesce(error, ' + chr(39) * 2 + ')')} AS status, count(*) AS n FROM qaprediction GROUP BY 1",
    "q_gold_triple_hits": f"WITH {S.TRIPLES}, k AS (SELECT question_id, pred_no, pos, concat_ws('|', {S.name_key('head')}, {S.name_key('relation')}, {S.name_key('tail')}) AS fact, min(pred_no) OVER (PARTITION BY question_id) AS first FROM triples), "
    "l AS (SELECT question_id, fact, row_number() OVER (PARTITION BY question_id ORDER BY pred_no, pos) AS rank FROM k WHERE pred_no > first), g AS (SELECT DISTINCT question_id, fact FROM k WHERE pred_no = first), h AS (SELECT DISTINCT question_id, fact FROM l WHERE rank <= 10) "
    "SELECT count(*) AS facts, count(h.fact) AS hits, round(CASE WHEN count(*) > 0 THEN count(h.fact) / count(*) ELSE 0 END, 6) AS rate FROM g LEFT JOIN h USING (question_id, fact)",
    "q_review_sample": f"{_E} SELECT src, relation, dst, len(evidence) AS records FROM dedup WHERE len(evidence) > 1 ORDER BY md5(concat_ws('|', '42', src, relation, dst)) LIMIT 100",
    "q_readiness": f"{_E} SELECT (SELECT count(*) FROM dedup) AS relations, (SELECT count(*) FILTER (WHERE {S.trim('coalesce(title, ' + chr(39) * 2 + ') || coalesce(abstract, ' + chr(39) * 2 + ')')} <> '') FROM docs) AS chunks, (SELECT count(*) FROM demo) AS questions, (SELECT count(*) FROM qaprediction) AS predictions",
}
