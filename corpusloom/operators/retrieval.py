"""Scoring, merging and selection of evidence, for many questions at once.

Triples are tables ``(question_id, head, relation, tail, score, pos)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import vocabulary as V
from corpusloom.functions import text as T


def parsed_triples(predictions: DataFrame) -> DataFrame:
    """One row per rendered triple of ``(pred_no, question_id, retrieved_triples)``, with its parts and score."""
    rows = predictions.select("pred_no", "question_id", F.posexplode("retrieved_triples").alias("pos", "triple"))
    return rows.select(
        "pred_no", "question_id", "pos", "triple", T.triple_part(F.col("triple"), 1).alias("head"), T.triple_part(F.col("triple"), 2).alias("relation"), T.triple_part(F.col("triple"), 3).alias("tail"),
        T.score_of(F.col("triple")).alias("score"),
    )


def merge_best(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The best score per key over all paths; grouped, so hot questions are combined early."""
    return hits.groupBy(*keys).agg(F.max("score").alias("score"), F.count("*").alias("hits"))


def best_per_question(rows: DataFrame, k: int, tie: list[str]) -> DataFrame:
    """The ``k`` best rows per question; Spark keeps only ``k`` rows per task before it sorts."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), *tie)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def adjusted_score(score: Column, relation: Column, fact_intent: Column, exact: Column) -> Column:
    """Weak relations lose, relations that answer facts gain for fact questions, edges of a paper the question names gain."""
    weak = F.when(relation.isin(*V.WEAK_RELATIONS), F.when(fact_intent, -1.5 * V.WEAK_PENALTY).otherwise(-V.WEAK_PENALTY)).otherwise(0.0)
    boosts = F.create_map(*[F.lit(x) for pair in V.RELATION_BOOST.items() for x in pair])
    fact = F.when(fact_intent, F.coalesce(F.try_element_at(boosts, relation), F.lit(0.0))).otherwise(0.0)
    named = F.when(exact, 1.0 + F.when(relation.isin(*V.EXACT_MATCH_RELATIONS), 0.2).otherwise(0.0)).otherwise(0.0)
    return score + weak + fact + named


def hybrid_rerank(triples: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """0.6 of the vector score and 0.4 of the share of question keywords; lists of at most ``k`` keep their order."""
    words = questions.select("question_id", T.char_keywords(F.col("question")).alias("words"))
    n = F.count("*").over(Window.partitionBy("pred_no"))
    rows = triples.join(words, "question_id").withColumn("n", n)
    hits = F.size(F.filter("words", lambda w: F.lower(F.col("triple")).contains(w)))
    rows = rows.withColumn("combined", F.when(F.col("n") > k, 0.6 * F.coalesce("score", F.lit(0.0)) + 0.4 * hits / F.greatest(F.size("words"), F.lit(1))))
    order = Window.partitionBy("pred_no").orderBy(F.desc_nulls_last("combined"), "pos")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("pred_no", "rank", "pos", "combined")


def keyword_rerank(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Chunks ``(pred_no, question_id, pos, chunk_id, text)`` by the number of question keywords they hold, stable; no change up to ``k``."""
    words = questions.select("question_id", T.char_keywords(F.col("question")).alias("words"))
    rows = chunks.join(words, "question_id").withColumn("n", F.count("*").over(Window.partitionBy("pred_no")))
    hits = F.size(F.filter("words", lambda w: F.lower(T.empty_if_null(F.col("text"))).contains(w)))
    order = Window.partitionBy("pred_no").orderBy(F.desc(F.when(F.col("n") > k, hits).otherwise(0)), "pos")
    return rows.withColumn("hits", hits).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("pred_no", "rank", "chunk_id", "hits")


def needs_fallback(predictions: DataFrame, top_k: int) -> DataFrame:
    """Per prediction, why its retrieval is too thin: no chunks, no key relation, few triples."""
    triples = F.coalesce("retrieved_triples", F.array())
    key = F.exists(triples, lambda t: T.triple_part(t, 2).isin(*V.KEY_FACT_RELATIONS))
    reasons = F.array_compact(F.array(
        F.when(F.size(F.coalesce("retrieved_chunks", F.array())) == 0, "no_chunk_hits"), F.when(~key, "no_key_fact_relations"), F.when(F.size(triples) < max(1, top_k // 2), "low_triple_count"),
    ))
    return predictions.select("pred_no", "question_id", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) > 0).alias("fallback"))


def anchor_triples(edges: DataFrame, papers: DataFrame, per_paper: int = 2) -> DataFrame:
    """Up to ``per_paper`` edges of each hit paper, out-edges first, none of weak relation."""
    strong = edges.filter(~F.col("relation").isin(*V.WEAK_RELATIONS))
    out = strong.join(papers.select(F.col("node_id").alias("src")), "src", "left_semi").select(F.col("src").alias("paper"), F.lit(0).alias("dir"), "src", "relation", "dst")
    into = strong.join(papers.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("paper"), F.lit(1).alias("dir"), "src", "relation", "dst")
    order = Window.partitionBy("paper").orderBy("dir", "relation", "src", "dst")
    return out.unionByName(into).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_paper).select("paper", "r", "src", "relation", "dst")


def context_by_paper(chunks: DataFrame) -> DataFrame:
    """Chunks ``(pred_no, pos, chunk_id, title)`` grouped by title in order of first appearance: ``(pred_no, paper_no, title, chunk_ids)``."""
    groups = chunks.groupBy("pred_no", "title").agg(F.min("pos").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "chunk_id"))), lambda s: s["chunk_id"]), ",").alias("chunk_ids"))
    return groups.withColumn("paper_no", F.row_number().over(Window.partitionBy("pred_no").orderBy("first", "title"))).select("pred_no", "paper_no", "title", "chunk_ids")


def named_in(questions: DataFrame, names: DataFrame, gram: int = 4) -> DataFrame:
    """``(question_id, node_id)``: names of at least ``gram`` characters that the question contains.

    Joined on the name's first ``gram`` characters against all of the question's, then checked."""
    text = T.exact_match_text(F.col("question"))
    asked = questions.select("question_id", text.alias("q")).filter(F.length("q") >= gram)
    grams = asked.select("question_id", "q", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("q") - (gram - 1)), lambda i: F.col("q").substr(i, F.lit(gram))))).alias("g"))
    wanted = names.select("node_id", T.exact_match_text(F.col("name")).alias("n")).filter(F.length("n") >= gram).withColumn("g", F.col("n").substr(1, gram))
    return grams.join(wanted, "g").filter(F.col("q").contains(F.col("n"))).select("question_id", "node_id").distinct()


# Relations that are worth more in a rerank, and what they add; the weights of index score and similarity of chunks.
BONUS_RELATIONS, BONUS, LEAST_SCORE = ("is", "was", "has", "had", "contains", "located", "born", "died"), 0.1, 0.15
CHUNK_WEIGHTS = (0.35, 0.65)


def rerank_triples(triples: DataFrame) -> DataFrame:
    """Adds ``final`` and ``rank``: similarity with a bonus for some relations; weak triples go."""
    final = F.greatest(F.coalesce("score", F.lit(0.0)) + F.when(F.lower("relation").isin(*BONUS_RELATIONS), BONUS).otherwise(0.0), F.lit(0.0))
    order = Window.partitionBy("question_id").orderBy(F.desc("final"), "head", "relation", "tail")
    return triples.withColumn("final", final).filter(F.col("final") > LEAST_SCORE).withColumn("rank", F.row_number().over(order))


def rerank_chunks(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of ``(query_id, id, score, cosine)`` by the weighted sum of index score and similarity."""
    combined = CHUNK_WEIGHTS[0] * F.col("score") + CHUNK_WEIGHTS[1] * F.greatest(F.col("cosine"), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("combined", 9)), "id")
    return hits.withColumn("combined", combined).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def relevant(hits: DataFrame, candidates: DataFrame, k: int, threshold: float, most: int = 50) -> DataFrame:
    """Ranked ``hits (query_id, id, score, rank)`` that are ``candidates (query_id, id)``, have the ``threshold`` and stand among the
    first ``min(2 * candidates, most)`` of all; the best ``k`` with their new rank."""
    sizes = candidates.groupBy("query_id").agg(F.count("*").alias("n"))
    kept = hits.join(candidates, ["query_id", "id"], "left_semi").join(sizes, "query_id").filter((F.col("rank") <= F.least(2 * F.col("n"), F.lit(most))) & (F.col("score") >= threshold))
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= k).select("query_id", "id", "score", F.col("new_rank").alias("rank"))


def with_fallback(filtered: DataFrame, unfiltered: DataFrame, k: int, least: int) -> DataFrame:
    """The ``k`` best per query of ``filtered (query_id, id, score)``; queries with fewer than ``least`` also take ``unfiltered``, a hit counts once."""
    counts = filtered.groupBy("query_id").agg(F.count("*").alias("n"))
    thin = unfiltered.select("query_id").distinct().join(counts, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < least).select("query_id")
    both = filtered.withColumn("typed", F.lit(1)).unionByName(unfiltered.join(thin, "query_id", "left_semi").withColumn("typed", F.lit(0)))
    best = both.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.max("typed").alias("typed"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def entities_first(candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of ``(question_id, node_id, score, is_entity)``, entities before all others."""
    order = Window.partitionBy("question_id").orderBy(F.desc("is_entity"), F.desc("score"), "node_id")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def expand(edges: DataFrame, top: DataFrame, similar: DataFrame, threshold: float = 0.2) -> DataFrame:
    """``(question_id, src, relation, dst)``: edges between the top nodes ``(question_id, node_id)`` and their out-neighbours, in both directions.

    A neighbour of known similarity ``(question_id, node_id, sim)`` needs the threshold, unless it is a community."""
    links = edges.select("src", "relation", "dst").distinct()
    pairs = top.select("question_id", F.col("node_id").alias("src")).join(links.select("src", "dst").distinct(), "src")
    known = pairs.join(similar.select("question_id", F.col("node_id").alias("dst"), "sim"), ["question_id", "dst"], "left")
    kept = known.filter(F.col("sim").isNull() | (F.col("sim") >= threshold) | F.col("dst").startswith("community::")).select("question_id", "src", "dst")
    both = kept.unionByName(kept.select("question_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return both.join(links, ["src", "dst"]).select("question_id", "src", "relation", "dst")


def ordered_union(parts: DataFrame, group: str, item: str) -> DataFrame:
    """Items of ``(group, source, pos, item)`` in order of source and position, each at its first place: ``(group, item, rank)``."""
    first = parts.groupBy(group, item).agg(F.min(F.struct("source", "pos")).alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("at", item))).select(group, item, "rank")


def distinct_triples(triples: DataFrame) -> DataFrame:
    """Per question the first of the triples that differ in case and outer spaces only."""
    key = [F.lower(T.trim(T.empty_if_null(F.col(c)))).alias(f"{c}_key") for c in ("head", "relation", "tail")]
    rows = triples.select("question_id", *key, F.struct("pred_no", "pos").alias("at"))
    return rows.groupBy("question_id", "head_key", "relation_key", "tail_key").agg(F.min("at").alias("at"), F.count("*").alias("n")).select("question_id", "head_key", "relation_key", "tail_key", "at.pred_no", "at.pos", "n")
