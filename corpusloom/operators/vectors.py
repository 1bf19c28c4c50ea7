"""Vectors: similarity, exact top-k in blocks, centroids, overlap of neighbourhoods, k-means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialise

#: Vectors of one block; two blocks are multiplied in one task.
BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def _blocks(vectors: DataFrame, prefix: str, block: int) -> DataFrame:
    """Vectors gathered by hash into blocks of about ``block`` rows."""
    n = max(1, -(-vectors.count() // block))
    rows = vectors.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    tasks = min(n, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, "b").groupBy("b").agg(F.collect_list(F.struct("id", "label", "vec")).alias(f"{prefix}_rows")).drop("b")


_HITS = "query_id bigint, id bigint, score double"


def _multiply(k: int, same_label: bool):
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queries, rows in zip(batch.column("q_rows"), batch.column("r_rows")):
                q, r = queries.values, rows.values
                qm = np.array(q.field("vec").to_pylist(), dtype=np.float64)
                rm = np.array(r.field("vec").to_pylist(), dtype=np.float64)
                qi, ri = q.field("id").to_numpy(), r.field("id").to_numpy()
                scores = qm @ rm.T
                if same_label:
                    ql, rl = q.field("label").to_numpy(zero_copy_only=False), r.field("label").to_numpy(zero_copy_only=False)
                    scores = np.where(ql[:, None] == rl[None, :], scores, -np.inf)
                scores = np.where(qi[:, None] == ri[None, :], -np.inf, scores)
                out_q, out_r, out_s = [], [], []
                for i in range(len(qi)):
                    best = np.lexsort((ri, -scores[i]))[:k]
                    best = best[np.isfinite(scores[i][best])]
                    out_q += [qi[i]] * len(best)
                    out_r += list(ri[best])
                    out_s += list(scores[i][best])
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_r, pa.int64()), pa.array(out_s, pa.float64())], names=["query_id", "id", "score"])

    return multiply


def top_k(queries: DataFrame, vectors: DataFrame, k: int, same_label: bool = False, block: int = BLOCK) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``k`` largest inner products of each query, itself excluded, ties by id.

    Queries and vectors ``(id, label, vec)`` are put into blocks; every pair of blocks
    is one matrix product in a task, which keeps the best ``k`` of each query, and the
    blocks' bests are merged.  The pairs of blocks are streamed, not shuffled.  Null vectors take part in nothing."""
    present = F.col("vec").isNotNull()
    pairs = _blocks(queries.filter(present), "q", block).crossJoin(_blocks(vectors.filter(present), "r", block))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.mapInArrow(_multiply(k, same_label), _HITS).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def adaptive_candidates(hits: DataFrame, k: int, strict: float = 0.25, relaxed: float = 0.1) -> DataFrame:
    """Hits above ``strict``; for queries with fewer than ``max(2, k // 2)`` of them, above ``relaxed``."""
    enough = F.count_if(F.col("score") > strict).over(Window.partitionBy("query_id")) >= max(2, k // 2)
    marked = hits.withColumn("strict", enough)
    return marked.filter(F.col("score") > F.when(F.col("strict"), strict).otherwise(relaxed))


def centroids(vectors: DataFrame) -> DataFrame:
    """``(label, center)``: mean vectors, by position, combined before the shuffle."""
    parts = vectors.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = parts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("xs"))
    return ordered.select("label", F.transform("xs", lambda s: s["x"]).alias("center"))


def jaccard(sets: DataFrame, owner: str, item: str, threshold: float) -> DataFrame:
    """``(a, b, jaccard)`` of owners whose item sets overlap by at least ``threshold``, of ``(owner, item)``.

    Prefix filter: with the items of a set in order of rarity, two sets of that overlap
    share one of their first ``n - ceil(threshold * n) + 1`` items, so frequent items
    are hardly joined.  Candidates are verified on the whole sets."""
    rows = sets.select(F.col(owner).alias("o"), F.col(item).alias("i")).filter("o IS NOT NULL AND i IS NOT NULL").distinct()
    df = rows.groupBy("i").agg(F.count("*").alias("df"))
    whole = rows.join(df, "i").groupBy("o").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "i"))), lambda s: s["i"]).alias("items"))
    whole = whole.withColumn("n", F.size("items"))
    whole = materialise(whole)
    prefix = whole.select("o", "n", F.explode(F.slice("items", 1, (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))).alias("i"))
    left, right = prefix.select("i", F.col("o").alias("a"), F.col("n").alias("na")), prefix.select("i", F.col("o").alias("b"), F.col("n").alias("nb"))
    pairs = left.join(right, "i").filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))).select("a", "b").distinct()
    sized = pairs.join(whole.select(F.col("o").alias("a"), F.col("items").alias("x")), "a").join(whole.select(F.col("o").alias("b"), F.col("items").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return sized.select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("jaccard")).filter(F.col("jaccard") >= threshold)


def cluster_count(n: int) -> int:
    """Clusters for ``n`` vectors: a tenth of them, at least two, at most half of them and 200."""
    return 1 if n <= 2 else max(1, min(max(2, n // 10), n // 2, 200))


def k_means(vectors: DataFrame, k: int, seed: int = 42, starts: int = 5) -> DataFrame:
    """Adds ``cluster``; Spark's k-means in parallel initialisation, the cheapest of ``starts`` runs."""
    features = materialise(vectors.withColumn("doubles", F.transform("vec", lambda x: x.cast("double")))).withColumn("features", array_to_vector("doubles")).drop("doubles")
    models = [KMeans(k=k, seed=seed + i, maxIter=20).fit(features) for i in range(starts)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    return model.transform(features).withColumnRenamed("prediction", "cluster").drop("features")
