"""Documents into containers of fixed capacity, none split that would fit.

A document larger than the capacity is cut into full containers and a rest; rests
and all other documents are packed by the sum-of-squares rule: an item goes where
the sum of squares of the numbers of open containers per residual gap becomes
smallest (ties: the smallest gap, so perfect fits close containers first).

Documents are spread by a hash of their id over shards of at most about
``shard_docs`` documents; each shard is packed on its own in descending size, so no
task holds more than a shard, whatever the number of documents.

Defined results: documents without size are in no container; a document of exactly
the capacity fills one; tables without documents or containers give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of one shard.
SHARD_DOCS = 50_000
_PLACED = "pack_id string, bin_id string, doc_id bigint, piece int, n_pieces int, tokens bigint"


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item by the sum-of-squares rule, items in the given order."""
    open_by_gap: dict[int, list[int]] = {}
    counts = np.zeros(capacity + 1, dtype=np.int64)
    gaps = np.zeros(0, dtype=np.int64)  # gaps of open containers, sorted
    placed = np.empty(len(sizes), dtype=np.int64)
    n_bins = 0
    for i, size in enumerate(sizes):
        at = int(np.searchsorted(gaps, size))
        # opening a container: its gap's square grows from n^2 to (n+1)^2
        rest = capacity - size
        best_gap, best_cost = -1, 2 * counts[rest] + 1 if rest else 0
        if at < len(gaps):
            fit = gaps[at:]
            left = fit - size
            cost = 1 - 2 * counts[fit] + np.where(left > 0, 2 * counts[left] + 1, 0)
            j = int(np.argmin(cost))
            if cost[j] <= best_cost:
                best_gap, best_cost = int(fit[j]), int(cost[j])
        if best_gap < 0:
            bin_no, n_bins = n_bins, n_bins + 1
        else:
            bin_no = open_by_gap[best_gap].pop()
            counts[best_gap] -= 1
            if not counts[best_gap]:
                gaps = np.delete(gaps, np.searchsorted(gaps, best_gap))
            rest = best_gap - size
        if rest:
            if not counts[rest]:
                gaps = np.insert(gaps, np.searchsorted(gaps, rest), rest)
            counts[rest] += 1
            open_by_gap.setdefault(int(rest), []).append(bin_no)
        placed[i] = bin_no
    return placed


def _pack_shard(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["tokens", "doc_id"], ascending=[False, True], ignore_index=True)
    bins = pack_sizes(frame["tokens"].to_numpy(), int(frame["capacity"].iloc[0]))
    prefix = f"s{int(frame['shard'].iloc[0])}-"
    frame["bin_id"] = [f"{prefix}{b}" for b in bins]
    return frame[[c.split()[0] for c in _PLACED.split(", ")]]


def pack(sized: DataFrame, capacities: dict[str, int], shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``(pack_id, bin_id, doc_id, piece, n_pieces, tokens)`` of ``(doc_id, tokens)``, for each kind of container."""
    usable = {k: int(c) for k, c in capacities.items() if c and c > 0}
    kinds = F.array(*[F.struct(F.lit(k).alias("pack_id"), F.lit(c).cast("bigint").alias("capacity")) for k, c in usable.items()]) if usable else F.expr("array_repeat(named_struct('pack_id', '', 'capacity', 1L), 0)")
    docs = sized.filter("tokens > 0").select("doc_id", "tokens")
    shards = max(1, math.ceil(docs.count() / shard_docs))
    items = docs.select("doc_id", "tokens", F.explode(kinds).alias("k")).select("doc_id", "tokens", "k.pack_id", "k.capacity")
    full = F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity"))).otherwise(0).cast("int")
    rest = F.col("tokens") - F.col("full") * F.col("capacity")
    items = items.withColumn("full", full).withColumn("rest", rest).withColumn("n_pieces", (F.col("full") + (F.col("rest") > 0).cast("int")).cast("int"))
    cut = items.filter("full > 0").select("pack_id", "doc_id", "n_pieces", F.col("capacity").alias("tokens"), F.explode(F.sequence(F.lit(1), F.col("full"))).alias("piece"))
    cut = cut.select("pack_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("bin_id"), "doc_id", "piece", "n_pieces", "tokens")
    left = items.filter("rest > 0").select("pack_id", "capacity", "doc_id", F.col("n_pieces").alias("piece"), "n_pieces", F.col("rest").alias("tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    return left.groupBy("pack_id", "shard").applyInPandas(_pack_shard, _PLACED).unionByName(cut)


def packing_report(placed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Per kind of container: containers used, tokens, share of unused space, and the least number that could do."""
    capacity = F.create_map(*[x for k, c in capacities.items() for x in (F.lit(k), F.lit(int(c)).cast("bigint"))])
    bins = placed.groupBy("pack_id", "bin_id").agg(F.sum("tokens").alias("tokens"))
    totals = bins.groupBy("pack_id").agg(F.count("*").alias("n_bins"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    room = F.col("n_bins") * capacity[F.col("pack_id")]
    return totals.select(
        "pack_id", "n_bins", "tokens", "fullest", (1 - F.col("tokens") / room).alias("unused_share"), F.ceil(F.col("tokens") / capacity[F.col("pack_id")]).alias("least_bins")
    )
