"""Items that appear together in the same basket, against chance.

Items are deduplicated per basket, ordered pairs are emitted once per basket, and
counts are combined on the map side before they are shuffled, so a pair that
occurs in a third of all baskets costs one row per task.  Lift is
``n_ab * N / (n_a * n_b)`` and PMI its logarithm to base 2, with ``N`` the number
of baskets that hold at least one item.

Defined results: null baskets, empty ones and null items count nowhere; repeated
items count once per basket; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.selection import pairs_within
from corpusloom.session import materialise

#: Items of a basket whose pairs one task lists.
WIDE = 1000


def item_pairs(baskets: DataFrame, items: Column, min_count: int = 1) -> DataFrame:
    """``(item_a, item_b, n_ab, n_a, n_b, n_baskets, lift, pmi)`` of the pairs in at least ``min_count`` baskets."""
    sets = baskets.select(F.array_sort(F.array_distinct(F.array_compact(items))).alias("items")).filter(F.size("items") > 0)
    sets = materialise(sets)
    n_baskets = F.lit(sets.count())
    singles = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    narrow = (
        sets.filter((F.size("items") > 1) & (F.size("items") <= WIDE))
        .select("items", F.posexplode("items").alias("i", "item_a"))
        .select("item_a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("item_b"), F.lit(1).cast("bigint").alias("w"))
    )
    # the pairs of a wide basket are written by several tasks; equal ones count together
    wide = sets.filter(F.size("items") > WIDE).groupBy("items").agg(F.count("*").alias("w"))
    members = wide.select(F.md5(F.concat_ws("\x1f", "items")).alias("basket"), "w", F.size("items").alias("n"), F.explode("items").alias("item"))
    pairs = narrow.unionByName(pairs_within(members, ["basket", "w"], "item").select("item_a", "item_b", "w")).groupBy("item_a", "item_b").agg(F.sum("w").alias("n_ab")).filter(F.col("n_ab") >= min_count)
    joined = pairs.join(singles.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a").join(
        singles.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b"
    )
    lift = F.col("n_ab").cast("double") * n_baskets / (F.col("n_a").cast("double") * F.col("n_b"))
    return joined.select("item_a", "item_b", "n_ab", "n_a", "n_b", n_baskets.alias("n_baskets"), lift.alias("lift"), F.log2(lift).alias("pmi"))
