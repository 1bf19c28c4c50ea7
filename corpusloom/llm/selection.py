"""Exact selection by random key, distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialise

#: Buckets of a histogram level; a group is told apart to ``BUCKETS**2`` before rows are sorted.
BUCKETS = 4096


def uniform(seed: int, *cols: str | Column) -> Column:
    """A number in (0, 1) that depends on the seed and the columns only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols]), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def smallest_keys(rows: DataFrame, groups: list[str], key: str, tie: str, size: str, budgets: DataFrame, budget: str) -> DataFrame:
    """Rows with the smallest keys of each group, until their sizes sum up to the group's budget.

    The last row is taken if that brings the sum nearer.  Sums per key bucket find
    the bucket in which the budget runs out, twice; only the rows of that finest
    bucket are sorted, so no group, however large, comes together in one task.
    Groups without a budget give nothing; ``key`` lies in [0, 1)."""
    columns = rows.columns
    rows = rows.join(budgets.select(*groups, F.col(budget).cast("double").alias("__left")), groups).filter("__left > 0")
    rows = rows.withColumn("__k", F.col(key).cast("double")).withColumn("__sure", F.lit(False))
    for _ in range(2):
        rows = rows.withColumn("__b", F.least(F.floor(F.col("__k") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
        sums = rows.filter("NOT __sure").groupBy(*groups, "__b").agg(F.sum(size).alias("__sum"), F.max("__left").alias("__left"))
        before = Window.partitionBy(*groups).orderBy("__b")  # at most BUCKETS rows
        edge = (
            sums.withColumn("__cum", F.sum("__sum").over(before))
            .filter(F.col("__cum") > F.col("__left"))
            .groupBy(*groups).agg(F.min("__b").alias("__edge"), F.min(F.struct("__b", (F.col("__left") - F.col("__cum") + F.col("__sum")).alias("rest"))).alias("__at"))
            .select(*groups, "__edge", F.col("__at.rest").alias("__rest"))
        )
        edge = materialise(edge)
        rows = rows.join(edge, groups, "left").filter(F.col("__sure") | F.col("__edge").isNull() | (F.col("__b") <= F.col("__edge")))
        rows = (
            rows.withColumn("__sure", F.col("__sure") | F.col("__edge").isNull() | (F.col("__b") < F.col("__edge")))
            .withColumn("__left", F.coalesce("__rest", "__left")).withColumn("__k", F.col("__k") * BUCKETS - F.col("__b")).drop("__edge", "__rest")
        )
    rows = materialise(rows)
    order = Window.partitionBy(*groups).orderBy(key, tie).rowsBetween(Window.unboundedPreceding, -1)
    last = rows.filter("NOT __sure").withColumn("__before", F.coalesce(F.sum(size).over(order), F.lit(0))).filter(F.col("__before") + F.col(size) * 0.5 <= F.col("__left"))
    return rows.filter("__sure").select(*columns).unionByName(last.select(*columns))


#: Members of a group that one task pairs with all of it.
STRETCH = 1000


def pairs_within(rows: DataFrame, group: list[str], item: str, stretch: int = STRETCH) -> DataFrame:
    """``(*group, item_a, item_b)``: all pairs ``item_a < item_b`` of each group of ``(*group, item, n)``, ``n`` being its size.

    One side of a large group is cut into stretches and the other goes to each of them, so no task writes all its pairs."""
    parts = F.ceil(F.col("n") / stretch)
    a = rows.select(*group, F.col(item).alias(f"{item}_a"), F.pmod(F.xxhash64(item), parts).alias("__part"))
    b = rows.select(*group, F.col(item).alias(f"{item}_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("__part"))
    return a.join(b, [*group, "__part"]).filter(F.col(f"{item}_a") < F.col(f"{item}_b")).drop("__part")
