"""Records of several sources in target shares of a total size, with capped repetition.

Each document gets an expected number of copies, proportional to its weight and at
most ``max_repeat``, such that its source reaches the target size.  The whole part
is certain; the fractions are inclusion probabilities of a Pareto order sample:
documents are ranked by random odds divided by inclusion odds and taken in that
order until the source's remaining size is used up.

A source that cannot reach its share gives all its documents ``max_repeat`` times
and is reported.  Defined results: documents without size or source take part in no
mix; a source without documents is unreachable; weights that are null count as 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.selection import smallest_keys, uniform
from corpusloom.session import materialise


def mix_plan(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix, source and weight: tokens held, expected copies of a document, and whether the share is out of reach.

    Documents are summed up per source and weight first, so all that follows has a
    row per distinct weight."""
    documents = documents.select("source", F.coalesce("weight", F.lit(1.0)).alias("weight"), "tokens").filter("source IS NOT NULL AND tokens > 0")
    targets = targets.select("mix_id", "source", "target_permille", "max_repeat", "total_tokens")
    held = documents.groupBy("source", "weight").agg(F.sum("tokens").alias("tokens"))
    goals = targets.withColumn("goal", F.col("target_permille").cast("double") * F.col("total_tokens") / 1000)
    table = goals.join(held, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    by_mix = ["mix_id", "source"]
    heavier = Window.partitionBy(*by_mix).orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by_mix)
    table = (
        table.withColumn("held", F.sum("tokens").over(whole))
        .withColumn("unreachable", F.col("held") * F.col("max_repeat") * 1000 < F.col("target_permille").cast("bigint") * F.col("total_tokens"))
        # copies are scale * weight, those of heavier weights being capped
        .withColumn("capped_tokens", F.coalesce(F.sum("tokens").over(heavier), F.lit(0)))
        .withColumn("mass", F.sum(F.col("weight") * F.col("tokens")).over(whole) - F.coalesce(F.sum(F.col("weight") * F.col("tokens")).over(heavier), F.lit(0.0)))
        .withColumn("scale", F.when(F.col("mass") > 0, (F.col("goal") - F.col("max_repeat") * F.col("capped_tokens")) / F.col("mass")))
        .withColumn("fits", F.col("scale") * F.col("weight") <= F.col("max_repeat"))
        .withColumn("factor", F.max(F.when(F.col("fits"), F.struct("weight", "scale"))).over(whole)["scale"])
    )
    copies = F.when(F.col("unreachable") | F.col("factor").isNull(), F.col("max_repeat").cast("double")).otherwise(F.least(F.col("max_repeat").cast("double"), F.col("factor") * F.col("weight")))
    return table.select(*by_mix, "weight", "target_permille", "total_tokens", "goal", "tokens", "held", "unreachable", F.greatest(copies, F.lit(0.0)).alias("copies"))


def mix(documents: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """``(mix_id, source, doc_id, tokens, copies)`` of ``(doc_id, source, tokens, weight)``: how often each document is used."""
    documents = documents.select("doc_id", "source", "tokens", F.coalesce("weight", F.lit(1.0)).alias("weight")).filter("source IS NOT NULL AND tokens > 0")
    rows = documents.join(plan.select("mix_id", "source", "weight", F.col("copies").alias("expected")), ["source", "weight"])
    rows = rows.withColumn("certain", F.floor(F.col("expected") + 1e-9).cast("int")).withColumn("chance", F.greatest(F.col("expected") - F.col("certain"), F.lit(0.0)))
    odds = uniform(seed, "mix_id", "doc_id")
    ratio = (odds / (1 - odds)) / (F.col("chance") / (1 - F.col("chance")))
    drawn = rows.filter("chance > 1e-9").withColumn("rank", F.least(ratio / (1 + ratio), F.lit(1 - 1e-12))).select("mix_id", "source", "doc_id", "tokens", "rank", "chance")
    budgets = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("chance") * F.col("tokens")).alias("budget"))
    extra = smallest_keys(drawn, ["mix_id", "source"], "rank", "doc_id", "tokens", materialise(budgets), "budget").select("mix_id", "source", "doc_id", "tokens", F.lit(1).alias("copies"))
    sure = rows.filter("certain > 0").select("mix_id", "source", "doc_id", "tokens", F.col("certain").alias("copies"))
    return sure.unionByName(extra).groupBy("mix_id", "source", "doc_id").agg(F.max("tokens").alias("tokens"), F.sum("copies").cast("int").alias("copies"))


def mix_report(used: DataFrame, plan: DataFrame) -> DataFrame:
    """Per mix and source: target and actual share, and whether the share was out of reach."""
    goals = plan.groupBy("mix_id", "source").agg(F.max("target_permille").alias("target_permille"), F.max("total_tokens").alias("total_tokens"), F.max("unreachable").alias("unreachable"))
    actual = used.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"), F.max("copies").alias("most_copies"))
    report = goals.join(actual, ["mix_id", "source"], "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
    return report.withColumn("actual_permille", F.col("actual_tokens") * 1000 / F.col("total_tokens")).withColumn(
        "share_of_mix", F.col("actual_tokens") * 1000 / F.sum("actual_tokens").over(Window.partitionBy("mix_id"))
    )
