"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialise


def row_numbers(rows: DataFrame, groups: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """Adds the number of each row in the order of its group, from 1.

    Rows are put into ranges of (group, order), so a hot group lies in many ranges;
    they are numbered within each range and moved by the counts of the earlier ones."""
    ranged = materialise(rows.repartitionByRange(*groups, *order).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy(*groups, "__range").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # at most a row per range
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    within = Window.partitionBy(*groups, "__range").orderBy(*order)
    numbered = ranged.withColumn("__at", F.row_number().over(within)).join(offsets, [*groups, "__range"])
    return numbered.withColumn(name, F.col("__at") + F.col("__before")).select(*rows.columns, name)


def trailing_count(rows: DataFrame, key: str, at_us: Column, width_us: int) -> DataFrame:
    """Adds ``recent``: rows of the same key within the last ``width_us`` microseconds, the row itself included.

    Time is cut into pieces of that width; a row is counted in its own piece and shown
    to the next one, so a hot key is spread over its pieces."""
    timed = rows.withColumn("__us", at_us).withColumn("__piece", F.floor(F.col("__us") / width_us))
    shown = timed.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("__later")).withColumn("__piece", F.col("__piece") + F.col("__later"))
    trailing = Window.partitionBy(key, "__piece").orderBy("__us").rangeBetween(-(width_us - 1), 0)
    return shown.withColumn("recent", F.count("*").over(trailing)).filter("__later = 0").select(*rows.columns, "recent")
