"""Repeatable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialise


def random_key(seed: int, *cols: str) -> Column:
    """A key that depends on the seed and the row only; both engines compute it alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))


def sample_strata(rows: DataFrame, quotas: DataFrame, strata: list[str], key: Column, digits: int = 3) -> DataFrame:
    """The ``quota`` rows of smallest key of each stratum.

    Rows are counted per leading hexadecimal digits of the key; whole prefixes are
    taken while they fit, and only the prefix in which the quota runs out is ranked,
    so a hot stratum is never sorted in one task."""
    from pyspark.sql import Window

    keyed = rows.withColumn("__key", key).withColumn("__p", F.substring("__key", 1, digits))
    counts = keyed.groupBy(*strata, "__p").agg(F.count("*").alias("__n")).join(quotas.select(*strata, "quota"), strata)
    upto = Window.partitionBy(*strata).orderBy("__p")  # at most 16 ** digits rows
    edges = materialise(counts.withColumn("__cum", F.sum("__n").over(upto)).withColumn("__rest", F.col("quota") - F.col("__cum") + F.col("__n")).filter("__rest > 0").select(*strata, "__p", "__n", "__rest"))
    kept = keyed.join(edges, [*strata, "__p"])
    whole = kept.filter("__n <= __rest").select(*rows.columns)
    rank = Window.partitionBy(*strata, "__p").orderBy("__key")
    part = kept.filter("__n > __rest").withColumn("__r", F.row_number().over(rank)).filter(F.col("__r") <= F.col("__rest")).select(*rows.columns)
    return whole.unionByName(part)
