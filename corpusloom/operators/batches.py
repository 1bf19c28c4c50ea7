"""Batches of units under a count and a size limit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranking import row_numbers

_SCHEMA = "cluster string, unit string, size bigint, batch string"
#: Units that are packed by one task; the next unit starts a new batch.
STRETCH = 4096


def pack_in_order(sizes: list[int], max_units: int, max_size: int) -> list[int]:
    """Batch numbers: a new batch starts when the next unit would exceed a limit."""
    out, batch, n, used = [], 0, 0, 0
    for size in sizes:
        if n and (n >= max_units or used + size > max_size):
            batch, n, used = batch + 1, 0, 0
        n, used = n + 1, used + size
        out.append(batch)
    return out


def pack_batches(units: DataFrame, max_units: int = 12, max_size: int = 24_000, stretch: int = STRETCH) -> DataFrame:
    """``(cluster, unit, size, batch)``: units of each cluster in order of their name.

    A cluster is cut into stretches of ``stretch`` units, which are packed one by one, so
    a large cluster is packed by several tasks and the result does not depend on them."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rn")
        names = [f"{frame['stretch'].iloc[0]}-{n}" for n in pack_in_order(frame["size"].tolist(), max_units, max_size)]
        return frame.assign(batch=names)[["cluster", "unit", "size", "batch"]]

    numbered = row_numbers(units.select("cluster", "unit", F.coalesce("size", F.lit(0)).alias("size")), ["cluster"], ["unit", "size"])
    return numbered.withColumn("stretch", F.floor((F.col("rn") - 1) / stretch)).groupBy("cluster", "stretch").applyInPandas(pack, _SCHEMA)
