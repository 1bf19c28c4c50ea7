"""Sample sizes per stratum: one each where possible, the rest by capped largest remainder."""

from __future__ import annotations

import math
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame


def largest_remainder(weights: Mapping, total: int, capacities: Mapping) -> dict:
    """Whole parts of proportional shares, left-over seats by remainder; seats a stratum cannot hold go to the others."""
    given = dict.fromkeys(weights, 0)
    left = min(total, sum(capacities.values()))
    while left > 0:
        open_strata = [k for k in weights if given[k] < capacities[k] and weights[k] > 0]
        if not open_strata:
            break
        mass = sum(weights[k] for k in open_strata)
        shares = {k: left * weights[k] / mass for k in open_strata}
        seats = {k: min(math.floor(shares[k]), capacities[k] - given[k]) for k in open_strata}
        by_remainder = sorted(open_strata, key=lambda k: (-(shares[k] - math.floor(shares[k])), -weights[k], str(k)))
        over = left - sum(seats.values())
        for k in by_remainder:
            if over and given[k] + seats[k] < capacities[k]:
                seats[k] += 1
                over -= 1
        for k in open_strata:
            given[k] += seats[k]
        left -= sum(seats.values())
    return given


def allocate(counts: Mapping, size: int) -> dict:
    """Quotas of strata with ``counts`` members for a sample of ``size``."""
    if not 0 <= size <= sum(counts.values()):
        raise ValueError(f"a sample of {size} does not fit {sum(counts.values())} members")
    filled = {k: c for k, c in counts.items() if c > 0}
    if size < len(filled):
        return {**dict.fromkeys(counts, 0), **largest_remainder(filled, size, filled)}
    extra = largest_remainder(filled, size - len(filled), {k: c - 1 for k, c in filled.items()})
    return {k: (1 + extra[k] if k in filled else 0) for k in counts}


_SCHEMA = "run_id string, year string, length_bin string, members bigint, quota bigint"


def allocate_runs(strata: DataFrame, share: float) -> DataFrame:
    """Quotas of every run for a sample of ``share`` of it; a run has a few years and length bins."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        keys = list(zip(frame["year"], frame["length_bin"]))
        quotas = allocate(dict(zip(keys, map(int, frame["members"]))), math.ceil(share * int(frame["members"].sum())))
        frame["quota"] = [quotas[k] for k in keys]
        return frame[[c.split()[0] for c in _SCHEMA.split(", ")]]

    return strata.groupBy("run_id").applyInPandas(one, _SCHEMA)
