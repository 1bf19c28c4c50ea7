"""A sample whose strata match target quotas, with minimums and a report.

Per run the target quotas, clipped to what each stratum holds and to its minimum,
give a fractional two-way table (year by length).  Controlled rounding turns it
into whole numbers: a maximum flow with lower bounds through years and lengths
rounds every cell, every margin and the total to a neighbouring whole number.
Each cell's quota is then filled with the rows of smallest random key.

Defined results: rows without an id are not sampled; a paper loaded twice in one
run counts once in each stratum it is filed under, and is sampled once; values
that denote no year or length are ``UNKNOWN``; strata without target get nothing;
an empty pool gives a report with empty strata.
"""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.selection import smallest_keys, uniform
from corpusloom.session import materialise

UNKNOWN = "UNKNOWN"
_WIDE, _PLAIN = "０１２３４５６７８９＜＞＝～－＋．–—−‐至到", "0123456789<>=~-+.------"


def plain_year(value: Column) -> Column:
    """The four-digit year a value denotes, or UNKNOWN."""
    found = F.regexp_extract(F.translate(F.coalesce(value, F.lit("")), _WIDE, _PLAIN), r"(?:^|[^0-9])([0-9]{4})(?:[^0-9]|$)", 1)
    return F.when(found == "", UNKNOWN).otherwise(found)


def plain_length_bin(value: Column) -> Column:
    """The length bin a value denotes (<=200, 201-400, 401-800, >800), or UNKNOWN."""
    text = F.regexp_replace(F.translate(F.coalesce(value, F.lit("")), _WIDE, _PLAIN), r"[\s\x{3000}\x{a0}字]+", "")
    return (
        F.when(text.rlike(r"^(?:(?:<=?|≤|=<)200|[01][-~]200)$") | text.rlike(r"^<201$"), "<=200")
        .when(text.rlike(r"^201[-~]400$"), "201-400")
        .when(text.rlike(r"^401[-~]800$"), "401-800")
        .when(text.rlike(r"^(?:>800|(?:>=|≥|=>)801|801\+|800\+|801[-~])$"), ">800")
        .otherwise(UNKNOWN)
    )


def fractional_quotas(target: list[float], least: list[int], most: list[int]) -> list[float]:
    """Targets scaled by one factor and clipped to [least, most] so that they sum to the targets' total, as far as possible."""
    low = [min(a, b) for a, b in zip(least, most)]
    total = min(float(sum(target)), float(sum(most)))
    total = max(total, float(sum(low)))

    def at(factor: float) -> list[float]:
        return [min(max(factor * t, lo), hi) for t, lo, hi in zip(target, low, most)]

    lo, hi = 0.0, 1.0
    while sum(at(hi)) < total - 1e-9 and hi < 1e12:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(at(mid)) < total else (lo, mid)
    quotas = at(hi)
    return [float(round(q)) if abs(q - round(q)) < 1e-6 else q for q in quotas]


def _max_flow(capacity: list[dict[int, int]], source: int, sink: int) -> int:
    """Augments along shortest paths; ``capacity`` becomes the residual graph."""
    total = 0
    while True:
        parent = {source: source}
        queue = deque([source])
        while queue and sink not in parent:
            u = queue.popleft()
            for v, c in sorted(capacity[u].items()):
                if c > 0 and v not in parent:
                    parent[v] = u
                    queue.append(v)
        if sink not in parent:
            return total
        path, v = [], sink
        while v != source:
            path.append((parent[v], v))
            v = parent[v]
        flow = min(capacity[u][v] for u, v in path)
        for u, v in path:
            capacity[u][v] -= flow
            capacity[v][u] = capacity[v].get(u, 0) + flow
        total += flow


def controlled_rounding(cells: dict[tuple[str, str], float]) -> dict[tuple[str, str], int]:
    """Whole numbers for a two-way table: cells, both margins and the total go to a neighbouring whole number.

    A circulation with lower bounds: total -> rows -> columns -> total."""
    rows, cols = sorted({r for r, _ in cells}), sorted({c for _, c in cells})
    s, t = 0, 1
    node = {("r", r): 2 + i for i, r in enumerate(rows)} | {("c", c): 2 + len(rows) + i for i, c in enumerate(cols)}
    n = 2 + len(node)
    extra_s, extra_t = n, n + 1
    graph: list[dict[int, int]] = [{} for _ in range(n + 2)]
    need = [0] * n

    def edge(u: int, v: int, amount: float) -> None:
        lo, hi = math.floor(amount + 1e-9), math.ceil(amount - 1e-9)
        graph[u][v] = graph[u].get(v, 0) + hi - lo
        graph[v].setdefault(u, 0)
        need[v] += lo
        need[u] -= lo

    for r in rows:
        edge(s, node["r", r], sum(q for (a, _), q in cells.items() if a == r))
    for (r, c), q in cells.items():
        edge(node["r", r], node["c", c], q)
    for c in cols:
        edge(node["c", c], t, sum(q for (_, b), q in cells.items() if b == c))
    edge(t, s, sum(cells.values()))
    for v, d in enumerate(need):
        if d > 0:
            graph[extra_s][v] = d
            graph[v].setdefault(extra_s, 0)
        elif d < 0:
            graph[v][extra_t] = -d
            graph[extra_t].setdefault(v, 0)
    before = {(r, c): graph[node["r", r]][node["c", c]] for r, c in cells}
    _max_flow(graph, extra_s, extra_t)
    return {rc: math.floor(q + 1e-9) + before[rc] - graph[node["r", rc[0]]][node["c", rc[1]]] for rc, q in cells.items()}


_QUOTAS = "run_id string, year string, length_bin string, target_quota int, min_count int, available bigint, quota bigint"


def _run_quotas(frame: pd.DataFrame) -> pd.DataFrame:
    """One run's strata, a few years by a few lengths."""
    fractions = fractional_quotas([float(t) for t in frame["target_quota"]], [int(m) for m in frame["min_count"]], [int(a) for a in frame["available"]])
    rounded = controlled_rounding({(y, b): q for y, b, q in zip(frame["year"], frame["length_bin"], fractions)})
    frame["quota"] = [rounded[y, b] for y, b in zip(frame["year"], frame["length_bin"])]
    return frame[[c.split()[0] for c in _QUOTAS.split(", ")]]


def stratum_report(pool: DataFrame, strata: DataFrame) -> DataFrame:
    """Per stratum: target, minimum, distinct papers available, rounded quota, and whether it falls short."""
    filed = pool.filter("id IS NOT NULL AND id <> ''").select("run_id", "id", plain_year(F.col("year")).alias("year"), plain_length_bin(F.col("length_bin")).alias("length_bin"))
    held = filed.distinct().groupBy("run_id", "year", "length_bin").agg(F.count("*").alias("available"))
    wanted = strata.select("run_id", "year", "length_bin", F.coalesce("target_quota", F.lit(0)).alias("target_quota"), F.coalesce("min_count", F.lit(0)).alias("min_count"))
    table = wanted.join(held, ["run_id", "year", "length_bin"], "left").withColumn("available", F.coalesce("available", F.lit(0)))
    report = table.groupBy("run_id").applyInPandas(_run_quotas, _QUOTAS)
    return report.withColumn("short", F.col("available") < F.greatest("target_quota", "min_count"))


def stratified_sample(pool: DataFrame, report: DataFrame, seed: int = 42) -> DataFrame:
    """``(run_id, id, year, length_bin)``: each stratum's quota, by random key; a paper is filed under its first row."""
    filed = pool.filter("id IS NOT NULL AND id <> ''").select("run_id", "id", "pool_no", plain_year(F.col("year")).alias("year"), plain_length_bin(F.col("length_bin")).alias("length_bin"))
    once = filed.groupBy("run_id", "id").agg(F.min_by(F.struct("year", "length_bin"), "pool_no").alias("s")).select("run_id", "id", "s.year", "s.length_bin")
    rows = once.withColumn("key", uniform(seed, "run_id", "id")).withColumn("one", F.lit(1))
    picked = smallest_keys(rows, ["run_id", "year", "length_bin"], "key", "id", "one", materialise(report), "quota")
    return picked.select("run_id", "id", "year", "length_bin")
