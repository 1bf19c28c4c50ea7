import collections
import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import cooccurrence
from corpusloom.llm.catalog import p5, p6, p8, p9
from corpusloom.llm.cooccurrence import item_pairs
from corpusloom.llm.mixing import mix, mix_plan, mix_report
from corpusloom.llm.packing import pack, pack_sizes, packing_report
from corpusloom.llm.proportions import controlled_rounding, fractional_quotas, plain_length_bin, plain_year, stratified_sample, stratum_report
from corpusloom.llm.selection import pairs_within, smallest_keys
from corpusloom.session import read
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


def test_sql(spark):
    for part in (p5, p8, p9):
        for name, sql in part.ORACLE.items():
            assert_same(spark, name, part.QUERIES[name], sql, SF)


def test_pairs_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    baskets = [[rng.choice("abcdef") for _ in range(rng.randrange(6))] for _ in range(120)] + [None, [None, "a"]]
    frame = spark.createDataFrame([(b, 1) for b in baskets], "items array<string>, n int")
    sets = [set(x for x in b if x) for b in baskets if b and any(b)]
    single = collections.Counter(x for s in sets for x in s)
    pair = collections.Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    got = {(r["item_a"], r["item_b"]): r for r in item_pairs(frame, F.col("items"), 2).collect()}
    assert {k: r["n_ab"] for k, r in got.items()} == {k: n for k, n in pair.items() if n >= 2}
    for (a, b), r in got.items():
        assert math.isclose(r["lift"], pair[a, b] * len(sets) / (single[a] * single[b])) and r["n_baskets"] == len(sets)
    assert item_pairs(frame.limit(0), F.col("items")).count() == 0
    # wide baskets are paired by several tasks, with the same result
    monkeypatch.setattr(cooccurrence, "WIDE", 2)
    assert {(r["item_a"], r["item_b"]): r["n_ab"] for r in item_pairs(frame, F.col("items"), 2).collect()} == {k: r["n_ab"] for k, r in got.items()}


def test_pairs_within_large_groups(spark):
    sizes = {"a": 57, "b": 1, "c": 8}
    rows = [(g, f"{i:03d}", n) for g, n in sizes.items() for i in range(n)]
    found = pairs_within(spark.createDataFrame(rows, "g string, item string, n bigint"), ["g"], "item", stretch=5).collect()
    assert sorted((r["g"], r["item_a"], r["item_b"]) for r in found) == sorted((g, f"{i:03d}", f"{j:03d}") for g, n in sizes.items() for i in range(n) for j in range(i + 1, n))


def test_p6_against_brute_force(spark):
    from corpusloom.queries.packed import corpus_items

    rows = collections.defaultdict(set)
    for r in corpus_items(spark, SF, ("keywords",)).collect():
        rows[r["rec_no"]].add(r["item"].lower())
    single = collections.Counter(x for s in rows.values() for x in s)
    pair = collections.Counter(p for s in rows.values() for p in itertools.combinations(sorted(s), 2))
    want = {k for k, n in pair.items() if n >= 5 and n * len(rows) >= 4 * single[k[0]] * single[k[1]]}
    assert {(r["kw_a"], r["kw_b"]) for r in p6.p6_found(spark, SF).collect()} == want


def test_controlled_rounding_keeps_margins():
    rng = random.Random(3)
    for _ in range(40):
        cells = {(f"r{i}", f"c{j}"): rng.choice([0.0, rng.random() * 5, float(rng.randrange(4))]) for i in range(4) for j in range(3) if rng.random() < 0.8}
        if not cells:
            continue
        whole = controlled_rounding(cells)
        near = lambda got, exact: math.floor(exact + 1e-9) <= got <= math.ceil(exact - 1e-9)
        assert all(near(whole[k], q) for k, q in cells.items())
        for side in (0, 1):
            for name in {k[side] for k in cells}:
                assert near(sum(v for k, v in whole.items() if k[side] == name), sum(v for k, v in cells.items() if k[side] == name))
        assert near(sum(whole.values()), sum(cells.values()))


def test_fractional_quotas():
    assert fractional_quotas([5, 5], [0, 0], [3, 100]) == [3.0, 7.0]
    assert fractional_quotas([10, 0], [0, 2], [100, 100])[1] == 2.0
    assert fractional_quotas([5], [0], [2]) == [2.0]
    assert fractional_quotas([0, 0], [1, 0], [4, 4]) == [1.0, 0.0]


def test_plain_values(spark):
    years = [" 2025", "2025年", "'2025", "２０２５", "2025.0", "", None, "n/a", "20255"]
    bins = ["<= 200", "≤200", "0-200", "201~400", "201–400", "401至800", "＞800", "801+", "", None, "300"]
    y = [r["v"] for r in spark.createDataFrame([(v,) for v in years], "x string").select(plain_year(F.col("x")).alias("v")).collect()]
    b = [r["v"] for r in spark.createDataFrame([(v,) for v in bins], "x string").select(plain_length_bin(F.col("x")).alias("v")).collect()]
    assert y == ["2025"] * 5 + ["UNKNOWN"] * 4
    assert b == ["<=200"] * 3 + ["201-400"] * 2 + ["401-800"] + [">800"] * 2 + ["UNKNOWN"] * 3


def test_sample_meets_quotas(spark):
    pool, strata = read(spark, SF, "kgval_pool"), read(spark, SF, "kgval_strata")
    report = stratum_report(pool, strata)
    got = {tuple(r)[:3]: r["n"] for r in stratified_sample(pool, report).groupBy("run_id", "year", "length_bin").agg(F.count("*").alias("n")).collect()}
    for r in report.collect():
        assert r["quota"] <= r["available"]
        assert got.get((r["run_id"], r["year"], r["length_bin"]), 0) <= r["quota"]
        assert r["short"] == (r["available"] < max(r["target_quota"], r["min_count"]))
    ids = stratified_sample(pool, report).groupBy("run_id", "id").count().filter("count > 1").count()
    assert ids == 0
    empty = stratum_report(pool.limit(0), strata)
    assert empty.filter("available > 0 OR quota > 0").count() == 0


def test_smallest_keys(spark):
    rng = random.Random(9)
    rows = [("g" if i % 3 else "h", rng.random(), i, rng.randrange(1, 50)) for i in range(900)]
    frame = spark.createDataFrame(rows, "g string, k double, i bigint, size bigint")
    budgets = spark.createDataFrame([("g", 2000), ("h", 10**9), ("none", 5)], "g string, b bigint")
    got = {r["i"] for r in smallest_keys(frame, ["g"], "k", "i", "size", budgets, "b").collect()}
    want, total = {i for g, _, i, _ in rows if g == "h"}, 0
    for g, _, i, size in sorted(rows, key=lambda r: r[1]):
        if g == "g" and total + size * 0.5 <= 2000:
            want.add(i)
            total += size
        elif g == "g":
            break
    assert got == want


def test_packing(spark):
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 100, 500)
    assert np.bincount(pack_sizes(sizes, 100), weights=sizes).max() <= 100
    sizes = np.sort(sizes)[::-1]
    bins = pack_sizes(sizes, 100)
    loads = np.bincount(bins, weights=sizes)
    assert loads.max() <= 100 and len(loads) <= sizes.sum() / 100 + 1.2 * len(sizes) ** 0.5
    docs = [(i, int(s)) for i, s in enumerate(sizes)] + [(1000, 250), (1001, 200), (1002, 100), (1003, None), (1004, 0)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, tokens bigint, capacity int")
    placed = pack(frame, {"a": 100, "b": 1000}, shard_docs=200)
    rows = placed.collect()
    by_bin, by_doc = collections.Counter(), collections.Counter()
    for r in rows:
        by_bin[r["pack_id"], r["bin_id"]] += r["tokens"]
        by_doc[r["pack_id"], r["doc_id"]] += r["tokens"]
    assert all(n <= {"a": 100, "b": 1000}[p] for (p, _), n in by_bin.items())
    assert by_doc == {(p, d): s for p in "ab" for d, s in docs if s}
    assert {r["doc_id"] for r in rows if r["n_pieces"] > 1} == {1000, 1001}
    assert packing_report(placed, {"a": 100, "b": 1000}).filter("n_bins < least_bins").count() == 0
    assert pack(frame.limit(0), {"a": 100}).count() == 0 and pack(frame, {}).count() == 0


def test_p8_found_packs_every_document(spark, monkeypatch):
    given = []
    monkeypatch.setattr(p8, "pack", lambda sized, capacities: given.append(sized) or pack(sized, capacities))
    assert p8.p8_found(spark, SF).count() > 0
    assert [sized.count() for sized in given] == [read(spark, SF, "documents").filter("text IS NOT NULL").count()]


def test_mixing(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["x", "y", "z"]), rng.randrange(1, 200), rng.choice([None, 1.0, 0.5])) for i in range(600)] + [(900, None, 5, 1.0), (901, "x", None, 1.0)]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id bigint, source string, tokens bigint, weight double, copies int")
    targets = spark.createDataFrame([("m", "x", 300, 3, 30_000, 1), ("m", "y", 500, 9, 30_000, 1), ("m", "z", 100, 1, 30_000, 1), ("m", "gone", 100, 2, 30_000, 1), ("n", "x", 1000, 1, 10**7, 1)],
                                    "mix_id string, source string, target_permille int, max_repeat int, total_tokens bigint, held int")
    plan = mix_plan(frame, targets)
    used = mix(frame, plan)
    assert {(r["mix_id"], r["source"]) for r in plan.filter("unreachable").collect()} == {("m", "gone"), ("n", "x")}
    limit = {("m", "x"): 3, ("m", "y"): 9, ("m", "z"): 1, ("n", "x"): 1}
    assert all(r["copies"] <= limit[r["mix_id"], r["source"]] for r in used.collect())
    report = {(r["mix_id"], r["source"]): r for r in mix_report(used, plan).collect()}
    for key in (("m", "x"), ("m", "y"), ("m", "z")):
        assert abs(report[key]["actual_tokens"] - report[key]["target_permille"] * 30) <= 200
    assert report["m", "gone"]["actual_tokens"] == 0
    assert report["n", "x"]["actual_tokens"] == sum(t for _, s, t, _ in docs if s == "x" and t)
    assert mix(frame.limit(0), mix_plan(frame.limit(0), targets)).count() == 0
