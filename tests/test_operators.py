import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.external import HashingEncoder, complete, encode, encode_missing, repair_json
from corpusloom.functions import text as T
from corpusloom.operators import allocation, batches, communities, evaluation, graph, identity, retrieval, sampling, vectors, visual


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


def test_attribute_values(spark):
    lit = lambda *xs: F.array(*map(F.lit, xs))
    three = ["关键词: A", "关键词: B", "关键词: C"]
    assert value(spark, T.attribute_values(lit("关键词: A;B;C"))) == three
    assert value(spark, T.attribute_values(lit("关键词：A，B，C"))) == three
    assert value(spark, T.attribute_values(lit("关键词: A", "关键词: B", "关键词: A"))) == three[:2]
    assert value(spark, T.attribute_values(lit("年份: 2024", "来源: 现代教育技术", "关键词: A;B"))) == ["年份: 2024", "来源: 现代教育技术", *three[:2]]


def test_text_rules(spark):
    bins = [value(spark, T.length_bin(F.lit(n))) for n in (200, 201, 400, 401, 800, 801)]
    assert bins == ["<=200", "201-400", "201-400", "401-800", "401-800", ">800"]
    assert value(spark, T.primary_organisation(F.lit("北京师范大学教育学部"))) == "北京师范大学"
    assert value(spark, T.name_key(F.lit("“生成式 AI”（一）"))) == "生成式ai一"
    assert value(spark, T.normalize_text(F.lit("（ＡＢ　c）"))) == "AB c"
    assert value(spark, T.canonical_relation(F.lit(" 用于 "))) == "应用于"
    assert value(spark, T.canonical_type(F.lit("Paper"), ("论文",))) == "论文"
    assert value(spark, T.canonical_type(F.lit("其他"), ("论文",))) == ""
    assert list(value(spark, T.reasoning_step(F.lit("Hence. So the answer is: 42 ")))) == ["answer", "42"]
    assert list(value(spark, T.reasoning_step(F.lit("The new query is: who?\nrest")))) == ["query", "who?"]
    assert value(spark, T.clean_completion(F.lit("```json\n{}\n```"))) == "{}"
    line = T.chunk_line(F.lit("p1"), T.chunk_text(F.lit("t"), F.lit("a")))
    assert value(spark, T.chunk_line_text(line)) == "Title: t\nAbstract: a"
    assert value(spark, T.is_community_name(F.lit("甲 / 乙"), F.array(F.lit("x")))) is False
    assert value(spark, T.duration_text(F.lit(3725.0))) == "01:02:05"


def test_aliases_and_entities(spark):
    mentions = spark.createDataFrame([("AIGC", "技术"), ("GenAI", "技术"), ("生成式人工智能", "技术"), ("某物(AIGC)", "技术"), ("AIGC", "研究主题")], "name string, type string")
    rows = {(r["name"], r["type"]): r["canonical"] for r in identity.resolve_names(mentions, identity.alias_table(spark)).collect()}
    assert {v for (n, t), v in rows.items() if t == "技术"} == {"生成式人工智能"}
    assert rows["AIGC", "研究主题"] == "AIGC"
    placed = spark.createDataFrame([(1, 0, "X", "技术", "x"), (2, 0, "X.", "", "x"), (3, 0, "x", "研究主题", "x"), (4, 0, "y", "", "y"), (5, 0, "", "技术", "")], "doc_pos int, mention_pos int, name string, type string, entity_key string")
    nodes = {(r["entity_key"], r["type"]): (r["name"], r["aliases"], r["mentions"]) for r in identity.resolve_entities(placed).collect()}
    assert nodes == {("x", "技术"): ("X", ["X."], 2), ("x", "研究主题"): ("x", [], 1), ("y", ""): ("y", [], 1)}


def test_metadata_edges(spark):
    docs = spark.createDataFrame([("d1", 1, "标题", "电化教育研究", "张三;李四", "北京师范大学教育学部"), ("d2", 2, None, "x", "y", "z")], "doc_uid string, pos int, title string, source string, authors string, organ string")
    got = {(r["src"], r["relation"], r["dst"]) for r in graph.metadata_edges(docs).collect()}
    assert got == {
        ("paper::d1", "发表于", "journal::电化教育研究"), ("author::张三", "撰写", "paper::d1"), ("author::李四", "撰写", "paper::d1"),
        ("author::张三", "隶属", "organ::北京师范大学"), ("author::李四", "隶属", "organ::北京师范大学"),
    }


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)})


@pytest.mark.parametrize("seed,n,m", [(1, 40, 30), (2, 60, 45), (3, 10, 0), (4, 5, 12)])
def test_components(spark, seed, n, m):
    pairs = random_edges(seed, n, m) + [(f"c{i}", f"c{i + 1}") for i in range(25)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for x in list(parent)}
    rows = graph.components(spark.createDataFrame(pairs, "src string, dst string")).collect()
    assert {r["node_id"]: r["component"] for r in rows} == want and len(rows) == len(want)


def test_traversal(spark):
    pairs = random_edges(5, 25, 40)
    edges = spark.createDataFrame([(a, "r", b) for a, b in pairs], "src string, relation string, dst string")
    seeds = spark.createDataFrame([("n1",), ("n2",)], "node_id string")
    depth, frontier = {"n1": 0, "n2": 0}, {"n1", "n2"}
    for d in (1, 2, 3):
        frontier = {b for a, b in pairs if a in frontier}
        for x in frontier:
            depth.setdefault(x, d)
    assert {r["node_id"]: r["depth"] for r in graph.k_hop(edges, seeds, 3).collect()} == depth
    assert {(r["src"], r["dst"]) for r in graph.one_hop(edges, seeds).collect()} == {(a, b) for a, b in pairs if {a, b} & {"n1", "n2"}}


def test_every_node_is_a_seed(spark):
    rows = [("author::王", "r", "paper::p"), ("author::Zed", "r", "paper::p"), ("paper::p", "发表于", "journal::j"), ("journal::j", "r", "journal::j"), ("journal::j", "r", "x"), ("x", "r", "y")]
    edges = spark.createDataFrame(rows, "src string, relation string, dst string")
    touching = collections.Counter(r["node_id"] for r in graph.one_hop_each(edges).collect())
    assert touching == {"author::王": 1, "author::Zed": 1, "paper::p": 3, "journal::j": 3, "x": 2, "y": 1}
    got = {(r["seed"], r["node_id"]): r["depth"] for r in graph.k_hop_each(edges, 3).collect()}
    want = {}
    for node in touching:
        at, seen = {node}, {node: 0}
        for depth in (1, 2, 3):
            at = {d for s, _, d in rows if s in at}
            for n in at:
                seen.setdefault(n, depth)
        want |= {(node, n): d for n, d in seen.items()}
    assert got == want and ("author::王", "y") not in got


def test_degree_limited_equals_one_by_one(spark):
    rng = random.Random(7)
    rows = sorted({(f"a{rng.randrange(12)}", f"b{rng.randrange(12)}"): rng.randrange(4) for _ in range(60)}.items())
    degree, want = collections.Counter(), set()
    for (a, b), w in sorted(rows, key=lambda r: (-r[1], r[0])):
        if degree[a] < 2 and degree[b] < 2:
            degree[a] += 1
            degree[b] += 1
            want.add((a, b))
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in rows], "a string, b string, weight int")
    assert {(r["a"], r["b"]) for r in graph.degree_limited(frame).collect()} == want
    assert graph.degree_limited(frame.limit(0)).count() == 0


@pytest.mark.parametrize("in_one_task", [0, 60, 10_000])
def test_overlap_bridges_consider_every_pair(spark, in_one_task):
    rng = random.Random(3)
    papers = {f"p{i:03}": sorted(rng.sample("abcdefgh", rng.randrange(1, 6))) for i in range(40)}
    # beyond a batch of twelve, with different first keywords
    papers |= {f"q{i:03}": ["hot", f"w{i}"] for i in range(30)} | {"q000": ["x1", "hot", "rare", "y"], "q029": ["x2", "rare", "y", "hot"], "none": []}
    got = [(r["a"], r["b"], r["weight"]) for r in graph.overlap_bridges(spark.createDataFrame(list(papers.items()), "node string, keys array<string>"), in_one_task=in_one_task).collect()]
    shared = {(a, b): len(set(papers[a]) & set(papers[b])) for a in papers for b in papers if a < b}
    assert len({(a, b) for a, b, _ in got}) == len(got) and all(shared[a, b] == w >= 2 for a, b, w in got)
    assert ("q000", "q029", 3) in got
    # the same as one by one by weight, if the pairs taken come first among equals
    taken, degree, want = {(a, b) for a, b, _ in got}, collections.Counter(), set()
    for pair in sorted((p for p in shared if shared[p] >= 2), key=lambda p: (-shared[p], p not in taken, p)):
        if max(degree[n] for n in pair) < 2:
            degree.update(pair)
            want.add(pair)
    assert taken == want
    assert graph.overlap_bridges(spark.createDataFrame([], "node string, keys array<string>")).count() == 0


def test_bridge_gate(spark):
    rows = [("a", "扩展", "b", 0.8, ["a", "b"]), ("a", "其他", "b", 0.8, ["a", "b"]), ("a", "扩展", "b", 0.7, ["a", "b"]), ("a", "扩展", "b", 0.9, ["a", "a", "", None]), ("a", "扩展", "a", 0.9, ["a", "b"]), ("a", "扩展", "z", 0.9, ["a", "z"]), ("b", "对比", "a", 0.75, ["b", "a"])]
    frame = spark.createDataFrame(rows, "head string, relation string, tail string, confidence double, source_paper_ids array<string>")
    passed = graph.bridge_gate(frame, spark.createDataFrame([("a",), ("b",)], "doc_uid string"), ("扩展", "对比"))
    assert sorted((r["head"], r["tail"], r["confidence"]) for r in passed.collect()) == [("a", "b", 0.8), ("b", "a", 0.75)]


def test_allocation():
    assert allocation.allocate({"a": 2, "b": 2, "c": 96}, 99) == {"a": 2, "b": 2, "c": 95}
    assert sum(allocation.allocate({k: 10 for k in "abcde"}, 3).values()) == 3
    got = allocation.allocate({"a": 50, "b": 30, "c": 20}, 10)
    assert sum(got.values()) == 10 and min(got.values()) >= 1
    populations = [23, 211, 76, 1, 39, 389, 134, 60, 648, 275, 5, 10, 121, 61, 1]
    assert list(allocation.allocate(dict(enumerate(populations)), 100).values()) == [2, 10, 4, 1, 3, 17, 7, 3, 28, 12, 1, 1, 6, 4, 1]
    with pytest.raises(ValueError):
        allocation.allocate({"a": 1}, 2)


def test_sampling(spark):
    rows = spark.range(3000).select((F.col("id") % 3).cast("string").alias("s"), F.col("id").cast("string").alias("k"))
    quotas = spark.createDataFrame([("0", 10), ("1", 0), ("2", 5000)], "s string, quota int")
    picked = sampling.sample_strata(rows, quotas, ["s"], sampling.random_key(1, "k"))
    assert {r["s"]: r["count"] for r in picked.groupBy("s").count().collect()} == {"0": 10, "2": 1000}
    keyed = sorted((r["h"], r["k"]) for r in rows.filter("s = '0'").select("k", sampling.random_key(1, "k").alias("h")).collect())
    assert {r["k"] for r in picked.filter("s = '0'").collect()} == {k for _, k in keyed[:10]}


def test_batches(spark):
    sizes = [5, 5, 5, 20, 1, 1, 1, 30]
    assert batches.pack_in_order(sizes, 3, 16) == [0, 0, 0, 1, 2, 2, 2, 3]
    frame = spark.createDataFrame([(c, f"u{i}", s) for c in "xy" for i, s in enumerate(sizes)], "cluster string, unit string, size bigint")
    rows = sorted((r["cluster"], r["unit"], r["batch"]) for r in batches.pack_batches(frame, 3, 16).collect())
    assert [b for c, _, b in rows if c == "x"] == [b for c, _, b in rows if c == "y"] == [f"0-{b}" for b in (0, 0, 0, 1, 2, 2, 2, 3)]
    again = sorted((r["cluster"], r["unit"], r["batch"]) for r in batches.pack_batches(frame.repartition(7), 3, 16).collect())
    assert again == rows
    cut = {r["batch"] for r in batches.pack_batches(frame, 3, 16, stretch=2).filter("cluster = 'x'").collect()}
    assert {b.split("-")[0] for b in cut} == {"0", "1", "2", "3"}
    totals = batches.pack_batches(frame, 3, 16).groupBy("cluster", "batch").agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect()
    assert all(r["n"] <= 3 and (r["s"] <= 16 or r["n"] == 1) for r in totals)


def test_vectors(spark):
    rng = np.random.default_rng(3)
    data = [(i, i % 3, [float(x) for x in rng.normal(size=8)]) for i in range(70)] + [(99, 0, None)]
    frame = spark.createDataFrame(data, "id bigint, label int, vec array<float>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in vectors.top_k(frame.filter("id % 20 = 0"), frame, 4, block=16).collect()}
    matrix = np.array([d[2] for d in data[:-1]], dtype=np.float32).astype(float)
    for q in (0, 20, 40, 60):
        scores = matrix @ matrix[q]
        scores[q] = -np.inf
        assert [got[q, k + 1] for k in range(4)] == list(np.argsort(-scores)[:4])
    assert [vectors.cluster_count(n) for n in (1, 2, 3, 50, 5000)] == [1, 1, 1, 5, 200]
    sets = spark.createDataFrame([(o, i) for o, s in {"a": "abcd", "b": "abce", "c": "xyz", "d": "abcd"}.items() for i in s], "o string, i string")
    assert {(r["a"], r["b"]): round(r["jaccard"], 3) for r in vectors.jaccard(sets, "o", "i", 0.5).collect()} == {("a", "b"): 0.6, ("a", "d"): 1.0, ("b", "d"): 0.6}


def test_evaluation(spark):
    gold = spark.createDataFrame([("s", "a"), ("s", "b")], "sample string, fact string")
    candidate = spark.createDataFrame([("s", "a"), ("s", "c"), ("s", "c")], "sample string, fact string")
    row = evaluation.micro_average(evaluation.set_comparison(gold, candidate, "sample", ["fact"])).head()
    assert (row["tp"], row["fp"], row["fn"], row["precision"], round(row["accuracy"], 4)) == (1, 1, 1, 0.5, 0.3333)
    assert [r["fact"] for r in evaluation.missing_references(gold, candidate, "fact").collect()] == ["b"]


def test_communities(spark):
    members = spark.createDataFrame(
        [(1, "论文甲", "论文", 0.0), (1, "生成式人工智能", "技术", 2.0), (1, "课堂教学", "教学场景", 1.0), (1, "论文乙", "论文", 0.0), (2, "张三", "作者", 1.0), (3, "论文丙", "论文", 0.0)],
        "community int, name string, type string, score double",
    )
    proposals = spark.createDataFrame([(1, "生成式人工智能 / 课堂教学")], "community int, proposed string")
    named = {r["community"]: (r["name"], r["description"]) for r in communities.named(communities.context(members), proposals).collect()}
    assert named[1][0] == "生成式人工智能 · 课堂教学" and named[1][1]
    assert named[3][0] == "相关研究议题" and named[2][0] == "相关主题"
    ids = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "id string, community int")
    nodes, edges = communities.super_nodes(ids, communities.named(communities.context(members)))
    assert [r["node_id"] for r in nodes.collect()] == ["comm_4_1"] and edges.count() == 2


def test_retrieval(spark):
    score = retrieval.adjusted_score(F.lit(0.5), F.lit("撰写"), F.lit(True), F.lit(True))
    assert round(value(spark, score), 3) == 1.85
    assert round(value(spark, retrieval.adjusted_score(F.lit(0.5), F.lit("member_of"), F.lit(True), F.lit(False))), 3) == 0.2
    questions = spark.createDataFrame([("q", "What does Deep Tutor do?"), ("r", None)], "question_id string, question string")
    names = spark.createDataFrame([("n1", "deep tutor"), ("n2", "do"), ("n3", "Deep Other"), ("n4", None)], "node_id string, name string")
    assert [tuple(r) for r in retrieval.named_in(questions, names).collect()] == [("q", "n1")]


def test_visual(spark):
    assert value(spark, visual.link_tier(F.lit("author"), F.lit("撰写"), F.lit("paper"))) == 0
    assert value(spark, visual.node_size(F.lit("paper"), F.lit(100))) == 24.0


def test_external(spark):
    frame = spark.createDataFrame([("a", "x y"), ("b", None)], "id string, text string")
    known = encode(frame.filter("id = 'a'"), "id", "text", HashingEncoder(16))
    assert [r["id"] for r in encode_missing(frame, known, "id", "text", HashingEncoder(16)).collect()] == ["b"]

    def model(prompt):
        if prompt is None:
            raise ValueError("no prompt")
        return prompt.upper()

    assert {(r["id"], r["status"], r["text"]) for r in complete(frame, "id", "text", model).collect()} == {("a", "success", "X Y"), ("b", "failed", "no prompt")}
    assert repair_json('```json\n{"a": [1, 2,], "b": {"c": 3\n```') == '{"a": [1, 2], "b": {"c": 3}}'
    assert repair_json("none") is None


def test_row_numbers_of_a_hot_group(spark):
    from corpusloom.operators.ranking import row_numbers, trailing_count

    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.random(), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, x double, i int")
    got = {r["i"]: r["rn"] for r in row_numbers(frame, ["g"], ["x", "i"]).collect()}
    seen = collections.Counter()
    for g, _, i in sorted(rows):
        seen[g] += 1
        assert got[i] == seen[g]
    times = [(g, int(x * 10_000), i) for g, x, i in rows]
    counted = trailing_count(spark.createDataFrame(times, "g string, t bigint, i int"), "g", F.col("t"), 60).collect()
    for r in counted:
        assert r["recent"] == sum(1 for g, t, _ in times if g == r["g"] and r["t"] - 60 < t <= r["t"])


def test_bridge_gate_fixture(spark):
    rows = [("a", "扩展", "b", 0.8, ["a", "b"]), ("a", "扩展", "b", 0.7, ["a", "b"]), ("a", "引用", "b", 0.9, ["a", "b"]), ("a", "扩展", "a", 0.9, ["a", "b"]), ("a", "扩展", "b", 0.9, ["a", "a", ""]), ("a", "扩展", "z", 0.9, ["a", "z"]), ("a", "扩展", "b", 0.9, None)]
    frame = spark.createDataFrame(rows, "head string, relation string, tail string, confidence double, source_paper_ids array<string>")
    papers = spark.createDataFrame([("a",), ("b",), ("b",)], "doc_uid string")
    assert [(r["head"], r["tail"], r["confidence"]) for r in graph.bridge_gate(frame, papers, ("扩展", "对比", "复用")).collect()] == [("a", "b", 0.8)]


def test_review_scores(spark):
    rows = spark.createDataFrame([("x", " Accepted "), ("x", "REJECTED"), ("x", ""), ("y", None)], "t string, verdict string")
    got = {r["t"]: (r["reviewed"], r["accepted"], r["rejected"], r["precision"], r["pending"]) for r in evaluation.review_scores(rows, ["t"]).collect()}
    assert got == {"x": (2, 1, 1, 0.5, 1), "y": (0, 0, 0, None, 1)}


def test_refined_triples(spark):
    types = spark.createDataFrame([("s", "P", "论文"), ("s", "A", "作者"), ("s", "M", "研究方法")], "sample string, name string, type string")
    rows = [("s", "P", "撰写", "A"), ("s", "A", "撰写", "P"), ("s", "M", "采用", "P"), ("s", "M", "采用", "unknown"), ("other", "P", "撰写", "A")]
    frame = spark.createDataFrame(rows, "sample string, head string, relation string, tail string")
    got = sorted((r["head"], r["relation"], r["tail"], r["swapped"]) for r in graph.refine_triples(frame, types).collect())
    assert got == [("A", "撰写", "P", False), ("A", "撰写", "P", True), ("P", "采用", "M", True)]


def test_component_scores(spark):
    edges = spark.createDataFrame([("paper::a", "x", "attribute::k"), ("paper::a", "x", "author::b"), ("paper::c", "x", "author::d"), ("paper::c", "x", "author::d")], "src string, relation string, dst string")
    got = sorted((r["nodes"], r["links"], r["score"]) for r in graph.component_scores(edges).collect())
    assert got == [(2, 1, 100), (3, 2, 210)]
    assert graph.component_scores(edges.limit(0)).count() == 0


def test_expansion_and_fallback(spark):
    edges = spark.createDataFrame([("n", "r", "near"), ("n", "r", "far"), ("n", "r", "community::c"), ("near", "back", "n"), ("n", "r", "unknown")], "src string, relation string, dst string")
    top = spark.createDataFrame([("q", "n")], "question_id string, node_id string")
    similar = spark.createDataFrame([("q", "near", 0.5), ("q", "far", 0.1), ("q", "community::c", 0.0)], "question_id string, node_id string, sim double")
    got = sorted((r["src"], r["dst"]) for r in retrieval.expand(edges, top, similar).collect())
    assert got == [("n", "community::c"), ("n", "near"), ("n", "unknown"), ("near", "n")]
    hits = spark.createDataFrame([("q", 1, 0.9), ("q", 2, 0.5)], "query_id string, id int, score double")
    more = spark.createDataFrame([("q", 2, 0.5), ("q", 3, 0.7), ("p", 4, 0.1)], "query_id string, id int, score double")
    got = sorted((r["query_id"], r["rank"], r["id"], r["typed"]) for r in retrieval.with_fallback(hits, more, 2, 3).collect())
    assert got == [("p", 1, 4, 0), ("q", 1, 1, 1), ("q", 2, 3, 0)]
    assert [r["id"] for r in retrieval.with_fallback(hits, more, 5, 2).filter("query_id = 'q'").collect()] == [1, 2]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    import pytest

    from corpusloom.session import shared_dir

    folder = N(isEmpty=lambda: True)
    context = N(getConf=lambda: N(get=lambda key, default: default), _jsc=N(sc=lambda: N(getCheckpointDir=lambda: folder)), master="spark://host:7077")
    with pytest.raises(ValueError):
        shared_dir(N(sparkContext=context))


def test_lists_entities_and_citations(spark):
    assert value(spark, T.text_list(F.array(F.lit(" a "), F.lit(""), F.lit(None), F.lit("b")))) == ["a", "b"]
    assert value(spark, T.text_list(F.lit(None).cast("array<string>"))) == []
    assert tuple(value(spark, T.typed_entity(F.lit("Paper [A] [schema_type: 论文, label: x]")))) == ("Paper [A]", "论文")
    assert tuple(value(spark, T.typed_entity(F.lit(" plain ")))) == ("plain", "")
    assert value(spark, T.renumbered(F.lit("x [3] y [1], [3] and [2]"))) == "x [1] y [2], [1] and [3]"
    assert value(spark, T.cited(F.lit("x [3] y [1], [3]"))) == [3, 1] and value(spark, T.renumbered(F.lit(None).cast("string"))) == ""
