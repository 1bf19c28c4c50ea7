"""Property graphs as two tables: ``nodes`` and ``edges``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.ranking import row_numbers
from corpusloom.session import materialise

MAX_AUTHORS = 3


def node_id(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{kind}::"), name)


def _edge(src: Column, relation: str, dst: Column, confidence: float) -> Column:
    return F.struct(src.alias("src"), F.lit(relation).alias("relation"), dst.alias("dst"), F.lit(confidence).alias("confidence"))


def metadata_edges(docs: DataFrame) -> DataFrame:
    """``(src, relation, dst, confidence, doc_uid, pos)`` from ``(doc_uid, pos, title, source, authors, organ)``.

    Paper to journal, authors (the first three valid ones) to paper, and authors to
    organisations by position; an author keeps the organisation of the first
    document that gives one."""
    rows = docs.filter(T.trim(T.empty_if_null(F.col("title"))) != "").select(
        "doc_uid", "pos", node_id("paper", F.col("doc_uid")).alias("paper"), T.trim(T.empty_if_null(F.col("source"))).alias("journal"),
        F.slice(F.filter(T.split_metadata(F.col("authors")), T.is_author_name), 1, MAX_AUTHORS).alias("people"),
        F.array_distinct(F.filter(F.transform(T.split_metadata(F.col("organ")), T.primary_organisation), lambda o: o != "")).alias("organs"),
    )
    rows = materialise(rows)  # three kinds of edges are made of it
    published = rows.filter("journal <> ''").select(_edge(F.col("paper"), "发表于", node_id("journal", F.col("journal")), 0.95).alias("e"), "doc_uid", "pos")
    wrote = rows.select("doc_uid", "pos", "paper", F.explode("people").alias("person")).select(_edge(node_id("author", F.col("person")), "撰写", F.col("paper"), 0.95).alias("e"), "doc_uid", "pos")
    edges = published.unionByName(wrote).unionByName(affiliation_edges(rows))
    return edges.select("e.*", "doc_uid", "pos")


def affiliation_edges(rows: DataFrame) -> DataFrame:
    """Author to organisation by position: a single organisation serves all, an overflowing author gets the first."""
    one = F.size("organs") == 1
    placed = rows.filter(F.size("organs") > 0).select("doc_uid", "pos", "organs", F.posexplode("people").alias("i", "person"))
    chosen = placed.select("doc_uid", "pos", "person", F.when(one, F.get("organs", F.lit(0))).otherwise(F.coalesce(F.get("organs", F.col("i")), F.get("organs", F.lit(0)))).alias("organ"))
    # the first document wins: grouped, so a frequent author is combined before the shuffle
    first = chosen.groupBy("person").agg(F.min_by(F.struct("doc_uid", "pos", "organ"), F.struct("pos", "organ")).alias("f"))
    return first.select(_edge(node_id("author", F.col("person")), "隶属", node_id("organ", F.col("f.organ")), 0.9).alias("e"), "f.doc_uid", "f.pos")


def deduplicate(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, relation): the first's confidence, the evidence of all."""
    return edges.groupBy("src", "dst", "relation").agg(
        F.min_by("confidence", F.struct("pos", "doc_uid")).alias("confidence"), F.sort_array(F.collect_set("doc_uid")).alias("evidence"), F.min("pos").alias("pos")
    )


def nodes_of(edges: DataFrame) -> DataFrame:
    """``(node_id, kind, name)`` of all ends of edges."""
    ends = edges.select("src").union(edges.select(F.col("dst"))).distinct().withColumnRenamed("src", "node_id")
    return ends.select("node_id", F.substring_index("node_id", "::", 1).alias("kind"), F.regexp_replace("node_id", "^[a-z]+::", "").alias("name"))


def degrees(edges: DataFrame) -> DataFrame:
    """``(node_id, degree, neighbours)``: edge ends, and distinct neighbours in either direction."""
    ends = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node_id"), F.col("src").alias("other")))
    pairs = ends.groupBy("node_id", "other").agg(F.count("*").alias("n"))
    return pairs.groupBy("node_id").agg(F.sum("n").alias("degree"), F.count("*").alias("neighbours"))


def one_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges that touch a seed: two equi-joins instead of an OR."""
    out = edges.join(seeds.select(F.col("node_id").alias("src")), "src", "left_semi").select("src", "relation", "dst")
    into = edges.join(seeds.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "relation", "dst")
    return out.union(into).distinct()


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """``(node_id, depth)`` reached along out-edges, with the least depth."""
    links = materialise(edges.select(F.col("src").alias("node_id"), F.col("dst").alias("next")).distinct())
    frontier = materialise(seeds.select("node_id").distinct())
    reached = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, hops + 1):
        # only nodes that are new go on
        found = frontier.join(links, "node_id").select(F.col("next").alias("node_id")).distinct()
        frontier = materialise(found.join(reached.select("node_id"), "node_id", "left_anti"))
        reached = reached.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return reached


def one_hop_each(edges: DataFrame) -> DataFrame:
    """``(node_id, src, relation, dst)``: the edges that touch each node; a loop counts once for its node."""
    links = edges.select("src", "relation", "dst").distinct()
    ends = F.array_distinct(F.array("src", "dst"))
    return links.select(F.explode(ends).alias("node_id"), "src", "relation", "dst")


def k_hop_each(edges: DataFrame, hops: int = 3) -> DataFrame:
    """``(seed, node_id, depth)`` reached along out-edges from each node, with the least depth.

    Nodes without out-edges reach themselves only."""
    links = materialise(edges.select(F.col("src").alias("node_id"), F.col("dst").alias("next")).distinct())
    nodes = links.select("node_id").union(links.select("next")).distinct()
    frontier = nodes.select(F.col("node_id").alias("seed"), "node_id")
    reached = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, hops + 1):
        frontier = materialise(frontier.join(links, "node_id").select("seed", F.col("next").alias("node_id")).distinct())
        reached = reached.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return reached.groupBy("seed", "node_id").agg(F.min("depth").alias("depth"))


def paths_to(edges: DataFrame, seeds: DataFrame, targets: DataFrame) -> DataFrame:
    """``(start, middle, target)``: out-paths of one or two edges from seeds to targets; ``middle`` is null for one."""
    links = edges.select("src", "dst").distinct()
    start = links.join(seeds.select(F.col("node_id").alias("src")), "src", "left_semi")
    goal = targets.select(F.col("node_id").alias("target")).distinct()
    short = start.join(goal, F.col("dst") == F.col("target")).select(F.col("src").alias("start"), F.lit(None).cast("string").alias("middle"), "target")
    second = links.select(F.col("src").alias("middle"), F.col("dst").alias("target")).join(goal, "target")
    long = start.select(F.col("src").alias("start"), F.col("dst").alias("middle")).join(second, "middle").filter("start <> target").select("start", "middle", "target")
    return short.unionByName(long)


def components(edges: DataFrame) -> DataFrame:
    """``(node_id, component)``: the least node id of each connected component.

    Alternates large-star and small-star steps, which end after a number of rounds
    that grows with the logarithm of the longest path; each round is written to the
    shared folder, so lost executors cost one round."""
    pairs = edges.select("src", "dst").filter("src <> dst")
    links = materialise(pairs.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        links = materialise(small)
        signature = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).head()
        if signature == before:
            break
        before = signature
    members = links.select(F.col("u").alias("node_id"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node_id")).distinct().withColumn("component", F.col("node_id"))
    alone = edges.filter("src = dst").select(F.col("src").alias("node_id")).distinct().join(members.unionByName(roots), "node_id", "left_anti").withColumn("component", F.col("node_id"))
    return members.unionByName(roots).unionByName(alone).distinct()


def export_rows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges joined to both ends, in the nested form of the graph file."""
    end = lambda p: F.struct(F.col(f"{p}.kind").alias("label"), F.struct(F.col(f"{p}.name").alias("name"), F.col(f"{p}.node_id").alias("node_id")).alias("properties"))
    return (
        edges.alias("e").join(nodes.alias("h"), F.col("e.src") == F.col("h.node_id")).join(nodes.alias("t"), F.col("e.dst") == F.col("t.node_id"))
        .select(end("h").alias("start_node"), F.col("e.relation").alias("relation"), end("t").alias("end_node"),
                F.struct(F.col("e.confidence").alias("confidence"), F.col("e.evidence").alias("source_paper_ids")).alias("edge_properties"))
    )


def import_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the nested form; nodes are told apart by label and name."""
    key = lambda p: F.concat_ws("|", f"{p}.label", f"{p}.properties.name")
    edges = rows.select(key("start_node").alias("src"), "relation", key("end_node").alias("dst"), "edge_properties.*")
    ends = rows.select(F.explode(F.array("start_node", "end_node")).alias("n"))
    nodes = ends.groupBy("n.label", "n.properties.name").agg(F.min("n.properties.node_id").alias("first_id"), F.count("*").alias("ends"))
    return nodes, edges


def term_index(nodes: DataFrame) -> DataFrame:
    """``(term, node_id)``: distinct lower-case words of more than two characters."""
    words = F.array_distinct(F.split(F.lower("name"), r"\s+"))
    return nodes.select("node_id", F.explode(words).alias("term")).filter(F.length("term") > 2)


def nodes_for_terms(index: DataFrame, terms: DataFrame, per_term: int = 50) -> DataFrame:
    """``(question_id, term, node_id)``: up to ``per_term`` nodes for each question's term, by node id."""
    wanted = terms.select("term").distinct()
    first = Window.partitionBy("term").orderBy("node_id")
    kept = index.join(wanted, "term", "left_semi").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_term).drop("r")
    return terms.join(kept, "term").select("question_id", "term", "node_id")


def fact_units(edges: DataFrame, limit: int = 8) -> DataFrame:
    """Up to ``limit`` facts per paper, its out-edges before its in-edges."""
    is_paper = lambda c: F.col(c).startswith("paper::")
    out = edges.filter(is_paper("src")).select(F.col("src").alias("paper"), F.lit(0).alias("dir"), "src", "relation", "dst")
    into = edges.filter(is_paper("dst")).select(F.col("dst").alias("paper"), F.lit(1).alias("dir"), "src", "relation", "dst")
    order = Window.partitionBy("paper").orderBy("dir", "relation", "src", "dst")
    facts = out.unionByName(into).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= limit)
    text = F.concat_ws(" ", F.regexp_replace("src", "^[a-z]+::", ""), "relation", F.regexp_replace("dst", "^[a-z]+::", ""))
    return facts.select("paper", "r", text.alias("fact"))


def keyword_bridges(docs: DataFrame, batch: int = 12, per_batch: int = 4) -> DataFrame:
    """Pairs of papers of one batch that share keywords: ``(batch, a, b, shared)``.

    Papers of one first keyword are put into batches of ``batch``; within a batch the
    pairs are few, and the first ``per_batch`` by position are kept."""
    cluster = F.coalesce(F.lower(F.get("keywords", F.lit(0))), F.lit("misc"))
    rows = row_numbers(docs.select("doc_uid", "pos", "keywords", cluster.alias("cluster")), ["cluster"], ["doc_uid", "pos"]).withColumn("batch", F.concat_ws("#", "cluster", F.floor((F.col("rn") - 1) / batch).cast("string")))
    words = rows.select("batch", "rn", "doc_uid", F.explode(F.array_distinct(F.transform("keywords", F.lower))).alias("kw"))
    left, right = words.select("batch", "kw", F.col("rn").alias("i"), F.col("doc_uid").alias("a")), words.select("batch", "kw", F.col("rn").alias("j"), F.col("doc_uid").alias("b"))
    pairs = left.join(right, ["batch", "kw"]).filter("i < j").groupBy("batch", "i", "j", "a", "b").agg(F.count("*").alias("shared"))
    best = Window.partitionBy("batch").orderBy("i", "j")
    return pairs.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= per_batch).select("batch", "a", "b", "shared")


def structure_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: primary nodes, duplicate rate by name key, isolated share, papers, edges across documents."""
    keyed = nodes.withColumn("key", T.name_key(F.col("name")))
    groups = keyed.groupBy("kind", "key").agg(F.count("*").alias("n"))
    dup = groups.agg(F.sum("n").alias("primary_nodes"), F.sum(F.col("n") - 1).alias("duplicates"), F.count_if(F.col("n") > 1).alias("alias_groups"), F.sum(F.when(F.col("kind") == "paper", F.col("n")).otherwise(0)).alias("papers"))
    across = edges.agg(F.count("*").alias("edges"), F.count_if(F.size("evidence") > 1).alias("cross_doc_edges"))
    return dup.join(F.broadcast(across)).withColumn("duplicate_rate", F.col("duplicates") / F.greatest(F.col("primary_nodes"), F.lit(1)))


def degree_limited(candidates: DataFrame, cap: int = 2) -> DataFrame:
    """Edges ``(a, b, weight)`` chosen so that no node has more than ``cap``, heavy ones first.

    In each round the edges that are first for both of their ends are taken and
    nodes that are full drop out; it ends when none is left.  The result is that of
    going through the edges by weight and names, one by one."""
    left = materialise(candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").filter("a <> b").groupBy("a", "b").agg(F.max("weight").alias("weight")))
    taken = None
    while left.head(1):
        ends = left.select(F.col("a").alias("node"), "a", "b", "weight").unionByName(left.select(F.col("b").alias("node"), "a", "b", "weight"))
        order = F.struct((-F.col("weight")).alias("w"), "a", "b")
        best = ends.groupBy("node").agg(F.min(order).alias("m"))
        agreed = best.select("m.a", "m.b", (-F.col("m.w")).alias("weight")).groupBy("a", "b", "weight").agg(F.count("*").alias("n")).filter("n = 2").drop("n")
        agreed = materialise(agreed)
        taken = agreed if taken is None else taken.unionByName(agreed)
        used = taken.select(F.col("a").alias("node")).unionByName(taken.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("d"))
        full = used.filter(F.col("d") >= cap).select("node")
        left = left.join(agreed.select("a", "b"), ["a", "b"], "left_anti")
        left = left.join(full.withColumnRenamed("node", "a"), "a", "left_anti").join(full.withColumnRenamed("node", "b"), "b", "left_anti")
        left = materialise(left.select("a", "b", "weight"))
    return taken if taken is not None else candidates.select("a", "b", "weight").limit(0)


def bridge_gate(triples: DataFrame, papers: DataFrame, relations: tuple[str, ...], min_confidence: float = 0.75) -> DataFrame:
    """The rows of ``(head, relation, tail, confidence, source_paper_ids)`` that may be bridges: an allowed relation,
    enough confidence, two source papers, and two different ends that are both in ``papers (doc_uid)``."""
    sources = F.array_distinct(F.filter(F.coalesce("source_paper_ids", F.array().cast("array<string>")), lambda p: p.isNotNull() & (p != "")))
    passed = triples.filter(F.col("relation").isin(*relations) & (F.col("confidence") >= min_confidence) & (F.size(sources) >= 2) & (F.col("head") != F.col("tail")))
    known = papers.select("doc_uid").distinct()
    return passed.join(known.withColumnRenamed("doc_uid", "head"), "head", "left_semi").join(known.withColumnRenamed("doc_uid", "tail"), "tail", "left_semi")


def _subsets(keys: Column, size: int) -> Column:
    """All subsets of ``size`` elements of a sorted array of strings, each joined to one string."""
    indexed = F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("at")))
    found = F.transform(indexed, lambda x: F.struct(x["key"].alias("key"), x["at"].alias("at")))
    for _ in range(size - 1):
        found = F.flatten(
            F.transform(found, lambda x: F.transform(F.filter(indexed, lambda y: y["at"] > x["at"]), lambda y: F.struct(F.concat_ws("\x1f", x["key"], y["key"]).alias("key"), y["at"].alias("at"))))
        )
    return F.transform(found, lambda x: x["key"])


def _pair_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """New pairs ``(a, b)`` of ``(node, other, subset)``, subset by subset, until none can be added; a single task's work."""
    rows = pd.concat([pd.DataFrame(columns=["node", "other", "subset"]), *frames]).sort_values(["subset", "node"])
    links = {node: {other} if isinstance(other, str) else set() for node, other in zip(rows["node"], rows["other"])}
    pairs = []
    for _, members in rows.groupby("subset", sort=False)["node"]:
        free = [n for n in members if len(links[n]) < 2]
        while free:
            node, passed = free.pop(), []
            while free and len(links[node]) < 2:
                mate = free.pop()
                if mate not in links[node]:
                    links[node].add(mate)
                    links[mate].add(node)
                    pairs.append((min(node, mate), max(node, mate)))
                if len(links[mate]) < 2:
                    passed.append(mate)
            free += reversed(passed)
    yield pd.DataFrame(pairs, columns=["a", "b"])


def overlap_bridges(papers: DataFrame, least: int = 2, in_one_task: int = 200_000) -> DataFrame:
    """``(a, b, weight)`` of ``(node, keys)``: pairs that share at least ``least`` keys, heavy ones first, at most two per node.

    Every pair of nodes is a candidate, but pairs are never listed: the nodes of
    one subset of ``w`` keys are the pairs that share ``w``.  From the largest ``w``
    down, nodes with a free place take the free subset that is first by hash, and
    its nodes are paired, until no subset holds a pair that could be added.  So the
    result is that of going through all pairs by weight, with ties in some order.
    Once at most ``in_one_task`` rows are left of a size, one task ends it.  The work per node grows with the number of subsets of its keys."""
    keys = papers.select("node", F.explode("keys").alias("key")).filter("node IS NOT NULL AND key IS NOT NULL").distinct()
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    nodes = keys.join(shared, "key", "left_semi").groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    none = F.array().cast("array<struct<other:string,weight:int>>")
    state = materialise(nodes.filter(F.size("keys") >= least).withColumn("links", none))
    turn, size = 0, state.agg(F.max(F.size("keys"))).head()[0] or 0
    # the ends of a pair are linked already if each is the other's only link
    linked = (F.min("other") == F.min("node")) & (F.max("other") == F.max("node")) & (F.count("*") == 2)
    while size >= least:
        free = state.filter((F.size("links") < 2) & (F.size("keys") >= size)).select("node", F.get("links", F.lit(0))["other"].alias("other"), F.explode(_subsets(F.col("keys"), size)).alias("subset"))
        opened = free.groupBy("subset").agg(F.count("*").alias("n"), linked.alias("linked")).filter("n > 1 AND NOT coalesce(linked, false)").select("subset")
        weight = size
        rows = materialise(free.join(opened, "subset"))
        left = rows.count()
        if left > in_one_task:
            turn += 1
            first = F.min_by("subset", F.struct(F.xxhash64("subset", F.lit(turn)), "subset")).alias("subset")
            chosen = rows.groupBy("node", "other").agg(first).withColumn("key", F.xxhash64("node", F.lit(turn)))
            placed = row_numbers(chosen, ["subset"], ["key", "node"])
            pairs = placed.groupBy("subset", F.floor((F.col("rn") - 1) / 2).alias("p")).agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n"), linked.alias("linked"))
            pairs = materialise(pairs.filter("n = 2 AND NOT coalesce(linked, false)").select("a", "b"))
        else:
            if left:
                pairs = materialise(rows.select("node", "other", "subset").coalesce(1).mapInPandas(_pair_up, "a string, b string"))
            size -= 1
        if left:
            ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("with")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("with")))
            new = ends.groupBy("node").agg(F.transform(F.sort_array(F.collect_list("with")), lambda o: F.struct(o.alias("other"), F.lit(weight).alias("weight"))).alias("new"))
            state = materialise(state.join(new, "node", "left").select("node", "keys", F.when(F.col("new").isNotNull(), F.concat("links", "new")).otherwise(F.col("links")).alias("links")))
    return state.select(F.col("node").alias("a"), F.explode("links").alias("l")).select("a", F.col("l.other").alias("b"), F.col("l.weight").cast("bigint").alias("weight")).filter("a < b")


def attribute_edges(docs: DataFrame) -> DataFrame:
    """``(src, relation, dst, confidence, doc_uid, pos)``: the keywords and the year of ``(doc_uid, pos, title, keywords, year)`` as attributes of the paper."""
    rows = docs.filter(T.trim(T.empty_if_null(F.col("title"))) != "")
    keywords = F.transform(F.array_distinct(T.split_keywords(F.col("keywords"))), lambda k: F.concat(F.lit("关键词: "), k))
    year = T.trim(T.empty_if_null(F.col("year")))
    values = F.concat(keywords, F.when(year != "", F.array(F.concat(F.lit("年份: "), year))).otherwise(F.array().cast("array<string>")))
    edges = rows.select("doc_uid", "pos", F.explode(values).alias("value"))
    return edges.select(_edge(node_id("paper", F.col("doc_uid")), "has_attribute", node_id("attribute", F.col("value")), 0.95).alias("e"), "doc_uid", "pos").select("e.*", "doc_uid", "pos")


def name_of(node: Column) -> Column:
    return F.regexp_replace(node, "^[a-z]+::", "")


def reached_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """The edges that leave the reached nodes, once each."""
    return edges.select("src", "relation", "dst").distinct().join(reached.select(F.col("node_id").alias("src")), "src", "left_semi")


def neighbourhood_texts(edges: DataFrame, per_node: int = 8, max_chars: int = 360) -> DataFrame:
    """``(node_id, text)``: a node's first out-edges as ``name relation neighbour``, in order of their text, cut to ``max_chars``; a node without any has its name."""
    text = F.concat_ws(" ", name_of(F.col("src")), "relation", name_of(F.col("dst")))
    facts = edges.select(F.col("src").alias("node_id"), text.alias("fact")).distinct()
    first = facts.withColumn("r", F.row_number().over(Window.partitionBy("node_id").orderBy("fact"))).filter(F.col("r") <= per_node)
    joined = first.groupBy("node_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "fact"))), lambda s: s["fact"]), " ").alias("text"))
    cut = F.rtrim(F.left(T.collapse_spaces(F.coalesce("text", name_of(F.col("node_id")))), F.lit(max_chars)))
    return nodes_of(edges).select("node_id").join(joined, "node_id", "left").select("node_id", cut.alias("text"))


def without_orphans(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges whose ends are both among ``nodes (node_id)``, and the nodes that have such an edge."""
    kept = edges.join(nodes.select(F.col("node_id").alias("src")), "src", "left_semi").join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    ends = kept.select(F.col("src").alias("node_id")).union(kept.select("dst")).distinct()
    return nodes.join(ends, "node_id", "left_semi"), kept


def first_types(mentions: DataFrame) -> DataFrame:
    """``(name, type, priority)`` of ``(name, type, priority, pos)``: a name has the type of its mention of least priority number, first seen."""
    best = F.min_by(F.struct("type", "priority"), F.struct("priority", "pos", "type"))
    return mentions.filter(T.trim(T.empty_if_null(F.col("name"))) != "").groupBy("name").agg(best.alias("b")).select("name", "b.*")


# Typed triples that stand the wrong way round.
REVERSED = (("研究方法", "采用", "论文"), ("研究主题", "提出", "论文"), ("研究主题", "聚焦", "论文"), ("机构", "隶属", "作者"), ("论文", "撰写", "作者"), ("期刊", "发表于", "论文"))


def refine_triples(triples: DataFrame, types: DataFrame) -> DataFrame:
    """``(sample, head, relation, tail, swapped)``: triples of ``(sample, head, relation, tail)`` whose ends both have a type in
    ``(sample, name, type)``, those that stand the wrong way round turned."""
    typed = triples
    for end in ("head", "tail"):
        typed = typed.join(types.select("sample", F.col("name").alias(end), F.col("type").alias(f"{end}_type")), ["sample", end])
    wrong = F.struct(F.col("head_type"), F.col("relation"), F.col("tail_type")).isin(*[F.struct(*map(F.lit, rule)) for rule in REVERSED])
    return typed.select("sample", F.when(wrong, F.col("tail")).otherwise(F.col("head")).alias("head"), "relation", F.when(wrong, F.col("head")).otherwise(F.col("tail")).alias("tail"), wrong.alias("swapped"))


def component_scores(edges: DataFrame) -> DataFrame:
    """``(component, nodes, links, score)``: a hundred for every link and ten for every node that is no entity (attributes)."""
    members = materialise(components(edges))
    nodes = members.groupBy("component").agg(F.count("*").alias("nodes"), F.count_if(F.col("node_id").startswith("attribute::")).alias("others"))
    links = edges.select("src", "relation", "dst").distinct().join(members.withColumnRenamed("node_id", "src"), "src").groupBy("component").agg(F.count("*").alias("links"))
    return nodes.join(links, "component").select("component", "nodes", "links", (100 * F.col("links") + 10 * F.col("others")).alias("score"))
