import json

from pyspark.sql import functions as F

from corpusloom.sources import readers, writers
from corpusloom.sources.raw_export import parse_exported
from corpusloom.streaming import jobs


def test_corpus_and_tagged(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "p", "meta": {"title": "t"}}, {"id": "q", "meta": None}]))
    rows = {r["id"]: r["meta"]["title"] for r in readers.read_corpus(spark, str(tmp_path / "c.json")).collect()}
    assert rows == {"p": "t", "q": None}
    (tmp_path / "t.txt").write_text("Title-题名: A: b\nYear-年: \nPubTime-发表时间: 2024-05-01 10:00\nOther: x\n\nTitle-题名:\nYear-年: 2020\n\nTitle-题名: C\nYear-年: 2021\n")
    found = {r["meta"]["title"]: r["meta"]["year"] for r in readers.corpus_of_tagged(readers.read_tagged(spark, str(tmp_path / "t.txt"))).collect()}
    assert found == {"A: b": "2024", "C": "2021"}


def test_exported(spark):
    rows = spark.createDataFrame([(1, "json", '{"title": "x", "doi": null}'), (2, "tagged", "DOI-DOI : 1\nTitle-题名:y"), (3, "json", "{broken"), (4, None, None), (5, "other", "z")], "n int, fmt string, raw string")
    got = {r["n"]: (r["title"], r["doi"]) for r in parse_exported(rows, ["title", "doi"]).collect()}
    assert got == {1: ("x", None), 2: ("y", "1"), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_graph_round_trip(spark, tmp_path):
    data = [
        {"start_node": {"label": "entity", "properties": {"name": "A", "schema_type": "论文"}}, "relation": "r", "end_node": {"label": "keyword", "properties": {"name": "k"}}, "edge_properties": {"confidence": 0.5}},
        {"start_node": {"label": "entity", "properties": {"name": "A", "schema_type": "技术"}}, "relation": "s", "end_node": {"label": "entity", "properties": {"name": "B"}}},
    ]
    (tmp_path / "g.json").write_text(json.dumps(data))
    nodes, edges = readers.read_graph(spark, str(tmp_path / "g.json"))
    assert {(r["label"], r["name"], r["level"], r["properties"]["schema_type"]) for r in nodes.collect()} == {("entity", "A", 2, "论文"), ("entity", "B", 2, None), ("keyword", "k", 3, None)}
    assert {(r["src"], r["relation"], r["dst"], r["confidence"]) for r in edges.collect()} == {("entity|A", "r", "keyword|k", 0.5), ("entity|A", "s", "entity|B", None)}
    plain = spark.createDataFrame([("n0", "entity", 2, "A"), ("n1", "keyword", 3, "k")], "node_id string, label string, level int, name string")
    links = spark.createDataFrame([("n0", "r", "n1")], "src string, relation string, dst string")
    writers.write_graphml(plain, links, str(tmp_path / "x"))
    back, _ = readers.read_graphml(spark, str(tmp_path / "x" / "nodes"))
    assert {(r["node_id"], r["label"], r["level"], json.loads(r["properties"])["name"]) for r in back.collect()} == {("n0", "entity", 2, "A"), ("n1", "keyword", 3, "k")}
    _, links_back = readers.read_graphml(spark, str(tmp_path / "x" / "edges"))
    assert [tuple(r) for r in links_back.collect()] == [("n0", "r", "n1")]


def test_chunks_and_questions(spark, tmp_path):
    chunks = spark.createDataFrame([("p1", "Title: t\nAbstract: a"), ("p2", "Title: \nAbstract: b")], "chunk_id string, text string")
    writers.write_chunks(chunks, str(tmp_path / "chunks"))
    assert {tuple(r) for r in readers.read_chunks(spark, str(tmp_path / "chunks")).collect()} == {("p1", "Title: t\nAbstract: a", "t"), ("p2", "Title: \nAbstract: b", "Unknown Paper")}
    (tmp_path / "q.json").write_text(json.dumps([{"question_id": "1", "question": "a"}, {"question_id": "1", "question": "b"}]))
    try:
        readers.read_questions(spark, str(tmp_path / "q.json")).collect()
        raise AssertionError("repeated ids must fail")
    except Exception as error:
        assert "repeated question_id 1" in str(error)


def test_gold_and_uploads(spark, tmp_path):
    gold = {"id": "s", "kg_eval": {"gold": {"status": " approved", "extraction": {"entity_types": {"A": "技术"}, "triples": [["A", "r", "B", "x"], ["A"]], "attributes": {"A": ["v"]}}}}}
    (tmp_path / "gold.json").write_text(json.dumps([gold]))
    rows = {tuple(r)[1:] for r in readers.read_gold(spark, str(tmp_path / "gold.json")).collect()}
    assert rows == {("approved", "entity", "A", "", "技术"), ("approved", "triple", "A", "r", "B"), ("approved", "attribute", "A", "", "v")}
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.txt").write_bytes("教育".encode("gb18030"))
    (tmp_path / "up" / "b.md").write_bytes("﻿x".encode())
    (tmp_path / "up" / "c.pdf").write_bytes(b"%PDF")
    assert {(r["title"], r["kind"], r["text"]) for r in readers.read_uploads(spark, str(tmp_path / "up")).collect()} == {("a", "txt", "教育"), ("b", "md", "x"), ("c", "pdf", None)}


def test_cache_and_report(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert writers.append_cache(rows, str(tmp_path / "cache"), "k") == 2
    assert writers.append_cache(rows, str(tmp_path / "cache"), "k") == 0
    latest = readers.latest_per_key(rows, "k", F.col("v")).collect()
    assert {(r["k"], r["v"]) for r in latest} == {("a", 2), ("b", 3)}
    assert "| a | 1 |" in writers.markdown_report("R", rows)


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    events = spark.sql("SELECT * FROM VALUES (1L, timestamp'2024-01-01 00:00:05', 1.0D), (1L, timestamp'2024-01-01 00:00:20', 2.0D), (1L, timestamp'2024-01-01 02:00:00', 4.0D) AS t(user_id, ts, value)")
    events.write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    query = jobs.request_rates(stream, slide="60 seconds").writeStream.format("memory").queryName("rates").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {r["requests"] for r in spark.table("rates").collect()} == {2, 1}
    query = jobs.sessions(stream).writeStream.format("memory").queryName("sess").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["events"], r["value"]) for r in spark.table("sess").collect()] == [(2, 3.0)]
    keyed = events.selectExpr("cast(value as string) AS k", "value")
    keyed.write.parquet(str(tmp_path / "docs"))
    docs = spark.readStream.schema(keyed.schema).parquet(str(tmp_path / "docs"))
    extract = lambda batch: batch.withColumn("status", F.when(F.col("value") > 1, "success").otherwise("failed"))
    query = jobs.extract_new(docs, str(tmp_path / "done"), "k", extract, str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert {r["k"] for r in spark.read.parquet(str(tmp_path / "done")).collect()} == {"2.0", "4.0"}


def test_materialised_tables_are_dropped(spark):
    from corpusloom.session import drop_materialised, materialise

    table = materialise(spark.range(3).toDF("a"))
    assert table.count() == 3 and drop_materialised(spark) >= 1 and drop_materialised(spark) == 0
