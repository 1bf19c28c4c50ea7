"""Readers of the file forms in use; all give DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom import vocabulary as V
from corpusloom.functions import text as T
from corpusloom.sources.raw_export import LABELS, tagged_field

META = ("title", "authors", "organ", "source", "keywords", "abstract", "year", "time", "doi", "database")
CORPUS_SCHEMA = f"id string, meta struct<{', '.join(f'{f}: string' for f in META)}>, _corrupt_record string"
GRAPH_SCHEMA = (
    "start_node struct<label: string, properties: struct<name: string, schema_type: string, chunk_id: string, description: string, aliases: array<string>>>, relation string, "
    "end_node struct<label: string, properties: struct<name: string, schema_type: string, chunk_id: string, description: string, aliases: array<string>>>, "
    "edge_properties struct<relation_origin: string, confidence: double, evidence_chunk_ids: array<string>, source_paper_ids: array<string>, reason: string>"
)
#: Node levels by label.
LEVELS = {"attribute": 1, "entity": 2, "keyword": 3, "community": 4}
# Encodings tried in this order.
ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "gbk", "big5", "utf-16", "utf-16-le", "utf-16-be", "latin-1")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus records of a JSON list; a ``meta`` that is no object becomes empty fields."""
    rows = spark.read.schema(CORPUS_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("meta", F.coalesce("meta", F.struct(*[F.lit(None).cast("string").alias(f) for f in META])))


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """Records of the tagged export: blocks between blank lines, one row each, absent labels null."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).filter(F.trim("value") != "")
    return blocks.select(*[tagged_field(F.col("value"), f).alias(f) for f in LABELS.values()])


def corpus_of_tagged(records: DataFrame) -> DataFrame:
    """Corpus rows of tagged records with a title; the id is made from it, the year may come from the time."""
    rows = records.withColumn("title", T.trim(T.empty_if_null(F.col("title")))).filter("title <> ''")
    year = T.trim(T.empty_if_null(F.col("year")))
    rows = rows.withColumn("year", F.when(year != "", year).otherwise(F.substring(T.empty_if_null(F.col("time")), 1, 4)))
    return rows.select(F.concat(F.lit("paper_"), F.md5("title")).alias("id"), F.struct(*[F.col(f) for f in META]).alias("meta"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph file; of nodes of one label and name the first properties hold."""
    rows = spark.read.schema(GRAPH_SCHEMA).option("multiLine", True).json(path).withColumn("pos", F.monotonically_increasing_id())
    ends = rows.select("pos", F.posexplode(F.array("start_node", "end_node")).alias("side", "n"))
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LEVELS.items() for x in p]), F.col("label")), F.lit(2))
    nodes = ends.groupBy(F.col("n.label").alias("label"), F.col("n.properties.name").alias("name")).agg(F.min_by("n.properties", F.struct("pos", "side")).alias("properties")).withColumn("level", level)
    key = lambda p: F.concat_ws("|", f"{p}.label", f"{p}.properties.name")
    return nodes, rows.select(key("start_node").alias("src"), "relation", key("end_node").alias("dst"), "edge_properties.*")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the older XML form with keys d0 (label), d1 (properties), d2 (level), d3 (relation)."""
    data = "array<struct<_key: string, _VALUE: string>>"
    value = lambda k: F.get(F.filter("data", lambda d: d["_key"] == k), F.lit(0))["_VALUE"]
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, data {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, data {data}").load(path)
    return (
        nodes.select(F.col("_id").alias("node_id"), value("d0").alias("label"), value("d1").alias("properties"), F.coalesce(value("d2").try_cast("int"), F.lit(2)).alias("level")),
        edges.select(F.col("_source").alias("src"), F.btrim(value("d3"), F.lit('"')).alias("relation"), F.col("_target").alias("dst")),
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``(chunk_id, text, title)`` of a chunk file; lines of another form keep their text with an empty id."""
    lines = spark.read.text(path)
    line = F.col("value")
    text = F.when(T.chunk_line_id(line) == "", line).otherwise(T.chunk_line_text(line))
    return lines.select(T.chunk_line_id(line).alias("chunk_id"), text.alias("text"), T.chunk_title(text).alias("title"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; bad lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def latest_per_key(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key: what a cache that is appended to holds."""
    columns = [c for c in rows.columns if c != key]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as text by the first encoding that reads them; the last one reads all."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return raw.decode("utf-16", "replace")
        for encoding in ENCODINGS:
            try:
                return raw.decode(encoding).lstrip("﻿")
            except UnicodeDecodeError:
                continue
        return raw.decode("utf-8", "replace")

    return content.map(one)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """``(path, kind, title, text)`` of uploaded files: plain text, Markdown and JSON as text, others unread."""
    files = spark.read.format("binaryFile").load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[A-Za-z0-9]+$", "")
    readable = extension.isin("txt", "md", "json")
    return files.select("path", extension.alias("kind"), name.alias("title"), F.when(readable, decoded("content")).alias("text"))


def read_questions(spark: SparkSession, path: str, required: tuple[str, ...] = ("question_id", "question")) -> DataFrame:
    """Questions of a JSON list; missing required fields and repeated ids are errors."""
    rows = spark.read.schema("question_id string, question_type string, question string, reference_answer string, eval_focus string, source_sheet string, row_number int").option("multiLine", True).json(path)
    for field in required:
        rows = rows.withColumn(field, F.when(T.trim(T.empty_if_null(F.col(field))) == "", F.raise_error(F.lit(f"question without {field}"))).otherwise(F.col(field)))
    n = F.count("*").over(Window.partitionBy("question_id"))
    return rows.withColumn("question_id", F.when(n > 1, F.raise_error(F.concat(F.lit("repeated question_id "), "question_id"))).otherwise(F.col("question_id")))


def read_excel_questions(spark: SparkSession, path: str, sheet: str = "dataset") -> DataFrame:
    """Questions of a spreadsheet, read on the driver: a hand-made file of a few hundred rows."""
    frame = pd.read_excel(path, sheet_name=sheet, dtype=str).fillna("")
    frame.insert(0, "row_number", range(2, len(frame) + 2))
    return spark.createDataFrame(frame)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold facts of annotated samples: ``(id, status, kind, subject, relation, object)``."""
    extraction = "struct<entity_types: map<string, string>, triples: array<array<string>>, attributes: map<string, array<string>>>"
    rows = spark.read.schema(f"id string, kg_eval struct<gold: struct<status: string, extraction: {extraction}>>").option("multiLine", True).json(path)
    gold = rows.select("id", F.coalesce(T.trim(F.col("kg_eval.gold.status")), F.lit("pending")).alias("status"), "kg_eval.gold.extraction.*")
    types = gold.select("id", "status", F.lit("entity").alias("kind"), F.explode("entity_types").alias("subject", "object")).withColumn("relation", F.lit(""))
    triples = gold.select("id", "status", F.lit("triple").alias("kind"), F.explode(T.valid_triples(F.col("triples"))).alias("t")).select(
        "id", "status", "kind", F.col("t")[0].alias("subject"), F.col("t")[2].alias("object"), F.col("t")[1].alias("relation")
    )
    attributes = gold.select("id", "status", F.lit("attribute").alias("kind"), F.explode("attributes").alias("subject", "vs")).select("id", "status", "kind", "subject", F.explode("vs").alias("object")).withColumn("relation", F.lit(""))
    return types.unionByName(triples).unionByName(attributes).select("id", "status", "kind", "subject", "relation", "object")


def read_schema_types(spark: SparkSession, path: str) -> DataFrame:
    """``(kind, name)`` of an ontology file with Nodes, Relations and Attributes."""
    rows = spark.read.schema("Nodes array<string>, Relations array<string>, Attributes array<string>").option("multiLine", True).json(path)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(k, F.array()).alias("names")) for k in ("Nodes", "Relations", "Attributes")])
    return rows.select(F.explode(kinds).alias("k")).select("k.kind", F.explode("k.names").alias("name")).distinct()


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """An alias dictionary in YAML over the built-in one: a small file read on the driver."""
    import yaml

    from corpusloom.operators.identity import alias_table

    with open(path, encoding="utf-8") as handle:
        found = (yaml.safe_load(handle) or {}).get("entity_aliases", {})
    merged = {kind: {name: list(aliases) for name, aliases in names.items()} for kind, names in V.ENTITY_ALIASES.items()}
    for kind, names in found.items():
        for name, aliases in (names or {}).items():
            merged.setdefault(kind, {}).setdefault(name, []).extend(aliases or [])
    return alias_table(spark, merged)
