"""Writers of the file forms in use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def write_graph(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The nested edge list as JSON lines."""
    rows.write.mode(mode).json(path)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nodes and edges as XML rows with keys d0..d3, in two folders."""
    item = lambda key, value: F.struct(F.lit(key).alias("_key"), value.cast("string").alias("_VALUE"))
    xml_nodes = nodes.select(F.col("node_id").alias("_id"), F.array(item("d0", F.col("label")), item("d1", F.to_json(F.struct("name"))), item("d2", F.col("level"))).alias("data"))
    xml_edges = edges.select(F.col("src").alias("_source"), F.col("dst").alias("_target"), F.array(item("d3", F.col("relation"))).alias("data"))
    xml_nodes.write.mode(mode).format("xml").option("rootTag", "graph").option("rowTag", "node").save(f"{path}/nodes")
    xml_edges.write.mode(mode).format("xml").option("rootTag", "graph").option("rowTag", "edge").save(f"{path}/edges")


def write_chunks(chunks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Chunks ``(chunk_id, text)`` as lines of a chunk file, ordered by id."""
    chunks.orderBy("chunk_id").select(T.chunk_line(F.col("chunk_id"), F.col("text")).alias("value")).write.mode(mode).text(path)


def write_chunk_audit(audit: DataFrame, path: str, mode: str = "errorifexists") -> None:
    audit.orderBy("doc_uid").write.mode(mode).json(path)


def write_alias_audit(entities: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Names with more than one spelling, by type and name."""
    entities.filter(F.size("aliases") > 0).orderBy("type", "name").select("type", "name", "aliases").write.mode(mode).json(path)


def append_cache(rows: DataFrame, path: str, key: str) -> int:
    """Adds the rows whose key the cache lacks; gives their number.

    Idempotent: running it again adds nothing."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates([key])
    try:
        known = spark.read.parquet(path).select(key)
        fresh = fresh.join(known, key, "left_anti")
    except Exception as error:  # noqa: BLE001 - the cache does not exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    fresh = fresh.cache()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def write_results(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Evaluation rows as CSV with a header, and as JSON lines."""
    rows.write.mode(mode).option("header", True).csv(f"{path}/csv")
    rows.write.mode(mode).json(f"{path}/json")


def markdown_report(title: str, rows: DataFrame) -> str:
    """A table of all given rows as Markdown, fetched a partition at a time; meant for summaries."""
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in row) + " |" for row in rows.toLocalIterator()]
    return "\n".join(lines) + "\n"
