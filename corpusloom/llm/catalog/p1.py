"""Problem 1: records that differ in form only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.copies import canonical_keys, copies, copy_classes, copy_pairs
from corpusloom.session import read
from corpusloom.sources.raw_export import parse_exported

FIELDS = ["title", "doi", "database"]


def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = canonical_keys(read(spark, sf_dir, "demo_corpus"), "rec_no", [F.col(f"meta.{f}") for f in FIELDS], "demo_corpus")
    exported = parse_exported(read(spark, sf_dir, "raw_export"), FIELDS)
    return corpus.unionByName(canonical_keys(exported, "raw_no", [F.col(f) for f in FIELDS], "raw_export"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members = copies(record_keys(spark, sf_dir))
    return copy_pairs(members)


def p1_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per paper: its first record and the number of its copies."""
    return copy_classes(record_keys(spark, sf_dir)).select("tab", "first_id", F.col("n").alias("n_copies"))


_KEYS = r"""
WITH raw AS (
  SELECT 'demo_corpus' AS tab, rec_no AS id, meta.title AS title, meta.doi AS doi, meta.database AS db FROM demo_corpus
  UNION ALL
  SELECT 'raw_export', raw_no, raw->>'$.title', raw->>'$.doi', raw->>'$.database' FROM raw_export WHERE fmt = 'json'
  UNION ALL
  SELECT 'raw_export', raw_no,
    regexp_extract(raw, '(?m)^[ \t]*Title-题名[ \t]*:([^\n]*)', 1),
    regexp_extract(raw, '(?m)^[ \t]*DOI-DOI[ \t]*:([^\n]*)', 1),
    regexp_extract(raw, '(?m)^[ \t]*SrcDatabase-来源库[ \t]*:([^\n]*)', 1)
  FROM raw_export WHERE fmt = 'tagged'
), folded AS (
  SELECT tab, id,
    regexp_replace(translate(replace(lower(coalesce(title, '')), 'ß', 'ss'), 'ςſµ', 'σsμ'), '[\p{P}\p{Z}\s\x{0085}\x{000b}]+', '', 'g') AS t,
    regexp_replace(translate(replace(lower(coalesce(doi, '')), 'ß', 'ss'), 'ςſµ', 'σsμ'), '[\p{P}\p{Z}\s\x{0085}\x{000b}]+', '', 'g') AS d,
    regexp_replace(translate(replace(lower(coalesce(db, '')), 'ß', 'ss'), 'ςſµ', 'σsμ'), '[\p{P}\p{Z}\s\x{0085}\x{000b}]+', '', 'g') AS b
  FROM raw
), keys AS (SELECT * FROM folded WHERE t <> '')
"""

QUERIES = {"p1_found": p1_found, "p1_copies": p1_copies}
ORACLE = {
    "p1_found": _KEYS
    + "SELECT x.tab, x.id AS id_a, y.id AS id_b FROM keys x JOIN keys y ON x.tab = y.tab AND x.t = y.t AND x.d = y.d AND x.b = y.b AND x.id < y.id",
    "p1_copies": _KEYS + "SELECT tab, min(id) AS first_id, count(*) AS n_copies FROM keys GROUP BY tab, t, d, b",
}
