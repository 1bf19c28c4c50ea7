"""Problem 5: samples that match target quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.proportions import stratified_sample, stratum_report
from corpusloom.session import read


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stratum with its target, what the pool holds and its quota."""
    return stratum_report(read(spark, sf_dir, "kgval_pool"), read(spark, sf_dir, "kgval_strata"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_report(spark, sf_dir).filter("short").select("run_id", "year", "length_bin")


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled papers."""
    return stratified_sample(read(spark, sf_dir, "kgval_pool"), p5_report(spark, sf_dir))


_HELD = r"""
WITH plain AS (
  SELECT run_id, id, translate(coalesce(year, ''), '０１２３４５６７８９．', '0123456789.') AS y,
    regexp_replace(translate(coalesce(length_bin, ''), '０１２３４５６７８９＜＞＝～－＋–—−‐至到', '0123456789<>=~-+------'), '\s+', '', 'g') AS b
  FROM kgval_pool WHERE id IS NOT NULL AND id <> ''
), filed AS (
  SELECT DISTINCT run_id, id, coalesce(nullif(regexp_extract(y, '[0-9]{4}'), ''), 'UNKNOWN') AS year,
    CASE WHEN b IN ('<=200', '≤200', '0-200', '<200') THEN '<=200' WHEN b IN ('201-400', '201~400') THEN '201-400' WHEN b IN ('401-800', '401~800') THEN '401-800'
         WHEN b IN ('>800', '801+') THEN '>800' ELSE 'UNKNOWN' END AS length_bin
  FROM plain
), held AS (SELECT run_id, year, length_bin, count(*) AS available FROM filed GROUP BY ALL)
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report, "p5_sample": p5_sample}
ORACLE = {
    "p5_found": _HELD
    + "SELECT s.run_id, s.year, s.length_bin FROM kgval_strata s LEFT JOIN held h USING (run_id, year, length_bin) WHERE coalesce(h.available, 0) < greatest(coalesce(s.target_quota, 0), coalesce(s.min_count, 0))",
}
