"""Exported records: JSON objects, or lines of the tagged export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of the tagged export and the fields they name.
LABELS = {
    "SrcDatabase-来源库": "database",
    "Title-题名": "title",
    "Author-作者": "authors",
    "Organ-单位": "organ",
    "Source-文献来源": "source",
    "Keyword-关键词": "keywords",
    "Summary-摘要": "abstract",
    "PubTime-发表时间": "time",
    "Year-年": "year",
    "DOI-DOI": "doi",
}


def tagged_field(raw: Column, field: str) -> Column:
    """The value of the last line that carries the field's label; null if there is none."""
    label = next(k for k, v in LABELS.items() if v == field)
    values = F.regexp_extract_all(raw, F.lit(rf"(?m)^[ \t]*\Q{label}\E[ \t]*:[ \t]*([^\r\n]*)"), F.lit(1))
    return F.try_element_at(values, F.lit(-1))


def parse_exported(df: DataFrame, fields: list[str], raw_col: str = "raw", fmt_col: str = "fmt") -> DataFrame:
    """Adds a column per field, read by the row's format; absent keys give null."""
    raw, fmt = F.col(raw_col), F.col(fmt_col)
    schema = ", ".join(f"`{f}` string" for f in fields)
    parsed = F.from_json(F.when(fmt == "json", raw), schema)
    return df.withColumn("__json", parsed).select(
        *[F.col(c) for c in df.columns],
        *[F.when(fmt == "json", F.col(f"__json.{f}")).when(fmt == "tagged", tagged_field(raw, f)).alias(f) for f in fields],
    )
