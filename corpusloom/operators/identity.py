"""Keys of documents, nodes and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import vocabulary as V
from corpusloom.functions import text as T


def base_id(doc_id: Column, title: Column) -> Column:
    """The given id, or one made from the title."""
    given = T.trim(T.empty_if_null(doc_id))
    return F.when(given != "", given).otherwise(F.concat(F.lit("paper_"), F.md5(T.empty_if_null(title)).substr(1, 12)))


def with_doc_uid(corpus: DataFrame) -> DataFrame:
    """Adds ``base_id`` and ``doc_uid``: the id, with a digest of the content where an id occurs more than once.

    Repeats are counted by a grouped sum and joined back, so an id that a third of
    all records carry is combined before it is shuffled."""
    m = {f: T.empty_if_null(F.col(f"meta.{f}")) for f in ("title", "source", "year", "authors")}
    rows = corpus.withColumn("base_id", base_id(F.col("id"), F.col("meta.title")))
    repeated = rows.groupBy("base_id").agg(F.count("*").alias("n")).filter("n > 1").select("base_id", F.lit(True).alias("repeated"))
    digest = F.md5(F.concat_ws("|", "base_id", m["title"], m["source"], m["year"], m["authors"])).substr(1, 10)
    return rows.join(repeated, "base_id", "left").withColumn("doc_uid", F.when(F.col("repeated"), F.concat("base_id", F.lit("__"), digest)).otherwise(F.col("base_id"))).drop("repeated")


def alias_table(spark: SparkSession, groups: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """``(type_key, alias_key, canonical)`` of an alias dictionary."""
    groups = groups if groups is not None else V.ENTITY_ALIASES
    rows = [(kind, alias, canonical) for kind, names in groups.items() for canonical, aliases in names.items() for alias in [canonical, *aliases]]
    table = spark.createDataFrame(rows, "type_key string, alias string, canonical string")
    return table.select("type_key", T.name_key(F.col("alias")).alias("alias_key"), "canonical").distinct()


def resolve_names(mentions: DataFrame, aliases: DataFrame, name: str = "name", kind: str = "type") -> DataFrame:
    """Adds ``canonical`` and ``entity_key``: by the alias itself, by ``base (ALIAS)`` as a whole, its base or its alias, else the name.

    The dictionary is small by nature; Spark broadcasts it if its size allows."""
    whole = T.normalize_text(F.col(name), strip_outer_brackets=False, compose=False)
    form = r"^(.+?)[(（]([A-Za-z][A-Za-z0-9 ._+-]{1,24})[)）]$"
    keys = {"k0": T.name_key(F.col(name)), "k1": T.name_key(F.regexp_extract(whole, form, 1)), "k2": T.name_key(F.regexp_extract(whole, form, 2))}
    rows = mentions.withColumn("__kind", T.canonical_type(F.col(kind)))
    for k, key in keys.items():
        found = aliases.select(F.col("type_key").alias("__kind"), F.col("alias_key").alias(f"__{k}"), F.col("canonical").alias(f"__{k}_name"))
        rows = rows.withColumn(f"__{k}", key).join(found, ["__kind", f"__{k}"], "left")
    canonical = F.coalesce("__k0_name", "__k1_name", "__k2_name", whole)
    return rows.withColumn("canonical", canonical).withColumn("entity_key", T.name_key(F.col("canonical"))).select(*mentions.columns, "canonical", "entity_key")


def resolve_entities(mentions: DataFrame) -> DataFrame:
    """Nodes of ``(doc_pos, mention_pos, name, type, entity_key)`` as sets: one per key and type.

    A mention without type goes to the typed node of its key that is mentioned
    first, if there is one.  The name is the first mention's, the others are
    aliases; the id depends on key and type only."""
    typed = mentions.filter("type <> '' AND entity_key <> ''")
    position = F.struct("doc_pos", "mention_pos", "name")
    first_type = typed.groupBy("entity_key").agg(F.min_by("type", position).alias("first_type"))
    placed = mentions.filter("entity_key <> ''").join(first_type, "entity_key", "left").withColumn("type", F.when(F.col("type") == "", F.coalesce("first_type", F.lit(""))).otherwise(F.col("type")))
    nodes = placed.groupBy("entity_key", "type").agg(F.min_by("name", position).alias("name"), F.collect_set("name").alias("names"), F.count("*").alias("mentions"))
    return nodes.select(
        F.sha1(F.concat_ws("|", "entity_key", "type")).alias("node_id"), "entity_key", "type", "name", F.sort_array(F.array_except("names", F.array("name"))).alias("aliases"), "mentions"
    )
