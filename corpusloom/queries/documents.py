"""Queries over documents, chunks, names and fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.identity import alias_table, resolve_entities, resolve_names, with_doc_uid
from corpusloom.queries import sql as S
from corpusloom.session import read, spread
from corpusloom.sources.raw_export import parse_exported


def corpus_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus records with their uid and their fields as columns."""
    rows = with_doc_uid(spread(read(spark, sf_dir, "demo_corpus").select("rec_no", "id", "meta")))
    return rows.select("doc_uid", "base_id", F.col("rec_no").alias("pos"), *[F.col(f"meta.{f}").alias(f) for f in ("title", "authors", "organ", "source", "keywords", "abstract", "year", "time")])


def doc_uid(spark, sf_dir):
    return corpus_docs(spark, sf_dir).select("pos", "doc_uid")


def duplicate_ids(spark, sf_dir):
    return corpus_docs(spark, sf_dir).groupBy("base_id").agg(F.count("*").alias("n")).filter("n > 1")


def chunk_build(spark, sf_dir):
    text = T.chunk_text(F.col("title"), F.col("abstract"))
    return corpus_docs(spark, sf_dir).select("pos", F.col("doc_uid").alias("chunk_id"), F.md5(text).alias("digest"), F.length(text).alias("chars"))


def chunk_codec(spark, sf_dir):
    """Chunks through the line form of the chunk file and back."""
    docs = corpus_docs(spark, sf_dir)
    line = T.chunk_line(F.col("doc_uid"), T.chunk_text(T.collapse_spaces(F.col("title")), T.collapse_spaces(F.col("abstract"))))
    rows = docs.select("pos", line.alias("line"))
    return rows.select("pos", T.chunk_line_id(F.col("line")).alias("chunk_id"), T.chunk_title(F.col("line")).alias("title"), F.length(T.chunk_line_text(F.col("line"))).alias("chars"))


def chunk_audit(spark, sf_dir):
    docs = corpus_docs(spark, sf_dir)
    text = T.chunk_text(F.col("title"), F.col("abstract"))
    return docs.groupBy("doc_uid").agg(F.count("*").alias("records"), F.max(F.length(text)).alias("chars"), F.min("pos").alias("first_pos"), F.max(T.trim(T.empty_if_null(F.col("title"))) != "").alias("titled"))


def embedding_text(spark, sf_dir):
    text = T.chunk_embedding_text(F.col("title"), F.col("keywords"), F.col("abstract"))
    return corpus_docs(spark, sf_dir).select("pos", F.length(text).alias("chars"), F.length(T.truncated(F.col("abstract"), 80)).alias("head_chars"))


def name_key(spark, sf_dir):
    return corpus_docs(spark, sf_dir).select("title").filter("title IS NOT NULL").distinct().select(T.name_key(F.col("title")).alias("key")).groupBy("key").agg(F.count("*").alias("titles"))


def split_fields(spark, sf_dir):
    docs = corpus_docs(spark, sf_dir)
    fields = F.array(*[F.struct(F.lit(f).alias("field"), T.split_metadata(F.col(f)).alias("vs")) for f in ("authors", "organ", "keywords")])
    return docs.select("pos", F.explode(fields).alias("f")).select("pos", "f.field", F.posexplode("f.vs").alias("i", "value"))


def author_validity(spark, sf_dir):
    people = corpus_docs(spark, sf_dir).select(F.explode(T.split_metadata(F.col("authors"))).alias("name"))
    return people.groupBy(T.is_author_name(F.col("name")).alias("valid")).agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


def primary_organisation(spark, sf_dir):
    organs = corpus_docs(spark, sf_dir).select(F.explode(T.split_metadata(F.col("organ"))).alias("name"))
    return organs.groupBy(T.primary_organisation(F.col("name")).alias("organ")).agg(F.count("*").alias("n"))


def keyword_attributes(spark, sf_dir):
    docs = corpus_docs(spark, sf_dir).filter("keywords IS NOT NULL")
    values = F.array(F.concat(F.lit("关键词: "), "keywords"), F.concat(F.lit("年份: "), T.year_label(F.col("year"))))
    return docs.select("pos", F.size(T.attribute_values(values)).alias("n_values"), F.get(T.attribute_values(values), F.lit(0)).alias("first_value"))


def resolved_keywords(spark, sf_dir):
    """Keywords as technologies, short forms resolved by the alias dictionary."""
    words = corpus_docs(spark, sf_dir).select(F.explode(T.split_keywords(F.col("keywords"))).alias("name"), F.lit("technology").alias("type"))
    counted = words.groupBy("name", "type").agg(F.count("*").alias("n"))
    return resolve_names(counted, alias_table(spark)).groupBy("entity_key").agg(F.sum("n").alias("mentions"), F.count("*").alias("spellings"), F.min("canonical").alias("canonical"))


def entities(spark, sf_dir):
    """Nodes for authors, organisations and keywords, as sets with aliases."""
    docs = corpus_docs(spark, sf_dir)
    sources = F.array(*[F.struct(F.lit(kind).alias("type"), T.split_metadata(F.col(f)).alias("vs")) for kind, f in (("作者", "authors"), ("机构", "organ"), ("技术", "keywords"))])
    mentions = docs.select(F.col("pos").alias("doc_pos"), F.explode(sources).alias("s")).select("doc_pos", "s.type", F.posexplode("s.vs").alias("mention_pos", "name")).withColumn("entity_key", T.name_key(F.col("name")))
    nodes = resolve_entities(mentions)
    return nodes.select("node_id", "type", "name", F.size("aliases").alias("n_aliases"), "mentions")


def char_keywords(spark, sf_dir):
    words = read(spark, sf_dir, "demo").select("pair_no", F.explode(T.char_keywords(F.col("question"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("questions"))


def fact_intent(spark, sf_dir):
    return read(spark, sf_dir, "demo").groupBy(T.has_fact_intent(F.col("question")).alias("fact_intent")).agg(F.count("*").alias("n"))


def mojibake_markers(spark, sf_dir):
    """Lines that hold a character typical of wrong decoding."""
    from corpusloom import vocabulary as V

    lines = corpus_docs(spark, sf_dir).select("pos", F.posexplode(F.split(T.empty_if_null(F.col("abstract")), "\n")).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike("|".join(V.MOJIBAKE_MARKERS))).select("pos", "line_no")


def refusals(spark, sf_dir):
    return read(spark, sf_dir, "qaprediction").groupBy(T.is_refusal(F.col("answer")).alias("refusal")).agg(F.count("*").alias("n"))


def exported_records(spark, sf_dir):
    """Records of the export with a title, their id made from it, and the year or the first four characters of the time."""
    rows = parse_exported(read(spark, sf_dir, "raw_export"), ["title", "doi", "database", "source", "year", "time"])
    titled = rows.withColumn("title", T.trim(T.empty_if_null(F.col("title")))).filter("title <> ''")
    year = T.trim(T.empty_if_null(F.col("year")))
    return titled.select("raw_no", F.concat(F.lit("paper_"), F.md5("title")).alias("id"), F.when(year != "", year).otherwise(T.trim(T.empty_if_null(F.col("time"))).substr(1, 4)).alias("year"))


def consistency(spark, sf_dir):
    """References to papers that the corpus lacks, by where they stand."""
    ids = read(spark, sf_dir, "demo_corpus").select("id").filter("id IS NOT NULL").distinct()
    documents = read(spark, sf_dir, "documents").select(F.lit("documents").alias("tab"), F.col("paper_id").alias("id"))
    chunks = read(spark, sf_dir, "qaprediction").select(F.lit("qaprediction").alias("tab"), F.explode("retrieved_chunks").alias("id"))
    pool = read(spark, sf_dir, "kgval_pool").select(F.lit("kgval_pool").alias("tab"), "id")
    used = documents.unionByName(chunks).unionByName(pool).filter("id IS NOT NULL AND id <> ''").groupBy("tab", "id").agg(F.count("*").alias("uses"))
    marked = used.join(ids.withColumn("known", F.lit(1)), "id", "left")
    return marked.groupBy("tab").agg(F.count("*").alias("papers"), F.count_if(F.col("known").isNull()).alias("missing"), F.sum("uses").alias("uses"))


QUERIES = {
    "q_doc_uid": doc_uid, "q_duplicate_ids": duplicate_ids, "q_chunk_build": chunk_build, "q_chunk_codec": chunk_codec, "q_chunk_audit": chunk_audit, "q_embedding_text": embedding_text,
    "q_name_key": name_key, "q_split_multivalue": split_fields, "q_author_validity": author_validity, "q_primary_org": primary_organisation, "q_keyword_attributes": keyword_attributes,
    "q_alias_resolve": resolved_keywords, "q_entities": entities, "q_char_keywords": char_keywords, "q_fact_intent": fact_intent, "q_mojibake": mojibake_markers, "q_refusal": refusals,
    "q_tagged_records": exported_records, "q_consistency_audit": consistency,
}

_TEXT = "'Title: ' || coalesce(title, '') || chr(10) || 'Abstract: ' || coalesce(abstract, '')"
_KW = "list_filter(list_transform(regexp_split_to_array(coalesce(keywords, ''), '[;；,，|/\\\\]+'), lambda p: " + S.trim('p') + "), lambda p: p <> '')"
_HEAD = f"concat_ws(' ', CASE WHEN {S.spaces('title')} <> '' THEN 'Title: ' || {S.spaces('title')} END, CASE WHEN {S.spaces('keywords')} <> '' THEN 'Keywords: ' || {S.spaces('keywords')} END)"
ORACLE = {
    "q_doc_uid": f"WITH {S.DOCS} SELECT pos, doc_uid FROM docs",
    "q_duplicate_ids": f"WITH {S.DOCS} SELECT base_id, count(*) AS n FROM docs GROUP BY base_id HAVING count(*) > 1",
    "q_chunk_build": f"WITH {S.DOCS} SELECT pos, doc_uid AS chunk_id, md5({_TEXT}) AS digest, length({_TEXT}) AS chars FROM docs",
    "q_chunk_codec": f"WITH {S.DOCS}, t AS (SELECT *, {S.spaces('title')} AS tt FROM docs) SELECT pos, doc_uid AS chunk_id, "
    f"CASE WHEN split_part(tt, 'Abstract:', 1) = '' THEN 'Unknown Paper' ELSE {S.trim("split_part(tt, 'Abstract:', 1)")} END AS title, 18 + length(tt) + length({S.spaces('abstract')}) AS chars FROM t",
    "q_chunk_audit": f"WITH {S.DOCS} SELECT doc_uid, count(*) AS records, max(length({_TEXT})) AS chars, min(pos) AS first_pos, bool_or({S.trim("coalesce(title, '')")} <> '') AS titled FROM docs GROUP BY doc_uid",
    "q_embedding_text": f"WITH {S.DOCS}, h AS (SELECT pos, {_HEAD} AS head, {S.spaces('abstract')} AS a FROM docs), "
    "r AS (SELECT pos, head, a, rtrim(substr(a, 1, greatest(80, 480 - length(head) - CASE WHEN head = '' THEN 0 ELSE 1 END)::BIGINT)) AS tail FROM h) "
    "SELECT pos, length(rtrim(substr(trim(concat_ws(' ', head, CASE WHEN tail <> '' THEN 'Abstract: ' || tail END)), 1, 480))) AS chars, length(rtrim(substr(a, 1, 80))) AS head_chars FROM r",
    "q_name_key": f"WITH {S.DOCS}, t AS (SELECT DISTINCT title FROM docs WHERE title IS NOT NULL) SELECT {S.name_key('title')} AS key, count(*) AS titles FROM t GROUP BY 1",
    "q_split_multivalue": f"WITH {S.DOCS}, f AS (SELECT pos, 'authors' AS field, {S.split_metadata('authors')} AS v FROM docs UNION ALL SELECT pos, 'organ', {S.split_metadata('organ')} FROM docs "
    f"UNION ALL SELECT pos, 'keywords', {S.split_metadata('keywords')} FROM docs), u AS (SELECT pos, field, {S.in_order('v')} AS v FROM f) SELECT pos, field, unnest(range(len(v))) AS i, unnest(v) AS value FROM u",
    "q_author_validity": f"WITH {S.DOCS}, a AS (SELECT pos, {S.split_metadata('authors')} AS v FROM docs), n AS (SELECT unnest({S.in_order('v')}) AS name FROM a) "
    f"SELECT {S.is_author('name')} AS valid, count(*) AS n, count(DISTINCT name) AS names FROM n GROUP BY 1",
    "q_primary_org": f"WITH {S.DOCS}, a AS (SELECT pos, {S.split_metadata('organ')} AS v FROM docs), n AS (SELECT unnest({S.in_order('v')}) AS name FROM a) SELECT {S.primary_organisation('name')} AS organ, count(*) AS n FROM n GROUP BY 1",
    "q_keyword_attributes": f"WITH {S.DOCS}, w AS (SELECT pos, {S.spaces("'关键词: ' || keywords")} AS whole, {S.spaces("'年份: ' || CASE WHEN " + S.trim("coalesce(year, '')") + " = '' THEN 'UNKNOWN' ELSE " + S.trim('year') + ' END')} AS y FROM docs WHERE keywords IS NOT NULL), "
    r"b AS (SELECT pos, whole, y, regexp_extract(whole, '(?i)^\s*(?:关键词|关键字|keywords?)\s*[:：]\s*(.+)$', 1) AS body FROM w), "
    f"v AS (SELECT pos, list_append(CASE WHEN body <> '' THEN list_transform(list_filter(list_transform(regexp_split_to_array(body, '[;；,，/、]+'), lambda p: {S.trim('p')}), lambda p: p <> ''), lambda p: '关键词: ' || p) ELSE [whole] END, y) AS vs FROM b) "
    "SELECT pos, len(list_distinct(vs)) AS n_values, vs[1] AS first_value FROM v",
    "q_alias_resolve": f"WITH {S.DOCS}, w AS (SELECT unnest({_KW}) AS name FROM docs), c AS (SELECT name, count(*) AS n FROM w GROUP BY name), k AS (SELECT name, n, {S.name_key('name')} AS key, trim({S.spaces('name')}, '\"''“”‘’') AS whole FROM c), "
    "r AS (SELECT name, n, CASE WHEN key IN ('生成式人工智能', 'aigc', 'genai', '生成式ai', '人工智能生成内容', '生成式人工智能aigc', '人工智能生成内容aigc') THEN '生成式人工智能' ELSE whole END AS canonical FROM k) "
    f"SELECT {S.name_key('canonical')} AS entity_key, sum(n) AS mentions, count(*) AS spellings, min(canonical) AS canonical FROM r GROUP BY 1",
    "q_entities": f"WITH {S.DOCS}, f AS (SELECT pos, '作者' AS type, {S.split_metadata('authors')} AS v FROM docs UNION ALL SELECT pos, '机构', {S.split_metadata('organ')} FROM docs UNION ALL SELECT pos, '技术', {S.split_metadata('keywords')} FROM docs), "
    f"u AS (SELECT pos, type, {S.in_order('v')} AS v FROM f), m AS (SELECT pos, type, unnest(range(len(v))) AS i, unnest(v) AS name FROM u), k AS (SELECT *, {S.name_key('name')} AS key FROM m) "
    "SELECT sha1(concat_ws('|', key, type)) AS node_id, type, arg_min(name, struct_pack(p := pos, i := i, n := name)) AS name, count(DISTINCT name) - 1 AS n_aliases, count(*) AS mentions FROM k WHERE key <> '' GROUP BY key, type",
    "q_char_keywords": f"WITH w AS (SELECT pair_no, unnest(list_distinct({S.CHAR_KEYWORDS.format(q='question')})) AS word FROM demo) SELECT word, count(*) AS questions FROM w GROUP BY word",
    "q_fact_intent": "SELECT regexp_matches(lower(coalesce(question, '')), '谁|作者|撰写|提出|框架|方法|期刊|发表于|是什么|who|author|framework|method') AS fact_intent, count(*) AS n FROM demo GROUP BY 1",
    "q_mojibake": "WITH l AS (SELECT rec_no AS pos, string_split(coalesce(meta.abstract, ''), chr(10)) AS v FROM demo_corpus), u AS (SELECT pos, unnest(range(len(v))) AS line_no, unnest(v) AS line FROM l) "
    "SELECT pos, line_no FROM u WHERE regexp_matches(line, '鏂|鍏|馃|浼|璁|锛|锟|烘|缁|骞')",
    "q_refusal": "SELECT regexp_matches(lower(coalesce(answer, '')), '无法回答|不能回答|现有资料不足|insufficient|cannot answer|not enough information') AS refusal, count(*) AS n FROM qaprediction GROUP BY 1",
    "q_tagged_records": r"""WITH r AS (
      SELECT raw_no, raw->>'$.title' AS title, raw->>'$.year' AS year, raw->>'$.time' AS t FROM raw_export WHERE fmt = 'json'
      UNION ALL SELECT raw_no, regexp_extract(raw, '(?m)^[ \t]*Title-题名[ \t]*:[ \t]*([^\r\n]*)', 1), regexp_extract(raw, '(?m)^[ \t]*Year-年[ \t]*:[ \t]*([^\r\n]*)', 1),
        regexp_extract(raw, '(?m)^[ \t]*PubTime-发表时间[ \t]*:[ \t]*([^\r\n]*)', 1) FROM raw_export WHERE fmt = 'tagged')
      """
    f"SELECT raw_no, 'paper_' || md5({S.trim('title')}) AS id, CASE WHEN {S.trim("coalesce(year, '')")} <> '' THEN {S.trim('year')} ELSE substr({S.trim("coalesce(t, '')")}, 1, 4) END AS year FROM r WHERE {S.trim("coalesce(title, '')")} <> ''",
    "q_consistency_audit": "WITH u AS (SELECT 'documents' AS tab, paper_id AS id FROM documents UNION ALL SELECT 'qaprediction', unnest(retrieved_chunks) FROM qaprediction UNION ALL SELECT 'kgval_pool', id FROM kgval_pool), "
    "g AS (SELECT tab, id, count(*) AS uses FROM u WHERE id IS NOT NULL AND id <> '' GROUP BY tab, id) "
    "SELECT tab, count(*) AS papers, count(*) FILTER (WHERE id NOT IN (SELECT id FROM demo_corpus WHERE id IS NOT NULL)) AS missing, sum(uses) AS uses FROM g GROUP BY tab",
}
