"""SQL pieces that several oracles share."""

from corpusloom import vocabulary as V
from corpusloom.functions.text import SPACES, WHITE


def trim(x: str, more: str = "") -> str:
    return f"trim({x}, '{SPACES}{more}')"


def spaces(x: str) -> str:
    return trim(f"regexp_replace(coalesce({x}, ''), '{WHITE}+', ' ', 'g')")


def name_key(x: str) -> str:
    return f"regexp_replace(regexp_replace(replace(lower(trim({spaces(x)}, '\"''“”‘’')), 'ς', 'σ'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '{WHITE}+', '', 'g')"


def in_order(values: str) -> str:
    """Distinct values of a list, first occurrences in order."""
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


def split_metadata(x: str) -> str:
    t = spaces(x)
    parts = f"CASE WHEN regexp_matches({t}, '[;；]') THEN regexp_split_to_array({t}, '[;；]+') ELSE regexp_split_to_array({t}, '[、,，]+') END"
    return f"list_filter(list_transform({parts}, lambda p: trim(p, ' \t\r\n;；,，、')), lambda p: p <> '')"


def is_author(x: str) -> str:
    names = ", ".join(f"'{n}'" for n in V.GENERIC_NAMES)
    t = trim(x)
    return f"({t} <> '' AND {t} NOT IN ({names}) AND NOT regexp_matches({t}, '[《》]|{'|'.join(V.AUTHOR_BLACKLIST)}'))"


def primary_organisation(x: str) -> str:
    cases = " ".join(f"WHEN strpos({x}, '{s}') > 0 THEN substr({x}, 1, strpos({x}, '{s}') + {len(s) - 1})" for s in V.ORGANISATION_SUFFIXES)
    return f"(CASE {cases} ELSE {x} END)"


def length_bin(x: str) -> str:
    return f"CASE WHEN {x} <= 200 THEN '<=200' WHEN {x} <= 400 THEN '201-400' WHEN {x} <= 800 THEN '401-800' ELSE '>800' END"


DOCS = f"""
raw AS (SELECT rec_no AS pos, meta.title AS title, meta.authors AS authors, meta.organ AS organ, meta.source AS source, meta.keywords AS keywords, meta.abstract AS abstract, meta.year AS year,
  CASE WHEN {trim("coalesce(id, '')")} <> '' THEN {trim('id')} ELSE 'paper_' || substr(md5(coalesce(meta.title, '')), 1, 12) END AS base_id FROM demo_corpus),
docs AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY base_id) > 1
  THEN base_id || '__' || substr(md5(concat_ws('|', base_id, coalesce(title, ''), coalesce(source, ''), coalesce(year, ''), coalesce(authors, ''))), 1, 10) ELSE base_id END AS doc_uid FROM raw)
"""

EDGES = f"""
{DOCS}, split AS (SELECT doc_uid, pos, title, {trim("coalesce(source, '')")} AS journal, {split_metadata('authors')} AS a, {split_metadata('organ')} AS o FROM docs WHERE {trim("coalesce(title, '')")} <> ''),
listed AS (SELECT doc_uid, pos, journal, list_filter({in_order('a')}, lambda x: {is_author('x')})[1:3] AS people, list_transform(o, lambda x: {primary_organisation(spaces('x'))}) AS o2 FROM split),
fixed AS (SELECT doc_uid, pos, journal, people, {in_order('o2')} AS organs FROM listed),
written AS (SELECT doc_uid, pos, unnest(people) AS person, unnest(range(len(people))) AS i, organs FROM fixed),
placed AS (SELECT doc_uid, pos, person, CASE WHEN len(organs) = 1 OR i >= len(organs) THEN organs[1] ELSE organs[i + 1] END AS organ FROM written WHERE len(organs) > 0),
firsts AS (SELECT doc_uid, pos, person, organ FROM placed QUALIFY row_number() OVER (PARTITION BY person ORDER BY pos, organ) = 1),
edges AS (
  SELECT 'paper::' || doc_uid AS src, '发表于' AS relation, 'journal::' || journal AS dst, 0.95::DOUBLE AS confidence, doc_uid, pos FROM fixed WHERE journal <> ''
  UNION ALL SELECT 'author::' || person, '撰写', 'paper::' || doc_uid, 0.95::DOUBLE, doc_uid, pos FROM written
  UNION ALL SELECT 'author::' || person, '隶属', 'organ::' || organ, 0.9::DOUBLE, doc_uid, pos FROM firsts),
dedup AS (SELECT src, dst, relation, arg_min(confidence, struct_pack(pos := pos, doc_uid := doc_uid)) AS confidence, list_sort(list_distinct(list(doc_uid))) AS evidence, min(pos) AS pos FROM edges GROUP BY src, dst, relation)
"""

TRIPLES = r"""
pred AS (SELECT pred_no, question_id, unnest(retrieved_triples) AS triple, unnest(range(len(retrieved_triples))) AS pos FROM qaprediction),
triples AS (SELECT pred_no, question_id, pos, triple,
  trim(regexp_extract(triple, '^\((.*), ([^,]*), ([^,]*)\)(?: \[score: [0-9.]+\])?$', 1)) AS head,
  trim(regexp_extract(triple, '^\((.*), ([^,]*), ([^,]*)\)(?: \[score: [0-9.]+\])?$', 2)) AS relation,
  trim(regexp_extract(triple, '^\((.*), ([^,]*), ([^,]*)\)(?: \[score: [0-9.]+\])?$', 3)) AS tail,
  try_cast(regexp_extract(triple, '\[score:\s*([0-9.]+)\]', 1) AS DOUBLE) AS score FROM pred)
"""

CHAR_KEYWORDS = r"list_concat(regexp_extract_all(coalesce({q}, ''), '[\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}]{{2,4}}'), regexp_extract_all(lower(coalesce({q}, '')), '[a-z0-9]{{2,}}'))"
