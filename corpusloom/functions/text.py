"""Text rules as Column expressions; only ``nfkc`` needs Python."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom import vocabulary as V

#: White space as a class of a regular expression, and as the characters themselves.
WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
QUOTES = "\"'“”‘’"
BRACKETS = "()[]{}<>（）【】《》"


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility composition, which has no built-in."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def empty_if_null(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def trim(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACES))


def collapse_spaces(value: Column) -> Column:
    return trim(F.regexp_replace(empty_if_null(value), WHITE + "+", " "))


def normalize_text(value: Column, strip_outer_brackets: bool = True, compose: bool = True) -> Column:
    """Composed, spaces collapsed, without outer quotes and, if wanted, outer brackets."""
    text = F.btrim(collapse_spaces(nfkc(empty_if_null(value)) if compose else value), F.lit(QUOTES))
    return F.btrim(text, F.lit(BRACKETS)) if strip_outer_brackets else text


def name_key(value: Column, compose: bool = False) -> Column:
    """The key names are compared by: lower case, without punctuation and spaces."""
    text = F.translate(F.lower(normalize_text(value, strip_outer_brackets=False, compose=compose)), "ς", "σ")
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", ""), WHITE + "+", "")


def lookup(value: Column, table: dict[str, str]) -> Column:
    """A fixed map applied to the lower-cased value, then the value, else the value itself."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, F.lower(value)), F.try_element_at(entries, value), value)


def canonical_type(value: Column, allowed: tuple[str, ...] | None = None) -> Column:
    """The canonical type; with ``allowed``, types outside become empty."""
    found = lookup(trim(empty_if_null(value)), V.TYPE_ALIASES)
    return found if allowed is None else F.when(found.isin(*allowed), found).otherwise("")


def canonical_relation(value: Column) -> Column:
    raw = trim(empty_if_null(value))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in V.RELATION_SYNONYMS.items() for x in pair]), raw), raw)


def split_metadata(value: Column) -> Column:
    """Distinct values in order: by semicolons if there are any, else by commas."""
    text = collapse_spaces(value)
    parts = F.when(text.rlike("[;；]"), F.split(text, "[;；]+")).otherwise(F.split(text, "[、,，]+"))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(SPACES + ";；,，、"))), lambda p: p != ""))


def split_keywords(value: Column) -> Column:
    """Keywords split at any of the marks in use, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(empty_if_null(value), r"[;；,，|/\\]+"), trim), lambda p: p != "")


def is_author_name(value: Column) -> Column:
    name = trim(empty_if_null(value))
    return (name != "") & ~name.isin(*V.GENERIC_NAMES) & ~name.rlike("[《》]|" + "|".join(V.AUTHOR_BLACKLIST))


def primary_organisation(value: Column) -> Column:
    """Cut after the first suffix of the list that occurs anywhere."""
    name = collapse_spaces(value)
    found = reduce(
        lambda acc, s: acc.when(F.instr(name, s) > 0, name.substr(F.lit(1), F.instr(name, s) + len(s) - 1)),
        V.ORGANISATION_SUFFIXES[1:],
        F.when(F.instr(name, V.ORGANISATION_SUFFIXES[0]) > 0, name.substr(F.lit(1), F.instr(name, V.ORGANISATION_SUFFIXES[0]) + len(V.ORGANISATION_SUFFIXES[0]) - 1)),
    )
    return found.otherwise(name)


def attribute_values(values: Column) -> Column:
    """Attribute texts: keyword attributes split into one each, spaces collapsed, distinct in order."""

    def one(value: Column) -> Column:
        whole = collapse_spaces(value)
        body = F.regexp_extract(whole, r"(?i)^\s*(?:关键词|关键字|keywords?)\s*[:：]\s*(.+)$", 1)
        parts = F.filter(F.transform(F.split(body, "[;；,，/、]+"), trim), lambda p: p != "")
        return F.when(body != "", F.transform(parts, lambda p: F.concat(F.lit("关键词: "), p))).otherwise(F.array(whole))

    return F.array_distinct(F.filter(F.flatten(F.transform(values, one)), lambda p: p != ""))


def valid_triples(triples: Column) -> Column:
    """Arrays of at least three parts, cut to three."""
    return F.transform(F.filter(triples, lambda t: F.size(t) >= 3), lambda t: F.slice(t, 1, 3))


def exact_match_text(value: Column) -> Column:
    """Lower case; everything but letters, digits and underscores becomes one space."""
    return F.btrim(F.regexp_replace(F.translate(F.lower(empty_if_null(value)), "ς", "σ"), r"[^\p{L}\p{N}_]+", " "))


def has_fact_intent(question: Column) -> Column:
    return F.lower(empty_if_null(question)).rlike("|".join(V.FACT_INTENT))


def char_keywords(question: Column) -> Column:
    """Greedy runs of two to four ideographs and Latin words, distinct in order."""
    q = empty_if_null(question)
    han = F.regexp_extract_all(q, F.lit(r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]{2,4}"), F.lit(0))
    return F.array_distinct(F.concat(han, F.regexp_extract_all(F.lower(q), F.lit("[a-z0-9]{2,}"), F.lit(0))))


def chunk_text(title: Column, abstract: Column) -> Column:
    return F.concat(F.lit("Title: "), empty_if_null(title), F.lit("\nAbstract: "), empty_if_null(abstract))


def chunk_line(chunk_id: Column, text: Column) -> Column:
    """A chunk as one line of the chunk file."""
    return F.concat(F.lit("id: "), chunk_id, F.lit("\tChunk: "), F.regexp_replace(text, "\n", " \\\\n "))


def chunk_line_id(line: Column) -> Column:
    return F.regexp_extract(line, "^id: ([^\t]*)\tChunk: ", 1)


def chunk_line_text(line: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(line, "(?s)^id: [^\t]*\tChunk: (.*)$", 1), r" \\n ", "\n")


def chunk_title(text: Column) -> Column:
    """The title of a chunk, or ``Unknown Paper``."""
    found = trim(F.regexp_extract(text, r"(?s)Title:\s*(.*?)(?:\n|\\n|Abstract:|$)", 1))
    return F.when(found == "", "Unknown Paper").otherwise(found)


def truncated(text: Column, limit: int | Column) -> Column:
    """Spaces collapsed, cut to a number of characters, right-trimmed."""
    return F.rtrim(collapse_spaces(text).substr(F.lit(1), F.lit(limit) if isinstance(limit, int) else limit))


def chunk_embedding_text(title: Column, keywords: Column, abstract: Column, limit: int = 480) -> Column:
    """Title and keywords whole, the abstract in what room is left (at least 80 characters)."""
    head = F.concat_ws(" ", *[F.when(collapse_spaces(c) != "", F.concat(F.lit(label), collapse_spaces(c))) for label, c in (("Title: ", title), ("Keywords: ", keywords))])
    room = F.greatest(F.lit(80), F.lit(limit) - F.length(head) - F.when(head == "", 0).otherwise(1))
    tail = truncated(abstract, room)
    return truncated(F.concat_ws(" ", head, F.when(tail != "", F.concat(F.lit("Abstract: "), tail))), limit)


def length_bin(length: Column) -> Column:
    return F.when(length <= 200, V.LENGTH_BINS[0]).when(length <= 400, V.LENGTH_BINS[1]).when(length <= 800, V.LENGTH_BINS[2]).otherwise(V.LENGTH_BINS[3])


def year_label(year: Column) -> Column:
    text = trim(empty_if_null(year))
    return F.when(text == "", "UNKNOWN").otherwise(text)


def year_sort_key(year: Column) -> Column:
    """Digits first, other texts next, UNKNOWN last."""
    return F.struct(F.when(year == "UNKNOWN", 2).when(year.rlike("^[0-9]+$"), 0).otherwise(1).alias("grade"), year.alias("year"))


def is_refusal(answer: Column) -> Column:
    return F.lower(empty_if_null(answer)).rlike("|".join(V.REFUSAL_MARKERS))


def score_of(rendered: Column) -> Column:
    """The score written behind a rendered triple."""
    return F.regexp_extract(rendered, r"\[score:\s*([0-9.]+)\]", 1).try_cast("double")


def triple_part(rendered: Column, part: int) -> Column:
    """Head (1), relation (2) or tail (3) of a triple rendered as ``(head, relation, tail) [score: x]``."""
    return F.btrim(F.regexp_extract(rendered, r"^\((.*), ([^,]*), ([^,]*)\)(?: \[score: [0-9.]+\])?$", part))


def render_triple(head: Column, relation: Column, tail: Column, score: Column) -> Column:
    return F.format_string("(%s, %s, %s) [score: %.3f]", head, relation, tail, score)


def clean_completion(text: Column) -> Column:
    """A model's answer without line-end noise, zero-width characters, code fences and a leading format word."""
    plain = F.regexp_replace(F.regexp_replace(empty_if_null(text), "\r\n?", "\n"), "[​‌‍﻿]", "")
    fenced = F.regexp_replace(F.btrim(plain), r"^```[A-Za-z]*\s*\n?|\n?```$", "")
    return F.btrim(F.regexp_replace(fenced, r"^json\n", ""))


def reasoning_step(text: Column) -> Column:
    """What a reasoning answer decides: ``(kind, value)`` with kind answer, query or text."""
    answer = F.btrim(F.regexp_extract(text, r"(?is)so the answer is:\s*(.*)$", 1))
    query = F.btrim(F.regexp_extract(text, r"(?is)the new query is:\s*([^\n]*)", 1))
    return F.when(F.lower(text).contains("so the answer is:"), F.struct(F.lit("answer").alias("kind"), answer.alias("value"))).when(
        F.lower(text).contains("the new query is:"), F.struct(F.lit("query").alias("kind"), query.alias("value"))
    ).otherwise(F.struct(F.lit("text").alias("kind"), F.btrim(text).alias("value")))


def safe_file_id(value: Column) -> Column:
    return F.regexp_replace(empty_if_null(value), "[^A-Za-z0-9._-]+", "_")


def dataset_name(value: Column) -> Column:
    return F.regexp_replace(F.btrim(F.regexp_replace(empty_if_null(value), r"[^\p{L}\p{N} _-]", "")), " +", "_")


def community_name(value: Column) -> Column:
    """A proposed community name without prefix and quotes."""
    return F.btrim(F.regexp_replace(collapse_spaces(value), r"^\s*主题社区\s*[:：-]\s*", ""), F.lit(QUOTES + " "))


def is_community_name(name: Column, members: Column) -> Column:
    """Short, no list of alternatives, and not the name of a member."""
    return (name != "") & (F.length(name) <= 32) & ~name.contains(" / ") & ~name.contains("|") & (F.size(F.split(name, "/")) < 3) & ~F.array_contains(F.transform(members, F.lower), F.lower(name))


def fallback_community_name(concepts: Column, titles: Column) -> Column:
    """The first two concepts; without concepts a general name."""
    named = F.array_join(F.slice(concepts, 1, 2), " · ")
    return F.when(F.size(concepts) > 0, named).when(F.size(titles) > 0, "相关研究议题").otherwise("相关主题")


def duration_text(seconds: Column) -> Column:
    whole = F.floor(F.coalesce(seconds, F.lit(0.0))).cast("int")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600).cast("int"), F.floor(whole % 3600 / 60).cast("int"), whole % 60)


def citation(title: Column, authors: Column, source: Column, year: Column) -> Column:
    """A reference in the order authors, title, source, year; missing parts are left out."""
    parts = [F.array_join(F.slice(authors, 1, 3), ", "), title, source, year]
    return F.concat(F.array_join(F.filter(F.array(*[trim(empty_if_null(p)) for p in parts]), lambda p: p != ""), ". "), F.lit("."))


def node_text(node: Column, name: Column, description: Column) -> Column:
    """A node's text for retrieval: name and description, or its id where it has neither."""
    text = trim(F.concat(trim(empty_if_null(name)), F.lit(" "), trim(empty_if_null(description))))
    return F.when(text == "", F.concat(F.lit("[Node: "), node, F.lit("]"))).otherwise(text)


def indexed_text(name: Column, description: Column) -> Column:
    """A node's text for the index: name and description, ``none`` for a missing one."""
    part = lambda c: F.coalesce(F.nullif(trim(empty_if_null(c)), F.lit("")), F.lit("none"))
    return F.concat_ws(",", part(name), part(description))


def text_list(values: Column) -> Column:
    """The trimmed, non-empty texts of a list; none for a null."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: trim(empty_if_null(v))), lambda v: v != "")


def typed_entity(text: Column) -> Column:
    """``(name, type)`` of an entity rendered as ``name [schema_type: type, ...]``; the type is empty where none is shown."""
    pattern = r"^\s*(.*?)\s*\[schema_type:\s*([^,\]]*)[^\]]*\]\s*$"
    shown = text.rlike(pattern)
    return F.struct(F.when(shown, F.regexp_extract(text, pattern, 1)).otherwise(trim(text)).alias("name"), F.when(shown, trim(F.regexp_extract(text, pattern, 2))).otherwise("").alias("type"))


def cited(answer: Column) -> Column:
    """The numbers that an answer cites as ``[n]``, each once, in order of appearance."""
    return F.transform(F.array_distinct(F.regexp_extract_all(empty_if_null(answer), F.lit(r"\[(\d+)\]"), F.lit(1))), lambda n: n.cast("int"))


def renumbered(answer: Column) -> Column:
    """The answer with its citations numbered from 1 in order of appearance."""
    steps = F.transform(cited(answer), lambda n, i: F.struct(n.alias("old"), (i + 1).alias("new")))
    # marked first, so a new number is not taken for an old one
    marked = F.aggregate(steps, empty_if_null(answer), lambda text, s: F.replace(text, F.concat(F.lit("["), s["old"].cast("string"), F.lit("]")), F.concat(F.lit("\ue000"), s["new"].cast("string"), F.lit("\ue001"))))
    return F.translate(marked, "\ue000\ue001", "[]")
