"""Spellings of names that denote the same person or organisation.

A spelling is read as a rare *core* (surname; place or proper name of an
organisation) and a common *rest* (given name or initials; kind and department of
the organisation).  Similar cores and given names are found by a set-similarity
self-join on positional q-grams with prefix filtering: a token's q-grams are
ordered by rarity and only as many of the rarest are joined as one edit can
destroy, plus one, so no pair within one edit is missed.  Links between readings
are verified by a soft token similarity whose weights are inverse document
frequencies, so the rare core counts more than the rest.

Short forms of given names come from a table, and, as such tables are incomplete,
from the column itself: a token that almost always stands beside the same full
given name under the same surname is a short form of it.  Initials and
abbreviations are linked when exactly one entity of their surname fits.

Defined results: null and blank names are dropped; names that fit two entities are
linked to neither; repeated names count once; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.selection import STRETCH, pairs_within
from corpusloom.operators.graph import components
from corpusloom.session import materialise

#: Least weighted similarity of two readings that are linked.
MIN_SIMILARITY = 0.8
#: A token beside at least so many others is a given name rather than a surname.
MIN_PARTNERS = 8
#: A short form shares at least so many of its surnames, and this share of them, with its full form, so many standard deviations above chance.
ALIAS_SUPPORT, ALIAS_SHARE, ALIAS_DEVIATIONS = 4, 0.5, 4.0
_MIN_TYPO = 5
#: Similarity of two names of three or more ideographs that differ in one.
HAN_TYPO = 0.85

# Words of organisation names in their short and full forms.
ORG_WORDS = {
    "university": ["university", "univ", "u", "uni"],
    "institute": ["institute", "inst"],
    "technology": ["technology", "tech", "technol"],
    "academy": ["academy", "acad"],
    "national": ["national", "nat", "natl"],
    "college": ["college", "coll", "col"],
    "teachers": ["teachers", "teacher", "teachers'", "teach"],
    "school": ["school", "sch"],
    "department": ["department", "dept", "dep"],
    "faculty": ["faculty", "fac"],
    "center": ["center", "centre", "ctr", "cent"],
    "laboratory": ["laboratory", "lab"],
    "science": ["science", "sciences", "sci"],
    "education": ["education", "educ", "edu"],
    "research": ["research", "res"],
    "state": ["state"], "normal": ["normal"], "polytechnic": ["polytechnic", "polytech"], "international": ["international", "int", "intl"],
}
ORG_ACRONYMS = {"it": ["institute", "technology"], "tc": ["teachers", "college"], "na": ["national", "academy"], "tu": ["technology", "university"], "nu": ["national", "university"]}
ORG_STOP = {"of", "the", "and", "for", "at", "in", "de", "la", "&"}
# Kinds of Chinese institutions, longest first, with their short forms.
HAN_KINDS = {
    "职业技术学院": ["职业技术学院", "职技学院", "职院"], "广播电视大学": ["广播电视大学", "电大"], "综合大学": ["综合大学"], "开放大学": ["开放大学"],
    "工商学院": ["工商学院"], "师范大学": ["师范大学", "师大"], "理工大学": ["理工大学", "理工"], "农业大学": ["农业大学", "农大"], "医科大学": ["医科大学", "医大"],
    "科技大学": ["科技大学", "科大"], "工业大学": ["工业大学", "工大"], "财经大学": ["财经大学", "财大"], "师范学院": ["师范学院", "师院"], "大学": ["大学"],
}
# Traditional characters of institution words.
_TRADITIONAL = str.maketrans("學國業師範農職術電與動廣視綜開機語計馬義職備導經財醫東華", "学国业师范农职术电与动广视综开机语计马义职备导经财医东华")
_HAN = re.compile(r"[㐀-鿿]")
_SUFFIX = re.compile("^(.+?)(" + "|".join(sorted((s for v in HAN_KINDS.values() for s in v), key=len, reverse=True)) + "|大(?=.+[学系部院所]$))(.*)$")
_KIND_OF = {s: k for k, v in HAN_KINDS.items() for s in v} | {"大": "大学"}
_WORD_OF = {s: k for k, v in ORG_WORDS.items() for s in v}
_FULL_WORDS = sorted(ORG_WORDS)


def _osa1(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours leads from a to b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def read_person(name: str) -> dict:
    """Words, initials, abbreviations of a person's name, and the surname where its form shows it."""
    text = unicodedata.normalize("NFKC", name).strip()
    if _HAN.search(text) and not re.search("[A-Za-z]", text):
        return {"script": "h", "words": [re.sub(r"\s+", "", text).casefold()], "initials": [], "abbr": None, "surname": None}
    before, comma, _ = text.partition(",")
    words, initials, abbr, surname = [], [], None, None
    raw = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?", text)
    upper = [t for t in raw if len(t) > 2 and t.isupper()]
    for token in raw:
        bare = token.rstrip(".").casefold()
        if len(bare) == 1:
            initials.append(bare)
        elif token.endswith("."):
            abbr = bare
        else:
            words.append(bare)
    if comma:
        parts = [t.casefold() for t in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", before) if len(t) > 1]
        surname = parts[-1] if parts else None
    elif len(upper) == 1 and len(words) > 1:
        surname = upper[0].casefold()
    return {"script": "l", "words": words, "initials": initials, "abbr": abbr, "surname": surname if surname in words else None}


def _org_word(word: str) -> str | None:
    if word in _WORD_OF:
        return _WORD_OF[word]
    if len(word) >= 5:
        for full in _FULL_WORDS:
            if _osa1(word, full):
                return full
    return None


def read_organisation(name: str) -> dict:
    """Core, kind and department of an organisation's name."""
    text = unicodedata.normalize("NFKC", name).strip().translate(_TRADITIONAL)
    if _HAN.search(text):
        flat = re.sub(r"\s+", "", text)
        inner = re.match(r"^(.+?)[(（](.+)[)）]$", flat)
        sides = [inner[1], inner[2]] if inner else flat.split("/") if flat.count("/") == 1 else None
        if sides:
            a, b = sides
            flat = b + a if _SUFFIX.match(b) and not (_SUFFIX.match(a) and not _SUFFIX.match(b)) else a + b
        if found := _SUFFIX.match(flat):
            return {"script": "h", "core": found[1], "kind": _KIND_OF[found[2]], "dept": found[3]}
        return {"script": "h", "core": flat, "kind": "", "dept": ""}
    words = [w.replace("’", "").replace("'", "") for w in re.findall(r"[^\W_]+(?:['’][^\W_]*)*", text.casefold())]
    kinds, core = [], []
    for w in words:
        if w in ORG_STOP or not w:
            continue
        if w in ORG_ACRONYMS and len(words) > 1:
            kinds += ORG_ACRONYMS[w]
        elif (full := _org_word(w)) is not None:
            kinds.append(full)
        else:
            core.append(w)
    return {"script": "l", "core": " ".join(sorted(core)), "kind": " ".join(sorted(set(kinds))), "dept": ""}


_READ = "kind string, name string, n bigint, script string, words array<string>, initials array<string>, abbr string, surname string, core string, rest string, dept string"


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _READ.split(", ")]
    for frame in frames:
        rows = []
        for kind, name, n in zip(frame["kind"], frame["name"], frame["n"]):
            if kind == "author":
                p = read_person(name)
                rows.append((kind, name, n, p["script"], p["words"], p["initials"], p["abbr"], p["surname"], None, None, None))
            else:
                o = read_organisation(name)
                rows.append((kind, name, n, o["script"], [], [], None, None, o["core"], o["kind"], o["dept"]))
        yield pd.DataFrame(rows, columns=columns)


def similar_tokens(tokens: DataFrame) -> DataFrame:
    """``(kind, a, b)``, both ways: tokens one edit apart, of ``(kind, token)``.

    Positional trigrams of the padded token (single characters of ideographs); one
    edit touches at most four of the former and one of the latter, so five and two
    of the rarest are joined."""
    han = F.col("token").rlike("[㐀-鿿]")
    padded = F.concat(F.lit("^"), F.col("token"), F.lit("$"))
    grams = F.when(
        han, F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.struct(F.col("token").substr(i, F.lit(1)).alias("gram"), i.alias("at")))
    ).otherwise(F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.struct(padded.substr(i, F.lit(3)).alias("gram"), i.alias("at"))))
    usable = tokens.filter(F.when(han, F.length("token") >= 3).otherwise(F.length("token") >= _MIN_TYPO))
    exploded = usable.select("kind", "token", han.alias("han"), F.explode(grams).alias("g")).select("kind", "token", "han", "g.gram", "g.at")
    counts = exploded.groupBy("kind", "gram").agg(F.count("*").alias("df"))
    rarity = Window.partitionBy("kind", "token").orderBy("df", "gram", "at")
    prefix = exploded.join(counts, ["kind", "gram"]).withColumn("r", F.row_number().over(rarity)).filter(F.col("r") <= F.when(F.col("han"), 2).otherwise(5))
    left = prefix.select("kind", "gram", F.col("token").alias("a"), F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)).alias("at"))
    right = prefix.select("kind", "gram", F.col("token").alias("b"), "at")
    pairs = left.join(right, ["kind", "gram", "at"]).filter((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1)).select("kind", "a", "b").distinct()
    differing = F.filter(F.sequence(F.lit(1), F.length("a")), lambda i: F.col("a").substr(i, F.lit(1)) != F.col("b").substr(i, F.lit(1)))
    swapped = (F.length("a") == F.length("b")) & (F.size(differing) == 2) & (differing[1] - differing[0] == 1) & (F.sort_array(F.split("a", "")) == F.sort_array(F.split("b", "")))
    near = pairs.filter((F.levenshtein("a", "b", 1) >= 0) | swapped)
    near = materialise(near)
    return near.unionByName(near.select("kind", F.col("b").alias("a"), F.col("a").alias("b")))


def _roles(read: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Readings ``(kind, name, n, core, rest, given?, ...)`` with surname and given name told apart."""
    people = read.filter("kind = 'author'")
    two = people.filter((F.size("words") == 2) & F.col("abbr").isNull()).select("name", F.explode("words").alias("token"), "words")
    partners = two.select("token", F.when(F.col("token") == F.col("words")[0], F.col("words")[1]).otherwise(F.col("words")[0]).alias("other")).distinct().groupBy("token").agg(F.count("*").alias("deg"))
    degrees = materialise(partners)
    cores = read.filter("kind = 'organ'").select("kind", F.col("core").alias("token"))
    tokens = people.select("kind", F.explode("words").alias("token")).unionByName(cores).filter("token <> ''").distinct()
    similar = similar_tokens(tokens)
    shorts = aliases.select(F.lower("short_form").alias("token")).unionByName(aliases.select(F.lower("full_form").alias("token"))).distinct()
    known = degrees.filter(F.col("deg") >= MIN_PARTNERS).select("token").unionByName(shorts).distinct()
    near_known = similar.filter("kind = 'author'").join(known.withColumnRenamed("token", "b"), "b").select(F.col("a").alias("token")).distinct()
    facts = (
        tokens.filter("kind = 'author'").select("token").join(degrees, "token", "left")
        .join(known.withColumn("known", F.lit(True)), "token", "left").join(near_known.withColumn("near", F.lit(True)), "token", "left")
        .select("token", F.struct(F.when(F.col("known"), 2).when(F.col("near"), 1).otherwise(0).alias("grade"), F.coalesce("deg", F.lit(0)).alias("deg")).alias("fact"))
    )
    words = people.filter(F.size("words") > 1).select("name", "surname", F.posexplode("words").alias("pos", "token")).join(facts, "token")
    # the surname: shown by the form, else the least like a given name, else the last
    order = F.struct(F.when(F.col("token") == F.col("surname"), 0).otherwise(1), F.col("fact.grade"), F.when(F.col("fact.grade") == 2, F.col("fact.deg")).otherwise(0), -F.col("pos"))
    chosen = words.groupBy("name").agg(F.min_by("token", order).alias("core"))
    told = (
        people.drop("core", "rest").join(chosen, "name", "left")
        .withColumn("core", F.coalesce("core", F.col("words")[0], F.col("abbr")))
        .withColumn("rest", F.array_join(F.array_except("words", F.array("core")), " "))
    )
    told = told.select("kind", "name", "n", "script", "core", F.when(F.col("rest") != "", F.col("rest")).alias("rest"), "initials", "abbr", F.lit("").alias("dept"))
    organs = read.filter("kind = 'organ'").select("kind", "name", "n", "script", "core", "rest", "initials", "abbr", "dept")
    return told.unionByName(organs).filter(F.coalesce(F.col("core"), F.lit("")) != ""), similar, degrees


def _learned_aliases(keys: DataFrame, typos: DataFrame) -> DataFrame:
    """``(short_form, full_form)``: a token that stands beside the same full given name under most of its surnames.

    Misspelt names are no short forms; a token is short for one name only, the one it shares most surnames with."""
    given = keys.filter("kind = 'author' AND script = 'l'").select("core", F.col("rest").alias("g")).distinct().join(typos.select(F.col("rest").alias("g")).distinct(), "g", "left_anti")
    under = given.groupBy("g").agg(F.count("*").alias("cores")).filter(F.col("cores") >= ALIAS_SUPPORT)
    frequent = given.join(under, "g")
    # a surname with many given names is compared in stretches, by several tasks
    sizes = frequent.groupBy("core").agg(F.ceil(F.count("*") / STRETCH).alias("stretches"))
    frequent = materialise(frequent.join(sizes, "core"))
    short = frequent.select("core", F.col("g").alias("short"), F.col("cores").alias("n_short"), F.pmod(F.xxhash64("g"), F.col("stretches")).alias("stretch"))
    full = frequent.select("core", F.col("g").alias("full"), F.col("cores").alias("n_full"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("stretches") - 1)).alias("stretch"))
    both = short.join(full, ["core", "stretch"]).filter("n_full > n_short").groupBy("short", "full", "n_short", "n_full").agg(F.count("*").alias("both"))
    total = given.select("core").distinct().agg(F.count("*").alias("all_cores"))
    chance = F.col("n_full") / F.col("all_cores")
    deviations = (F.col("both") - F.col("n_short") * chance) / F.sqrt(F.col("n_short") * chance * (1 - chance) + 1e-9)
    scored = both.join(F.broadcast(total)).filter((F.col("both") >= ALIAS_SUPPORT) & (F.col("both") >= ALIAS_SHARE * F.col("n_short")) & (deviations >= ALIAS_DEVIATIONS))
    return scored.groupBy(F.col("short").alias("short_form")).agg(F.max_by("full", F.struct("both", "full")).alias("full_form"))


def _weighted(core_match: Column, rest_match: Column, core_df: Column, rest_df: Column, total: Column) -> Column:
    wc, wr = F.log(1 + total / core_df), F.log(1 + total / rest_df)
    return (wc * core_match + wr * rest_match) / (wc + wr)


def _given_typos(similar: DataFrame, degrees: DataFrame) -> DataFrame:
    """``(kind, rest, to_rest, rest_match)``: tokens one edit from a much more frequent given name."""
    frequent = degrees.filter(F.col("deg") >= MIN_PARTNERS).select(F.col("token").alias("b"), F.col("deg").alias("b_deg"))
    rarer = degrees.select(F.col("token").alias("a"), F.col("deg").alias("a_deg"))
    near = similar.filter("kind = 'author'").join(frequent, "b").join(rarer, "a", "left").filter(F.col("b_deg") > 3 * F.coalesce("a_deg", F.lit(0)))
    return near.select("kind", F.col("a").alias("rest"), F.col("b").alias("to_rest"), (1 - 1 / F.length("a")).alias("rest_match"))


def _typos_under_surname(similar: DataFrame, keys: DataFrame) -> DataFrame:
    """``(kind, rest, to_rest, rest_match)``: given names one edit from another that is over three times as frequent under
    the same surnames, which hold most of the rarer one's occurrences.  All is relative, so the size of the table does not count."""
    given = keys.filter("kind = 'author' AND script = 'l' AND rest <> ''").groupBy("core", "rest").agg(F.sum("n").alias("n"))
    totals = given.groupBy("rest").agg(F.sum("n").alias("all_n"))
    left = given.select("core", F.col("rest").alias("a"), F.col("n").alias("a_n"))
    right = given.select("core", F.col("rest").alias("b"), F.col("n").alias("b_n"))
    pairs = similar.filter("kind = 'author'").select("a", "b").join(left, "a").join(right, ["core", "b"]).groupBy("a", "b").agg(F.sum("a_n").alias("a_n"), F.sum("b_n").alias("b_n"))
    rare = pairs.filter("b_n > 3 * a_n").join(totals.select(F.col("rest").alias("a"), "all_n"), "a").filter("2 * a_n > all_n")
    return rare.select(F.lit("author").alias("kind"), F.col("a").alias("rest"), F.col("b").alias("to_rest"), (1 - 1 / F.length("a")).alias("rest_match"))


def _links(keys: DataFrame, similar: DataFrame, aliases: DataFrame, typos: DataFrame) -> DataFrame:
    """``(kind, core, rest, dept, to_core, to_rest, to_dept)``: each reading's best more canonical reading."""
    id_cols = ["kind", "core", "rest", "dept"]
    core_df = keys.groupBy("kind", "core").agg(F.count("*").alias("core_df"))
    rest_df = keys.groupBy("kind", "rest").agg(F.count("*").alias("rest_df"))
    total = F.broadcast(keys.groupBy("kind").agg(F.count("*").alias("total")))  # a row per kind
    rated = keys.join(core_df, ["kind", "core"]).join(rest_df, ["kind", "rest"]).join(total, "kind")
    rated = materialise(rated)
    cores = similar.select("kind", F.col("a").alias("core"), F.col("b").alias("to_core"), F.when(F.col("a").rlike("[㐀-鿿]"), HAN_TYPO).otherwise(1 - 1 / F.length("a")).alias("core_match"))
    own_core = rated.select(*id_cols, "n", "core_df", "rest_df", "total", F.col("core").alias("to_core"), F.lit(1.0).alias("core_match"))
    near_core = rated.join(cores, ["kind", "core"]).select(*id_cols, "n", "core_df", "rest_df", "total", "to_core", "core_match")
    both = own_core.unionByName(near_core)
    # given names: a short form's full forms, and the known name one edit away
    nick = aliases.select(F.lit("author").alias("kind"), F.col("short_form").alias("rest"), F.col("full_form").alias("to_rest"), F.lit(0.9).alias("rest_match"))
    rests = typos.unionByName(nick)
    own_rest = both.withColumn("to_rest", F.col("rest")).withColumn("rest_match", F.lit(1.0))
    near_rest = both.join(rests, ["kind", "rest"]).select(*own_rest.columns)
    candidates = own_rest.unionByName(near_rest).filter((F.col("core") != F.col("to_core")) | (F.col("rest") != F.col("to_rest")))
    targets = rated.select("kind", F.col("core").alias("to_core"), F.col("rest").alias("to_rest"), F.col("dept").alias("to_dept"), F.col("n").alias("to_n"))
    met = candidates.join(targets, ["kind", "to_core", "to_rest"]).filter(F.col("dept") == F.col("to_dept"))
    # short departments of the same institution: a subsequence with the same first and last character
    shorter = F.col("s.dept").substr(1, 1) == F.col("l.dept").substr(1, 1)
    skeleton = F.concat(F.lit("^"), F.array_join(F.transform(F.split("s.dept", ""), lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), ".*"), F.lit("$"))
    depts = rated.filter("kind = 'organ' AND dept <> ''")
    abbreviated = (
        depts.alias("s").join(depts.alias("l"), (F.col("s.core") == F.col("l.core")) & (F.col("s.rest") == F.col("l.rest")) & shorter & (F.length("s.dept") < F.length("l.dept")))
        .filter(F.rlike(F.col("l.dept"), skeleton))
        .select(*[F.col(f"s.{c}") for c in id_cols], F.col("s.n").alias("n"), F.col("s.core_df").alias("core_df"), F.col("s.rest_df").alias("rest_df"), F.col("s.total").alias("total"),
                F.col("l.core").alias("to_core"), F.lit(1.0).alias("core_match"), F.col("l.rest").alias("to_rest"), F.lit(0.9).alias("rest_match"), F.col("l.dept").alias("to_dept"), F.col("l.n").alias("to_n"))
    )
    scored = met.select(*id_cols, "n", "core_df", "rest_df", "total", "to_core", "core_match", "to_rest", "rest_match", "to_dept", "to_n").unionByName(abbreviated)
    score = _weighted(F.col("core_match"), F.col("rest_match"), F.col("core_df"), F.col("rest_df"), F.col("total"))
    heavier = F.struct(F.col("to_n"), F.col("to_core"), F.col("to_rest")) > F.struct(F.col("n"), F.col("core"), F.col("rest"))
    directed = (F.col("rest") != F.col("to_rest")) | (F.col("dept") != F.col("to_dept")) | heavier
    good = scored.withColumn("score", score).filter(directed & (F.col("score") >= MIN_SIMILARITY))
    best = F.max(F.struct("score", "to_n", "to_core", "to_rest", "to_dept")).alias("best")
    # a short form that fits two full forms equally stays apart
    fits = F.count_distinct(F.when((F.col("core") == F.col("to_core")) & (F.col("rest_match") == 0.9), F.struct("to_rest", "to_dept"))).alias("fits")
    return good.groupBy(*id_cols).agg(best, fits).filter("fits <= 1").select(*id_cols, "best.to_core", "best.to_rest", "best.to_dept")


def _key(core: str, rest: str, dept: str) -> Column:
    return F.concat_ws("\x1f", core, rest, dept)


def name_variants(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(kind, name, entity)`` of ``(kind, name, n)``, with ``(short_form, full_form)`` of given names.

    Names that share ``entity`` denote the same; names with none are left out."""
    read = materialise(names.filter(F.trim("name") != "").select("kind", "name", "n").mapInPandas(_read, _READ))
    told, similar, degrees = _roles(read, aliases)
    told = materialise(told)
    full = told.filter("rest IS NOT NULL OR script = 'h'").withColumn("rest", F.coalesce("rest", F.lit("")))
    keys = materialise(full.groupBy("kind", "script", "core", "rest", "dept").agg(F.sum("n").alias("n")))
    given_table = aliases.select(F.lower("short_form").alias("short_form"), F.lower("full_form").alias("full_form"))
    typos = materialise(_given_typos(similar, degrees).unionByName(_typos_under_surname(similar, keys)).distinct())
    alias_table = materialise(given_table.unionByName(_learned_aliases(keys, typos)).distinct())
    links = materialise(_links(keys.drop("script"), similar, alias_table, typos).select("kind", _key("core", "rest", "dept").alias("key"), _key("to_core", "to_rest", "to_dept").alias("to")))
    # chains of links of any length: readings that are connected denote the same
    node = lambda key: F.concat_ws("\x1e", "kind", key)
    connected = components(links.select(node("key").alias("src"), node("to").alias("dst"))).withColumnRenamed("node_id", "node")
    label = keys.select("kind", _key("core", "rest", "dept").alias("key")).withColumn("node", node("key")).join(connected, "node", "left").select("kind", "key", F.coalesce("component", "node").alias("to"))
    label = materialise(label)
    whole = full.select("kind", "name", _key("core", "rest", "dept").alias("key"), "core", "rest", "initials").join(label, ["kind", "key"]).withColumnRenamed("to", "entity")
    whole = materialise(whole)
    # initials and abbreviations
    people = whole.filter("kind = 'author'")
    middles = people.filter(F.size("initials") > 0).groupBy("entity").agg(F.min(F.col("initials")[0]).alias("middle"))
    forms = people.filter("rest <> ''").select("entity", "core", F.col("rest").alias("g")).distinct()
    fuller = alias_table.select(F.col("short_form").alias("g"), F.col("full_form").alias("to")).unionByName(typos.select(F.col("rest").alias("g"), F.col("to_rest").alias("to")))
    forms = forms.unionByName(forms.join(fuller, "g").select("entity", "core", F.col("to").alias("g"))).distinct().join(middles, "entity", "left")
    partial = told.filter("kind = 'author' AND script = 'l' AND rest IS NULL AND (abbr IS NOT NULL OR size(initials) > 0)").select(
        "name", "core", F.coalesce("abbr", F.col("initials")[0]).alias("start"),
        F.when(F.col("abbr").isNotNull(), F.get("initials", F.lit(0))).otherwise(F.get("initials", F.lit(1))).alias("mid"),
    )
    near = similar.filter("kind = 'author'").select(F.col("a").alias("core"), F.col("b").alias("at"))
    places = partial.withColumn("at", F.col("core")).withColumn("far", F.lit(0)).unionByName(partial.join(near, "core").withColumn("far", F.lit(1)).select("name", "core", "start", "mid", "at", "far"))
    options = (
        places.withColumn("letter", F.col("start").substr(1, 1))
        .join(forms.withColumnRenamed("core", "at").withColumn("letter", F.col("g").substr(1, 1)), ["at", "letter"]).filter(F.col("g").startswith(F.col("start")))
        .filter(F.col("mid").isNull() | F.col("middle").isNull() | (F.col("mid") == F.col("middle")))
        .groupBy("name", "entity").agg(F.min("far").alias("far"), F.max(F.coalesce(F.col("mid") == F.col("middle"), F.lit(False))).alias("sure"))
    )
    rank = F.struct("far", F.when(F.col("sure"), 0).otherwise(1))
    nearest = options.withColumn("best", F.min(rank).over(Window.partitionBy("name"))).filter(rank == F.col("best")).groupBy("name").agg(F.count("*").alias("k"), F.min("entity").alias("entity"))
    resolved = nearest.filter("k = 1").select("name", "entity")
    alone = partial.join(nearest.select("name"), "name", "left_anti").select("name", F.concat_ws("\x1f", F.lit("~"), "core", F.col("start").substr(1, 1)).alias("entity"))
    ended = whole.select("kind", "name", "entity").unionByName(resolved.unionByName(alone).select(F.lit("author").alias("kind"), "name", "entity"))
    return ended


def variant_pairs(entities: DataFrame) -> DataFrame:
    """All pairs of spellings of one entity, ``name_a < name_b``."""
    sized = entities.join(entities.groupBy("kind", "entity").agg(F.count("*").alias("n")).filter("n > 1"), ["kind", "entity"])
    return pairs_within(sized, ["kind", "entity"], "name").select("kind", "name_a", "name_b")
