"""Several values packed in one field: split into one row per value.

Two things are read from a field itself: a value in double quotes is one value (a
doubled inner quote stands for one), and a semicolon outside quotes splits the field,
after which no other mark does.  Everything else is a question of likelihood.  A field
without semicolons that holds other marks has several *readings*: a list split by one
kind of mark, for each kind that occurs (ASCII and full-width forms are one kind), or
a single value.  Within a reading, neighbouring pieces may be one value that holds
its mark (``A/B`` as one term), if that value stands by itself somewhere in the column.
All readings of a field make its lattice.

A segmentation model weighs them: how often a value occurs in the whole column, what
an unseen value of its length costs, and how often a kind of mark stands within a
value.  Frequencies start from the readings that are certain (semicolon lists, quoted
values, fields without marks); expectation maximisation adds what the lattices of all
other fields contribute and learns for every kind of mark how seldom it belongs to
values; the best path through a field's lattice gives its values.  Before anything
is learned, kinds that come first in ``MARKS`` are taken to split, as a newline
hardly belongs to a value and a slash often does.

With ``joined`` (lists of people) the word before the last name splits too.  Equal
fields share a lattice.  Lattices of plain readings are weighed by column
expressions; only those with joined pieces need a task's forward-backward pass.

Null and empty fields give no rows; an unclosed quote is an ordinary character;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import materialise

SPACES = " \t\n\r\x0b\x0c 　   ﻿"
SEMICOLONS = ";；"
#: Kinds of marks besides semicolons, in order of precedence.
MARKS = ("\n", "\t", "|｜", "、､", ",，", "/／", "　")
#: Words before the last name of a list.
JOINERS = r"(?:and|&|und|et|y|e|и|和|与|及|및|と)"

_WS = r"[\s 　]*+"
_ALL = SEMICOLONS + "".join(MARKS)
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
EM_ROUNDS = 2
#: The reading of a field as a single value, beside those by the kinds in ``MARKS``.
SINGLE = len(MARKS)
#: Cost of a character and of the end of a value that was never seen, and the share of such values.
_CHAR, _END, _UNSEEN = 3.9, 3.0, 0.1
#: A mark's share within values before anything is learned, and the weight of this belief in observed marks.
INSIDE, BELIEF = 0.02, 5.0


def _trim(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACES))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it; written out, it would be computed each time."""
    return F.transform(F.array(value), body)[0]


def _masked(raw: Column, joined: bool) -> Column:
    """The field with its quoted values replaced, so that marks inside them don't count."""
    ends = f"[{_ALL}]|$" + (rf"|\s{JOINERS}\s" if joined else "")
    starts = f"^|[{_ALL}]" + (rf"|(?<=\s){JOINERS}\s" if joined else "")
    return F.when(raw.contains('"'), F.regexp_replace(raw, f"({starts}){_WS}{_QUOTED}{_WS}(?={ends})", "$1\ue000")).otherwise(raw)


def _pieces(raw: Column, marks: str) -> Column:
    """Pieces between the marks with their spaces, quoted pieces whole."""
    k = f"[{marks}]"
    return F.regexp_extract_all(F.concat(F.lit(marks[0]), raw), F.lit(f"{k}({_WS}{_QUOTED}{_WS}(?={k}|$)|[^{marks}]*+)"), F.lit(1))


def _is_quoted(piece: Column) -> Column:
    return piece.contains('"') & _trim(piece).rlike(f"^{_QUOTED}$")  # most pieces need the first test only


def _unquote(piece: Column) -> Column:
    text = _trim(piece)
    return F.when(_is_quoted(piece), _trim(F.regexp_replace(text.substr(F.lit(2), F.length(text) - 2), '""', '"'))).otherwise(text)


def _split_last(pieces: Column) -> Column:
    """Split the last non-empty piece at a joining word; a leading one goes."""

    def split(kept: Column) -> Column:
        last = F.element_at(kept, -1)
        parts = F.when(
            last.rlike(rf"(?:^|\s){JOINERS}\s"),
            F.split(F.regexp_replace(last, rf'^\s*{JOINERS}\s+|\s+{JOINERS}\s+(?=(?:[^"]*"[^"]*")*[^"]*$)', "\ue001"), "\ue001"),
        ).otherwise(F.array(last))
        return F.when(F.size(kept) > 0, F.concat(F.slice(kept, 1, F.size(kept) - 1), parts)).otherwise(kept)

    return _let(F.filter(pieces, lambda p: _trim(p) != ""), split)


def read_fields(df: DataFrame, id_col: str, fields: dict[str, Column], joined: tuple[str, ...] = ("authors",)) -> DataFrame:
    """``(id, field, raw, pieces, readings)`` of every non-empty field.

    ``pieces`` are those of a semicolon list or of a field without marks; other fields
    have ``readings (kind, pieces)`` instead, one for each kind of mark they hold."""
    entries = F.array(*[F.struct(F.lit(name).alias("field"), col.cast("string").alias("raw")) for name, col in fields.items()])
    rows = df.select(F.col(id_col).alias("id"), F.explode(entries).alias("e")).select("id", "e.field", "e.raw").filter(F.col("raw").isNotNull() & (F.col("raw") != ""))
    raw, is_list, masked = F.col("raw"), F.col("field").isin(*joined), F.col("masked")
    rows = rows.withColumn("masked", _trim(F.when(is_list, _masked(raw, True)).otherwise(_masked(raw, False))))
    split = lambda pieces: F.when(is_list, _split_last(pieces)).otherwise(pieces)
    # only trimmed text is split by spaces that are marks themselves
    body = _trim(raw)
    found = [F.when(masked.rlike(f"[{marks}]"), F.struct(F.lit(i).alias("kind"), split(_pieces(body, marks)).alias("pieces"))) for i, marks in enumerate(MARKS)]
    semicolons = masked.rlike(f"[{SEMICOLONS}]")
    marked = ~semicolons & masked.rlike(f"[{''.join(MARKS)}]")
    rows = rows.withColumn("readings", F.when(marked, F.array_compact(F.array(*found))))
    pieces = F.when(semicolons, split(_pieces(raw, SEMICOLONS))).when(F.col("readings").isNull(), split(F.array(raw)))
    return rows.select("id", "field", "raw", pieces.alias("pieces"), "readings")


def _canonical_join(value: Column) -> Column:
    """A value with full-width marks and the spaces around marks folded, to compare joins."""
    folded = F.translate(value, "；，／｜､", ";,/|、")
    return F.regexp_replace(folded, rf"{_WS}([;,/|、\n\t]){_WS}", "$1")


def _weigh(spans: list, scores: dict[int, float]) -> dict:
    """Forward-backward and the best path over the readings of one field.

    A span is (kind, start, len, weight); ``scores`` holds what a reading costs besides its values."""
    chains: dict[int, list[int]] = {}
    for i, s in enumerate(spans):
        chains.setdefault(s["kind"], []).append(i)
    sums, posterior, best = {}, np.zeros(len(spans)), (-np.inf, 0, [])
    for kind in sorted(chains):
        own = chains[kind]
        n = max(spans[i]["start"] + spans[i]["len"] for i in own)
        ends: dict[int, list[int]] = {}
        for i in own:
            ends.setdefault(spans[i]["start"] + spans[i]["len"], []).append(i)
        fwd, top, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf), {}
        fwd[0] = top[0] = scores[kind]
        for e in range(1, n + 1):
            for i in ends.get(e, []):
                fwd[e] = np.logaddexp(fwd[e], fwd[spans[i]["start"]] + spans[i]["weight"])
                if (value := top[spans[i]["start"]] + spans[i]["weight"]) > top[e]:
                    top[e], back[e] = value, i
        bwd = np.full(n + 1, -np.inf)
        bwd[n] = 0.0
        for i in sorted(own, key=lambda i: -(spans[i]["start"] + spans[i]["len"])):
            bwd[spans[i]["start"]] = np.logaddexp(bwd[spans[i]["start"]], spans[i]["weight"] + bwd[spans[i]["start"] + spans[i]["len"]])
        for i in own:
            posterior[i] = fwd[spans[i]["start"]] + spans[i]["weight"] + bwd[spans[i]["start"] + spans[i]["len"]]
        sums[kind] = fwd[n]
        if top[n] > best[0]:
            path, e = [], n
            while e > 0:
                path.append(back[e])
                e = spans[back[e]]["start"]
            best = (top[n], kind, [{"start": spans[i]["start"], "len": spans[i]["len"]} for i in reversed(path)])
    total = np.logaddexp.reduce(list(sums.values()))
    return {"post": np.exp(posterior - total).tolist(), "share": [{"kind": k, "p": float(np.exp(v - total))} for k, v in sums.items()], "kind": best[1], "path": best[2]}


_SHARE = T.ArrayType(T.StructType().add("kind", "integer").add("p", "double"))
_WEIGHED = T.StructType().add("post", T.ArrayType(T.DoubleType())).add("share", _SHARE).add("kind", "integer").add("path", T.ArrayType(T.StructType().add("start", "integer").add("len", "integer")))


@F.pandas_udf(_WEIGHED)
def _weigh_joined(spans: pd.Series, scores: pd.Series) -> pd.DataFrame:
    rows = [_weigh(list(one), {s["kind"]: s["score"] for s in other}) for one, other in zip(spans, scores)]
    return pd.DataFrame(rows, columns=["post", "share", "kind", "path"])


def _weigh_plain(spans: Column, scores: Column) -> Column:
    """The same for readings without joined pieces: the values of each are given, so sums are enough."""
    sums = F.transform(scores, lambda c: F.struct(c["kind"].alias("kind"), F.aggregate(F.filter(spans, lambda s: s["kind"] == c["kind"]), c["score"], lambda t, s: t + s["weight"]).alias("sum")))

    def weighed(sums: Column, top: Column, share: Column) -> Column:
        best = F.array_min(F.transform(F.filter(sums, lambda c: c["sum"] == top), lambda c: c["kind"]))
        post = F.transform(spans, lambda s: F.filter(share, lambda c: c["kind"] == s["kind"])[0]["p"])
        return F.struct(post.alias("post"), share.alias("share"), best.alias("kind"), F.lit(None).cast("array<struct<start:int,len:int>>").alias("path"))

    def shared(sums: Column, top: Column) -> Column:
        total = F.aggregate(sums, F.lit(0.0), lambda t, c: t + F.exp(c["sum"] - top))
        share = _let(total, lambda t: F.transform(sums, lambda c: F.struct(c["kind"].alias("kind"), (F.exp(c["sum"] - top) / t).alias("p"))))
        return _let(share, lambda p: weighed(sums, top, p))

    return _let(sums, lambda v: _let(F.array_max(F.transform(v, lambda c: c["sum"])), lambda top: shared(v, top)))


def _joins(chains: DataFrame, certain: DataFrame) -> DataFrame:
    """Spans of several neighbouring pieces whose joined text is a certain value somewhere in the column."""
    inner = "[" + _ALL.replace("　", "") + "]"
    compounds = materialise(certain.filter(F.col("item").rlike(inner)).select("field", "item"))
    width = compounds.groupBy("field").agg(F.max(F.size(F.split("item", inner))).alias("width"))  # a row per field
    n, mark = F.size("pieces"), F.element_at(F.array(*[F.lit(m[0]) for m in MARKS]), F.col("kind") + 1)
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n - 2),
            lambda s: F.transform(
                F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.col("width"), n - s))),
                lambda w: F.struct(s.cast("int").alias("start"), w.cast("int").alias("len"), _canonical_join(F.call_function("array_join", F.transform(F.slice("pieces", s + 1, w), _trim), F.col("mark"))).alias("item")),
            ),
        )
    )
    spans = chains.filter((F.col("kind") < SINGLE) & (n >= 2)).join(F.broadcast(width), "field").withColumn("mark", mark).select(*_KEY, "kind", n.alias("n"), F.explode(pairs).alias("s"))
    return spans.filter(F.col("s.start") + F.col("s.len") <= F.col("n")).select(*_KEY, "kind", "s.*").join(compounds, ["field", "item"]).select(*_KEY, "kind", "start", "len", "item")


#: A field's text stands for itself by two hashes of together 96 bits.
_KEY = ("field", "h1", "h2")


def _keyed(fields: DataFrame) -> DataFrame:
    return fields.withColumns({"h1": F.xxhash64("raw"), "h2": F.hash("raw")})


def _scored(spans: DataFrame, inside: DataFrame, plain: bool) -> DataFrame:
    """Lattices ``(field, h1, h2, n, marks, spans, w)`` of ``spans`` with the count ``f`` of their values elsewhere; ``w`` is their weighing."""
    unseen = F.exp(-_CHAR * F.length("item") - _END)
    weight = F.when(F.col("item") == "", 0.0).otherwise(F.log((1 - _UNSEEN) * F.col("f") / F.col("total") + _UNSEEN * unseen + 1e-300))
    # a joined value holds the mark of its own reading
    weight = weight + F.when(F.col("len") > 1, (F.col("len") - 1) * F.log(F.get("rho", F.col("kind")))).otherwise(0.0)
    rated = spans.join(F.broadcast(inside), "field").select(*_KEY, "n", "marks", F.struct("kind", "start", "len", "item", "c", weight.alias("weight")).alias("s"))
    rows = rated.groupBy(*_KEY).agg(F.max("n").alias("n"), F.max("marks").alias("marks"), F.collect_list("s").alias("spans")).join(F.broadcast(inside), "field")
    # a reading leaves the marks of the kinds before its own within values
    left = lambda k: F.aggregate(F.filter("marks", lambda m: m["kind"] < k), F.lit(0.0), lambda t, m: t + m["n"] * F.log(F.get("rho", m["kind"])))
    own = lambda k: F.aggregate(F.filter("marks", lambda m: m["kind"] == k), F.lit(0.0), lambda t, m: t + m["n"] * F.log(1 - F.get("rho", m["kind"])))
    scores = F.transform(F.array_distinct(F.col("spans.kind")), lambda k: F.struct(k.alias("kind"), (left(k) + own(k)).alias("score")))
    rows = rows.select(*_KEY, "n", "marks", "spans", scores.alias("scores"))
    if plain:
        return rows.withColumn("w", _weigh_plain(F.col("spans"), F.col("scores")))
    rows = materialise(rows)  # two branches read it
    joined = F.exists("spans", lambda s: s["len"] > 1)
    return rows.filter(~joined).withColumn("w", _weigh_plain(F.col("spans"), F.col("scores"))).unionByName(rows.filter(joined).withColumn("w", _weigh_joined("spans", "scores")))


def segment(fields: DataFrame) -> DataFrame:
    """``(field, h1, h2, kind, path)``: the best reading of every field of ``read_fields`` that has readings, by the hashes of its text.

    ``path`` tells which of its pieces belong together, null where none do."""
    value = lambda p: _canonical_join(_unquote(p))
    sure = fields.select("field", F.explode(F.coalesce("pieces", F.filter(F.flatten(F.col("readings.pieces")), _is_quoted))).alias("p")).groupBy("field", "p").agg(F.count("*").alias("n"))
    certain = materialise(sure.select("field", value(F.col("p")).alias("item"), "n").filter("item <> ''").groupBy("field", "item").agg(F.sum("n").cast("double").alias("c")))
    totals = materialise(certain.groupBy("field").agg((F.sum("c") + 1).alias("total")))  # a row per field
    lattices = _keyed(fields.filter("readings IS NOT NULL").select("field", "raw", "readings")).groupBy(*_KEY).agg(F.count("*").alias("n"), F.any_value("raw").alias("raw"), F.any_value("readings").alias("readings"))
    lattices = materialise(lattices.withColumn("marks", F.transform("readings", lambda r: F.struct(r["kind"].alias("kind"), (F.size(r["pieces"]) - 1).alias("n")))))
    chains = lattices.select(*_KEY, F.explode(F.concat("readings", F.array(F.struct(F.lit(SINGLE).alias("kind"), F.array("raw").alias("pieces"))))).alias("r"), "n", "marks").select(*_KEY, "r.*", "n", "marks")
    singles = chains.select(*_KEY, "kind", F.posexplode("pieces").alias("start", "p"), "n", "marks")
    # what concerns the whole lattice goes with the span of the single value only
    once = lambda c: F.when(F.col("kind") == SINGLE, F.col(c)).alias(c)
    singles = singles.select(*_KEY, "kind", "start", F.lit(1).alias("len"), value(F.col("p")).alias("item"), once("n"), once("marks"))
    joins = materialise(_joins(chains, certain))
    plain = not joins.head(1)
    spans = singles if plain else singles.unionByName(joins, allowMissingColumns=True)
    spans = spans.join(certain, ["field", "item"], "left").join(F.broadcast(totals), "field", "left").withColumns({"c": F.coalesce("c", F.lit(0.0)), "total": F.coalesce("total", F.lit(1.0))})
    inside = lattices.select("field").distinct().withColumn("rho", F.array(*[F.lit(INSIDE)] * len(MARKS)))
    scored = _scored(spans.withColumn("f", F.col("c")), inside, plain)
    for _ in range(EM_ROUNDS):
        rows = materialise(scored.select(*_KEY, "n", "marks", "spans", "w.post", "w.share"))
        within = F.transform("marks", lambda m: F.struct(
            m["kind"].alias("kind"), m["n"].alias("n"),
            F.aggregate(F.filter("share", lambda c: c["kind"] > m["kind"]), F.lit(0.0), lambda t, c: t + c["p"]).alias("p"), F.aggregate(F.filter("share", lambda c: c["kind"] >= m["kind"]), F.lit(0.0), lambda t, c: t + c["p"]).alias("q"),
        ))
        seen = rows.select("field", "n", F.explode(within).alias("m")).groupBy("field", "m.kind").agg(F.sum(F.col("n") * F.col("m.n") * F.col("m.p")).alias("inside"), F.sum(F.col("n") * F.col("m.n") * F.col("m.q")).alias("all"))
        rho = seen.select("field", F.struct("kind", ((F.col("inside") + INSIDE * BELIEF) / (F.col("all") + BELIEF)).alias("rho")).alias("r")).groupBy("field").agg(F.map_from_entries(F.collect_list("r")).alias("by_kind"))
        inside = materialise(rho.select("field", F.array(*[F.coalesce(F.try_element_at("by_kind", F.lit(k)), F.lit(INSIDE)) for k in range(len(MARKS))]).alias("rho")))
        # what a lattice itself adds to a value says nothing about it
        spans = rows.select(*_KEY, "n", "marks", F.explode(F.arrays_zip("spans", "post")).alias("e")).select(*_KEY, "e.spans.*", (F.col("n") * F.col("e.post")).alias("own"), "n", "marks")
        spans = spans.select(*_KEY, "kind", "start", "len", "item", "c", "own", once("n"), once("marks"))
        gained = spans.filter("own > 1e-6").groupBy("field", "item").agg(F.sum("own").alias("gain"))
        spans = spans.join(gained, ["field", "item"], "left").join(F.broadcast(totals), "field", "left").withColumns({"f": F.col("c") + F.greatest(F.coalesce("gain", F.lit(0.0)) - F.col("own"), F.lit(0.0)), "total": F.coalesce("total", F.lit(1.0))})
        scored = _scored(spans, inside, plain)
    return materialise(scored.select(*_KEY, "w.kind", "w.path"))


def packed_arrays(df: DataFrame, id_col: str, fields: dict[str, Column], joined: tuple[str, ...] = ("authors",)) -> DataFrame:
    """``(id, field, items)``: the values of every non-empty field in order."""
    # read once: the lattices and the result go over the pieces several times
    parsed = materialise(read_fields(df, id_col, fields, joined))
    mark = F.element_at(F.array(*[F.lit({",，": ", "}.get(m, m[0])) for m in MARKS]), F.col("kind") + 1)
    certain = parsed.filter("readings IS NULL").select("id", "field", "pieces")
    read = _keyed(parsed.filter("readings IS NOT NULL").select("id", "field", "raw", "readings")).join(segment(parsed), list(_KEY))
    own = F.coalesce(F.get(F.filter("readings", lambda r: r["kind"] == F.col("kind")), F.lit(0))["pieces"], F.array("raw"))
    together = F.transform("path", lambda s: F.call_function("array_join", F.slice("own", s["start"] + 1, s["len"]), F.col("mark")))
    chosen = read.withColumn("own", own).withColumn("mark", F.when(F.col("kind") < SINGLE, mark)).select("id", "field", F.when(F.col("path").isNotNull() & (F.col("kind") < SINGLE), together).otherwise(F.col("own")).alias("pieces"))
    return certain.unionByName(chosen).select("id", "field", F.filter(F.transform("pieces", _unquote), lambda v: v != "").alias("items"))


def packed_items(df: DataFrame, id_col: str, fields: dict[str, Column], joined: tuple[str, ...] = ("authors",)) -> DataFrame:
    """``(id, field, pos, item, n_items)``: one row per value of every field, ``pos`` from 1."""
    rows = packed_arrays(df, id_col, fields, joined)
    # each value knows their number and the explode is outer, else Spark's filters on the array would compute it again below
    values = _let(F.col("items"), lambda v: F.transform(v, lambda x, i: F.struct((i + 1).cast("int").alias("pos"), x.alias("item"), F.size(v).alias("n_items"))))
    return rows.select("id", "field", F.explode_outer(values).alias("v")).filter("v IS NOT NULL").select("id", "field", "v.pos", "v.item", "v.n_items")
