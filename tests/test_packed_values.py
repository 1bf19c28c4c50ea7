import re

from pyspark.sql import functions as F

from corpusloom.operators.packed_values import _split_last, _weigh_plain, packed_items, read_fields, segment
from corpusloom.session import read

KINDS = ["\n", "\t", "|｜", "、､", ",，", "/／", "　"]
QUOTED = re.compile(r'\s*"((?:[^"]|"")*)"\s*$')


def split_by_hand(text, joined):
    """The rules read one character at a time."""

    def cut(marks):
        pieces, now, i, fresh = [], "", 0, True
        while i < len(text):
            if fresh and text[i:].lstrip(" 　").startswith('"'):
                rest = text[i:]
                m = re.match(r'[\s　]*"(?:[^"]|"")*"[\s　]*', rest)
                if m and (m.end() == len(rest) or rest[m.end()] in marks):
                    now, i, fresh = m.group(), i + m.end(), False
                    continue
            fresh = False
            if text[i] in marks:
                pieces.append(now)
                now, fresh = "", True
            else:
                now += text[i]
            i += 1
        return [*pieces, now]

    bare = re.sub(r'(^|[;；\n\t|｜、､,，/／　])\s*"(?:[^"]|"")*"\s*(?=$|[;；\n\t|｜、､,，/／　])', r"\1Q", text).strip()
    marks = next((m for m in ["；;", *KINDS] if any(c in bare for c in m)), "\0")
    items = []
    pieces = [p for p in cut(marks) if p.strip()]
    for k, piece in enumerate(pieces):
        parts = re.split(r"(?:^|\s+)(?:and|&)\s+", piece.strip()) if joined and k == len(pieces) - 1 and '"' not in piece else [piece]
        for part in parts:
            m = QUOTED.match(part)
            value = (m.group(1).replace('""', '"') if m else part).strip()
            if value:
                items.append(value)
    return items


def items_of(spark, text, field="keywords"):
    frame = spark.createDataFrame([(1, text)], "k bigint, v string")
    rows = packed_items(frame, "k", {field: F.col("v")}).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(1, len(rows) + 1))
    return [r["item"] for r in rows]


def test_marks_and_quotes(spark):
    assert items_of(spark, "a; b；c;;") == ["a", "b", "c"]
    assert items_of(spark, 'x/y;"p;q";"so ""z"""') == ["x/y", "p;q", 'so "z"']
    assert items_of(spark, "a,b，a") == ["a", "b", "a"]
    assert items_of(spark, "a、b/c") == ["a", "b/c"]
    assert items_of(spark, 'so called "agent"') == ['so called "agent"']
    assert items_of(spark, '"open, never closed') == ['"open', "never closed"]
    assert items_of(spark, "Ann Lee, Bo Ray, and Cy Poe", "authors") == ["Ann Lee", "Bo Ray", "Cy Poe"]
    assert items_of(spark, "Ann Lee & Bo Ray", "authors") == ["Ann Lee", "Bo Ray"]
    assert items_of(spark, "rise and fall", "keywords") == ["rise and fall"]


def test_empty_and_clashing(spark):
    frame = spark.createDataFrame([(1, None, "x", 0), (2, "", "x", 0), (3, " ;; ", "x", 0), (4, "a" * 200_000 + ";b", "x", 0)], "k bigint, v string, items string, id int")
    rows = packed_items(frame, "k", {"keywords": F.col("v")}).collect()
    assert [(r["id"], len(r["item"])) for r in sorted(rows, key=lambda r: r["pos"])] == [(4, 200_000), (4, 1)]
    assert packed_items(frame.filter("k > 9"), "k", {"keywords": F.col("v")}).count() == 0


def test_segmentation_keeps_frequent_compounds(spark):
    rows = [(i, "co/op; other") for i in range(40)] + [(100, "co/op/solo"), (101, "one/two")]
    frame = spark.createDataFrame(rows, "k bigint, v string")
    got = {}
    for r in packed_items(frame, "k", {"keywords": F.col("v")}).filter("id >= 100").collect():
        got.setdefault(r["id"], {})[r["pos"]] = r["item"]
    assert got == {100: {1: "co/op", 2: "solo"}, 101: {1: "one", 2: "two"}}


def test_whole_table_against_rules_by_hand(spark):
    corpus = read(spark, "/root/testdata/sf0.001", "demo_corpus")
    got = {}
    for r in packed_items(corpus, "rec_no", {f: F.col(f"meta.{f}") for f in ("authors", "organ", "keywords")}).collect():
        got.setdefault((r["id"], r["field"]), {})[r["pos"]] = r["item"]
    for row in corpus.collect():
        for field in ("authors", "organ", "keywords"):
            text = row["meta"][field]
            want = split_by_hand(text, field == "authors") if text else []
            assert [got.get((row["rec_no"], field), {})[i + 1] for i in range(len(want))] == want, text
            assert len(got.get((row["rec_no"], field), {})) == len(want), text


def test_every_marked_field_has_a_lattice(spark):
    corpus = read(spark, "/root/testdata/sf0.001", "demo_corpus")
    parsed = read_fields(corpus, "rec_no", {f: F.col(f"meta.{f}") for f in ("authors", "organ", "keywords")})
    marked = parsed.filter("readings IS NOT NULL").select("field", "raw").distinct().count()
    paths = segment(parsed)
    assert paths.count() == marked > 0
    assert segment(parsed.limit(0)).count() == 0


def test_the_column_decides_between_kinds(spark):
    """By precedence alone the comma would split; the column shows that it belongs to these values."""
    rows = [(i, "Lee, Ann; Ray, Bo; Poe, Cy") for i in range(30)] + [(100, "Lee, Ann/Ray, Bo"), (101, "Poe, Cy")]
    got = {}
    for r in packed_items(spark.createDataFrame(rows, "k bigint, v string"), "k", {"keywords": F.col("v")}).filter("id >= 100").collect():
        got.setdefault(r["id"], {})[r["pos"]] = r["item"]
    assert got == {100: {1: "Lee, Ann", 2: "Ray, Bo"}, 101: {1: "Poe, Cy"}}


def test_costly_columns_are_computed_once(spark):
    """Written out more than once they are computed each time, which made up over a third of the work."""
    assert str(_weigh_plain(F.col("spans"), F.col("scores"))).count("scores") == 1
    assert str(_split_last(F.col("pieces"))).count("pieces") == 1
    frame = spark.createDataFrame([(1, "a; b"), (2, "c/d"), (3, "e")], "k bigint, v string")
    rows = packed_items(frame, "k", {"keywords": F.col("v")}).filter("n_items > 1")
    assert "size(filter(" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["id"], r["pos"], r["item"]) for r in rows.collect()) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 2, "d")]
