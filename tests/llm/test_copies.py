import random

from pyspark.sql import functions as F

from corpusloom.llm.catalog import p1
from corpusloom.llm.copies import _Trie, canonical_keys, copies, copy_classes, copy_pairs
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


def keys_of(spark, rows):
    frame = spark.createDataFrame(rows, "n bigint, title string, doi string, tab string, key string, f0 string")
    return canonical_keys(frame, "n", [F.col("title"), F.col("doi")], "t")


def test_form_only(spark):
    rows = [(1, "A  b—C", None, "x", "x", "x"), (2, "abc", "", "y", "y", "y"), (3, "ab c+", "", "", "", ""), (4, None, "d", "", "", ""), (5, " .", "d", "", "", ""), (6, "STRASSE", "1/2", "", "", ""), (7, "straße", "1／2", "", "", "")]
    _, members = copies(keys_of(spark, rows))
    assert sorted(tuple(r)[1:] for r in copy_pairs(members).collect()) == [(1, 2), (6, 7)]
    assert keys_of(spark, rows[:0] or [(9, None, None, "", "", "")]).count() == 0
    assert copy_classes(keys_of(spark, rows).limit(0)).count() == 0


def test_small_buckets_and_hot_copies(spark):
    """Buckets of three records: long shared prefixes are split again and again; a third of all rows is one record."""
    rng = random.Random(1)
    texts = ["same text " * 30] * 40 + ["common prefix " * 4 + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    frame = spark.createDataFrame([(i, t, None, "", "", "") for i, t in enumerate(texts)], "n bigint, title string, doi string, tab string, key string, f0 string")
    keys = canonical_keys(frame, "n", [F.col("title"), F.col("doi")], "t")
    got = {r["first_id"]: r["n"] for r in copy_classes(keys, capacity=3).collect()}
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(t.replace(" ", ""), []).append(i)
    assert got == {ids[0]: len(ids) for ids in want.values()}


def test_trie():
    trie = _Trie()
    for key in (b"", b"a" * 40, b"a" * 16, b"a" * 40):
        trie.add(key, 1, 7)
    assert sorted(trie.items()) == [(b"", 1, 7), (b"a" * 16, 1, 7), (b"a" * 40, 2, 7)]


def test_against_sql(spark):
    for name in ("p1_found", "p1_copies"):
        assert_same(spark, name, p1.QUERIES[name], p1.ORACLE[name], SF)
