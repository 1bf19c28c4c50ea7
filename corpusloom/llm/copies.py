"""Records that are the same but for white space, letter case and punctuation.

The canonical bytes of a record are its key fields without white space and
Unicode punctuation, case-folded, joined by a separator.  Records are counted by
recursive radix partitioning on those bytes:

* a bucket is a byte prefix; buckets that hold more than ``capacity`` records are
  split by further bytes until each fits.  A key that ends inside a prefix is
  terminal and needs no further split, however many copies it has;
* each task first counts its own records in a trie (so a record copied a billion
  times is shuffled once per task), then the tries of a bucket are merged in one
  bounded trie with terminal counters.

Defined results: a missing key field equals an empty one; records whose first
key field is empty after canonicalising belong to no class; an empty table gives
no rows; other columns of the table are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.selection import pairs_within
from corpusloom.session import materialise

SEPARATOR = "\x1f"
#: Records of one bucket, and distinct keys a map-side trie holds before it is emptied.
CAPACITY = 50_000
FIRST_PREFIX = 12
_CHUNK = 16
_SCHEMA = "tab string, bucket binary, key binary, n bigint, first_id bigint"


def canonical_text(value: Column) -> Column:
    """Case-folded text without white space and Unicode punctuation; null is empty."""
    # lower case, and the letters whose capitals stand for another small letter
    folded = F.replace(F.translate(F.lower(F.coalesce(value, F.lit(""))), "ςſµ", "σsμ"), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(folded, r"[\p{P}\p{IsWhite_Space}]+", "")


def canonical_keys(df: DataFrame, id_col: str, fields: list[Column], tab: str) -> DataFrame:
    """``(tab, id, key)`` of the records whose first field is not empty."""
    parts = [canonical_text(f).alias(f"f{i}") for i, f in enumerate(fields)]
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), *parts).filter(F.col("f0") != "")
    return rows.select(F.lit(tab).alias("tab"), "id", F.encode(F.concat_ws(SEPARATOR, *[f"f{i}" for i in range(len(fields))]), "utf-8").alias("key"))


def _with_buckets(keys: DataFrame, capacity: int) -> DataFrame:
    """Adds ``bucket``: the shortest prefix whose bucket fits, or the whole key where the key ends first."""
    rows = keys.withColumn("bucket", F.substring("key", 1, FIRST_PREFIX)).withColumn("open", F.lit(True))
    length = FIRST_PREFIX
    while True:
        counts = rows.filter(F.col("open") & (F.length("key") > length)).groupBy("tab", "bucket").agg(F.count("*").alias("n"))
        over = materialise(counts.filter(F.col("n") > capacity).select("tab", "bucket", F.lit(True).alias("split")))
        if not over.head(1):
            return rows.drop("open")
        longer = F.substring("key", 1, length * 2)
        rows = rows.join(over, ["tab", "bucket"], "left").select(
            "tab",
            "id",
            "key",
            F.when(F.col("split") & F.col("open"), longer).otherwise(F.col("bucket")).alias("bucket"),
            F.coalesce(F.col("split") & F.col("open"), F.lit(False)).alias("open"),
        )
        length *= 2


class _Trie:
    """A trie over fixed-size byte slices; a terminal counter is ``[n, first_id]``."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.size = 0

    def add(self, key: bytes, n: int, first_id: int) -> None:
        node = self.root
        for i in range(0, len(key), _CHUNK):
            node = node.setdefault(key[i : i + _CHUNK], {})
        if (counter := node.get(None)) is None:
            node[None] = [n, first_id]
            self.size += 1
        else:
            counter[0] += n
            counter[1] = min(counter[1], first_id)

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            for part, child in node.items():
                if part is None:
                    yield prefix, child[0], child[1]
                else:
                    stack.append((prefix + part, child))


def _emit(tab: str, bucket: bytes, trie: _Trie) -> Iterator[pa.RecordBatch]:
    rows = list(trie.items())
    if rows:
        keys, ns, firsts = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([tab] * len(rows), pa.string()), pa.array([bucket] * len(rows), pa.binary()), pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(firsts, pa.int64())],
            names=["tab", "bucket", "key", "n", "first_id"],
        )


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of one task's own records, by bucket; emptied when they hold ``CAPACITY`` keys."""
    tries: dict[tuple, _Trie] = {}
    held = 0
    for batch in batches:
        for tab, bucket, key, n, first in zip(*(batch.column(c).to_pylist() for c in ("tab", "bucket", "key", "n", "first_id"))):
            trie = tries.get((tab, bucket))
            if trie is None:
                trie = tries[tab, bucket] = _Trie()
            before = trie.size
            trie.add(key, n, first)
            held += trie.size - before
        if held > CAPACITY:
            yield from _together(tries)
            tries, held = {}, 0
    yield from _together(tries)


def _together(tries: dict[tuple, _Trie]) -> Iterator[pa.RecordBatch]:
    batches = [b for (tab, bucket), trie in tries.items() for b in _emit(tab, bucket, trie)]
    if batches:
        yield from pa.Table.from_batches(batches).combine_chunks().to_batches()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One trie per bucket; rows come sorted by bucket, so one trie is held at a time."""
    at, trie, done, held = None, _Trie(), {}, 0
    for batch in batches:
        for tab, bucket, key, n, first in zip(*(batch.column(c).to_pylist() for c in ("tab", "bucket", "key", "n", "first_id"))):
            if (tab, bucket) != at:
                if at is not None:
                    done[at] = trie
                    held += trie.size
                    if held > CAPACITY:
                        yield from _together(done)
                        done, held = {}, 0
                at, trie = (tab, bucket), _Trie()
            trie.add(key, n, first)
    if at is not None:
        done[at] = trie
    yield from _together(done)


def copy_classes(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(tab, key, n, first_id)``: one row per distinct record with its number of copies."""
    rows = _with_buckets(keys, capacity).select("tab", "bucket", "key", F.lit(1).cast("bigint").alias("n"), F.col("id").alias("first_id"))
    partial = rows.mapInArrow(_partial, _SCHEMA)
    merged = partial.repartition("tab", "bucket").sortWithinPartitions("tab", "bucket").mapInArrow(_merged, _SCHEMA)
    return merged.select("tab", "key", "n", "first_id")


def copies(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The classes, and ``(tab, class_id, id, n)`` of the records in classes of two or more."""
    keys = materialise(keys)
    classes = copy_classes(keys, capacity)
    several = materialise(classes.filter("n > 1"))
    members = keys.join(several.select("tab", "key", F.col("first_id").alias("class_id"), "n"), ["tab", "key"]).select("tab", "class_id", "id", "n")
    return classes, members


def copy_pairs(members: DataFrame) -> DataFrame:
    """All pairs within each class, ``id_a < id_b``."""
    return pairs_within(members, ["tab", "class_id"], "id").select("tab", "id_a", "id_b")
