"""Differences, merges, replicated values, indexes and clocks."""

import itertools
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from docframe import SyncAuthority
from docframe.functions.clocks import Hlc, bool_key, bytes_key, checksum, device_key, float_key, hlc, in_scope, int_key, scoped_key
from docframe.operators import crdt, diff, indexes, merge
from docframe.operators.ranks import numbered
from docframe.plans.filters import DYNAMIC


def rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=str)


def test_diff(spark):
    kind = "doc_id long, name string, score double"
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", math.nan), (4, None, 2.0)], kind)
    new = spark.createDataFrame([(5, "e", 1.0), (4, "d", 2.0), (3, "c", math.nan), (2, "b", None)], kind)
    got = diff.ordered(diff.query_diff(old, new)).collect()
    assert [tuple(r) for r in got] == [("added", 5, "e", 1.0), ("removed", 1, "a", 1.0), ("updated", 4, "d", 2.0)]
    assert diff.query_diff(old, old).isEmpty()
    assert diff.query_diff(old.select("doc_id"), new.select("doc_id")).count() == 2


def test_diff_of_dynamic_documents(spark):
    v = lambda i: {"a": {"tag": "int", "i": i, "s": None, "f": None, "b": None, "x": None}}
    kind = f"doc_id long, fields {DYNAMIC}"
    old, new = spark.createDataFrame([(1, v(1)), (2, v(2))], kind), spark.createDataFrame([(1, v(1)), (2, v(3))], kind)
    assert [r["doc_id"] for r in diff.query_diff(old, new).collect()] == [2]


def test_merge_runs(spark):
    kind = "key string, value string, is_tombstone boolean"
    runs = [[("a", "1", False), ("b", "1", False), ("c", "1", False)], [("b", None, True), ("d", "2", False)], [("a", "3", False), ("d", None, True), ("b", "3", False)]]
    merged = merge.merge_runs([spark.createDataFrame(r, kind) for r in runs])
    assert rows(merged, "key", "value", "is_tombstone") == [("a", "3", False), ("b", "3", False), ("c", "1", False), ("d", None, True)]
    assert rows(merge.live(merged), "key") == [("a",), ("b",), ("c",)]
    assert rows(merge.key_range(merged, "b", "d"), "key") == [("b",), ("c",)]
    assert rows(merge.key_range(merged, "c"), "key") == [("c",), ("d",)]


def registers(spark, items):
    return spark.createDataFrame(items, "doc_id long, value string, physical long, logical int, device long")


def test_lww(spark):
    a = registers(spark, [(1, "old", 1, 0, 1), (2, "same", 5, 0, 1), (3, "x", 9, 0, 1)])
    b = registers(spark, [(1, "new", 1, 1, 0), (2, "other", 5, 0, 1), (3, None, 9, 0, 2), (4, "only", 1, 0, 1)])
    assert rows(crdt.lww_join(a, b, ["doc_id"]), "doc_id", "value") == [(1, "new"), (2, "same"), (3, None), (4, "only")]
    assert rows(crdt.lww_join(b, a, ["doc_id"]), "doc_id", "value")[1] == (2, "other")  # with equal clocks the local one


def test_lww_laws(spark):
    r = random.Random(1)
    writes = [(r.randint(1, 4), str(i), r.randint(1, 5), r.randint(0, 2), i) for i in range(30)]
    want = {d: max((w for w in writes if w[0] == d), key=lambda w: w[2:])[1] for d in {w[0] for w in writes}}
    parts = [writes[:10], writes[10:20], writes[20:]]
    for order in itertools.permutations(range(3)):
        out = registers(spark, parts[order[0]])
        for i in order[1:]:
            out = crdt.lww_join(out, registers(spark, parts[i]), ["doc_id"])
        assert dict(rows(out, "doc_id", "value")) == want


def counters(spark, items):
    return spark.createDataFrame(items, "doc_id long, device long, delta long")


def test_counters(spark):
    a = counters(spark, [(1, 1, 7), (1, 2, -5), (2, 1, 3)])
    b = counters(spark, [(1, 1, 10), (1, 3, -4), (1, 4, 6), (2, 1, 1)])
    assert rows(crdt.counter_join(a, b, ["doc_id"])) == [(1, 1, 10), (1, 2, -5), (1, 3, 0), (1, 4, 6), (2, 1, 3)]
    assert rows(crdt.counter_value(a, ["doc_id"])) == [(1, 2), (2, 3)]
    assert crdt.device_delta(a.filter("doc_id = 1"), 2).first()[0] == -5
    assert crdt.device_delta(a, 99).first()[0] == 0
    assert rows(crdt.counter_add(a, counters(spark, [(1, 1, -2), (3, 1, 1)]), ["doc_id"])) == [(1, 1, 5), (1, 2, -5), (2, 1, 3), (3, 1, 1)]
    assert rows(crdt.counter_merge(a.union(b), ["doc_id"])) == [(1, 1, 10), (1, 2, -5), (1, 3, -4), (1, 4, 6), (2, 1, 3)]


def tags(spark, items):
    return spark.createDataFrame(items, "doc_id long, element string, device long, physical long, logical int")


def test_sets(spark):
    a = tags(spark, [(1, "x", 1, 1, 0), (1, "y", 1, 2, 0)])
    b = tags(spark, [(1, "x", 1, 1, 0), (1, "x", 2, 3, 0), (2, "z", 2, 1, 0)])
    both = crdt.orset_merge(a, b)
    assert both.count() == 4 and rows(crdt.orset_elements(both, ["doc_id"])) == [(1, "x"), (1, "y"), (2, "z")]
    assert rows(crdt.orset_size(both, ["doc_id"])) == [(1, 2), (2, 1)]
    assert rows(crdt.orset_contains(both, ["doc_id"], "y")) == [(1, True), (2, False)]
    gone = crdt.orset_remove(a, tags(spark, [(1, "x", 0, 0, 0)]), ["doc_id"])
    assert rows(crdt.orset_elements(gone, ["doc_id"])) == [(1, "y")]
    assert crdt.orset_merge(gone, b).filter("element = 'x'").count() == 2  # another replica brings it back


@pytest.mark.parametrize("mode", list(SyncAuthority))
@pytest.mark.parametrize("is_remote", [True, False])
def test_authority(spark, mode, is_remote):
    takes = is_remote and mode is SyncAuthority.RemoteAuthority
    a, b = registers(spark, [(1, "local", 9, 0, 1), (2, "mine", 1, 0, 1)]), registers(spark, [(1, "remote", 1, 0, 1)])
    assert rows(crdt.resolve_lww(a, b, ["doc_id"], mode, is_remote), "doc_id", "value") == [(1, "remote" if takes else "local"), (2, "mine")]
    a, b = counters(spark, [(1, 1, 9), (1, 2, 2)]), counters(spark, [(1, 1, 4)])
    assert rows(crdt.resolve_counter(a, b, ["doc_id"], mode, is_remote)) == ([(1, 1, 4)] if takes else [(1, 1, 9), (1, 2, 2)])
    a, b = tags(spark, [(1, "x", 1, 1, 0)]), tags(spark, [(1, "y", 1, 1, 0)])
    assert rows(crdt.resolve_orset(a, b, ["doc_id"], mode, is_remote), "element") == ([("y",)] if takes else [("x",), ("y",)])


def test_indexes(spark, tmp_path):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (4, None), (2, "b")], "doc_id long, f string")
    assert rows(indexes.index_entries(df, "f")) == [("a", 1), ("b", 2), ("b", 3)]
    assert indexes.entry_count(df, "f").first()[0] == 3
    assert [r[0] for r in indexes.lookup(df, "f", "b").collect()] == [2, 3]
    assert [tuple(r) for r in indexes.range_lookup(df, "f", "a", low_inclusive=False).collect()] == [("b", 2), ("b", 3)]
    assert indexes.range_lookup(df, "f", high="b", high_inclusive=False).count() == 1
    index = indexes.index_entries(df, "f")
    assert indexes.add_entries(index, index).count() == 3 and indexes.remove_entries(index, index.filter("doc_id = 1")).count() == 2
    indexes.write_sorted(df, str(tmp_path / "sorted"), "f", 2)
    indexes.write_hashed(df, str(tmp_path / "hashed"), "f", 10)
    assert spark.read.parquet(str(tmp_path / "sorted")).count() == spark.read.parquet(str(tmp_path / "hashed")).count() == 5
    bloom = indexes.Bloom.of(df, "doc_id", 100)
    assert all(bloom.may_contain(i) for i in (1, 2, 3, 4)) and not all(bloom.may_contain(i) for i in range(1000, 1100))


def test_keys_keep_the_order(spark):
    ints = [-(2**63), -5, -1, 0, 1, 7, 2**63 - 1]
    floats = [-math.inf, -2.5, -1e-300, 0.0, 1e-300, 2.5, math.inf]
    df = spark.createDataFrame(list(zip(ints, floats)), "i long, f double").select("i", "f", int_key(F.col("i")).alias("a"), float_key(F.col("f")).alias("b"))
    got = df.collect()
    assert sorted(got, key=lambda r: r["a"]) == sorted(got, key=lambda r: r["i"]) == sorted(got, key=lambda r: r["b"])
    assert {r["i"]: r["a"] for r in got} == {i: struct.pack(">Q", i + 2**63).hex() for i in ints}
    one = spark.range(1).select(bool_key(F.lit(True)), bytes_key(F.lit(b"\x0a")), device_key(F.lit(258)), scoped_key("u", F.lit(7)), in_scope(F.lit("u:7"), "u"), checksum(F.lit(b"ab")) == checksum(F.lit(b"ab")))
    assert list(one.first()) == ["01", "0a", bytearray(bytes(14) + b"\x01\x02"), "u:7", True, True]


def test_clock(spark):
    assert Hlc(5, 3).advance(9) == Hlc(9, 0) and Hlc(5, 3).advance(5) == Hlc(5, 4) and Hlc(5, 65535).advance(1) == Hlc(6, 0)
    df = spark.createDataFrame([(1, 9), (2, 0), (1, 10)], "p long, l int")
    assert [tuple(r) for r in df.orderBy(hlc(F.col("p"), F.col("l"))).collect()] == [(1, 9), (1, 10), (2, 0)]


def test_bloom_filters(spark):
    b = indexes.Bloom.of(spark.range(1000), "id", 2000, 1e-4)
    assert all(b.may_contain(k) for k in (0, 500, 999)) and not b.may_contain(5000)
    assert b.insert(5000) and not b.insert(5000)
    more = indexes.Bloom.of(spark.range(3000, 3010), "id", 2000, 1e-4)
    b.merge(more)
    again = indexes.Bloom.decode(spark, b.encode())
    assert again.may_contain(5000) and again.may_contain(3005) and not again.may_contain(4000)


def test_removed_entries(spark):
    index, gone = (spark.createDataFrame(r, "key string, doc_id long") for r in ([("a", 1), ("a", 2)], [("a", 1), ("a", 1), ("b", 1)]))
    assert sorted(map(tuple, indexes.removed(index, gone).collect())) == [("a", 1, True), ("b", 1, False)]


def test_numbered(spark):
    rows = spark.createDataFrame([(i % 7 if i % 3 else None, i) for i in range(200)], "k int, i int").repartition(5)
    got = [(r["k"], r["i"]) for r in sorted(numbered(rows, F.col("k").desc_nulls_first(), F.col("i")).collect(), key=lambda r: r["place"])]
    assert got == sorted(((i % 7 if i % 3 else None, i) for i in range(200)), key=lambda r: (r[0] is not None, -(r[0] or 0), r[1]))
    assert numbered(rows.limit(0), F.col("i")).count() == 0
