"""Schemas, filters, the query builder and access paths."""

import math

import pytest
from pyspark.sql import types as T

from docframe import CrdtHint, FieldType, Filter, Query, Schema, Sort, SyncAuthority
from docframe.errors import QueryError, SchemaError
from docframe.plans.access import IndexInfo, IndexKind, access_path, pushed_filters
from docframe.plans.filters import DYNAMIC
from docframe.plans.schema import SchemaBuilder, evolution, is_valid_evolution

USERS = [(1, "Alice", 30, True, 95.5, b"\x01\x02"), (2, "Bob", 25, False, math.nan, b""), (3, "Charlie", 35, True, -0.0, None), (4, "Diana", 28, True, None, b"\xff\x00"), (5, None, 22, False, 0.0, b"\x02")]


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(USERS, "doc_id long, name string, age int, active boolean, score double, raw binary").cache()


def found(users, where):
    return sorted(r["doc_id"] for r in Query.collection("users").filter(where).on(users).collect())


@pytest.mark.parametrize(
    "where,want",
    [
        (Filter.eq("name", "Alice"), [1]),
        (Filter.eq("age", 25), [2]),
        (Filter.eq("age", 25.0), []),
        (Filter.eq("age", "25"), []),
        (Filter.eq("active", True), [1, 3, 4]),
        (Filter.eq("active", 1), []),
        (Filter.lt("age", 28), [2, 5]),
        (Filter.lte("age", 28), [2, 4, 5]),
        (Filter.gt("age", 28), [1, 3]),
        (Filter.gte("age", 28), [1, 3, 4]),
        (Filter.gt("name", "Bob"), [3, 4]),
        (Filter.gt("score", -1.0), [1, 3, 5]),
        (Filter.gte("score", 0.0), [1, 3, 5]),
        (Filter.eq("score", 0.0), [3, 5]),
        (Filter.eq("score", math.nan), []),
        (Filter.lt("score", math.inf), [1, 3, 5]),
        (Filter.lt("score", math.nan), []),
        (Filter.eq("name", None), [5]),
        (Filter.gt("name", None), []),
        (Filter.contains("name", "li"), [1, 3]),
        (Filter.contains("name", "LI"), []),
        (Filter.contains("name", ""), [1, 2, 3, 4]),
        (Filter.contains("age", 2), []),
        (Filter.contains("raw", b"\x02"), [1, 5]),
        (Filter.contains("raw", b""), [1, 2, 4, 5]),
        (Filter.contains("raw", "x"), []),
        (Filter.gt("raw", b"\x7f"), [4]),
        (Filter.eq("missing", 1), []),
        (Filter.and_(), [1, 2, 3, 4, 5]),
        (Filter.or_(), []),
        (Filter.and_(Filter.eq("active", True), Filter.lt("age", 31)), [1, 4]),
        (Filter.or_(Filter.eq("name", "Bob"), Filter.and_(Filter.eq("active", True), Filter.gt("age", 30))), [2, 3]),
    ],
)
def test_filters(users, where, want):
    assert found(users, where) == want


def test_filters_on_dynamic_documents(spark):
    row = lambda tag, **v: dict({"tag": tag, "s": None, "i": None, "f": None, "b": None, "x": None}, **v)
    docs = [
        (1, {"a": row("int", i=3), "b": row("string", s="x")}),
        (2, {"a": row("null")}),
        (3, {"b": row("string", s="y")}),
        (4, {"a": row("float", f=3.0)}),
        (5, {"a": row("float", f=math.nan)}),
    ]
    df = spark.createDataFrame(docs, f"doc_id long, fields {DYNAMIC}")
    assert found(df, Filter.eq("a", None)) == [2]  # a missing field isn't an explicit null
    assert found(df, Filter.eq("a", 3)) == [1]
    assert found(df, Filter.gte("a", 3.0)) == [4]
    assert found(df, Filter.contains("b", "y")) == [3]
    assert [r["doc_id"] for r in Query.collection("d").sort(Sort.asc("b")).on(df).collect()] == [1, 3, 2, 4, 5]


def test_unknown_literals_are_refused(users):
    with pytest.raises(QueryError):
        found(users, Filter.eq("age", [1]))


def test_sort_offset_limit(users):
    run = lambda q: [r["doc_id"] for r in q.on(users).collect()]
    q = Query.collection("users")
    assert run(q.sort(Sort.asc("name"))) == [1, 2, 3, 4, 5]
    assert run(q.sort(Sort.desc("name"))) == [5, 4, 3, 2, 1]
    assert run(q.sort(Sort.asc("active"))) == [2, 5, 1, 3, 4]  # ties by id
    assert run(q.sort(Sort.desc("active"))) == [1, 3, 4, 2, 5]
    assert run(q.sort(Sort.asc("nothing"))) == [1, 2, 3, 4, 5]
    assert run(q.limit(2).offset(1).sort(Sort.asc("age"))) == run(q.sort(Sort.asc("age")).offset(1).limit(2)) == [2, 4]
    assert run(q.offset(9)) == run(q.limit(0)) == []
    assert run(q.sort(Sort.asc("age")).sort(Sort.desc("age")).limit(9).limit(1)) == [3]
    with pytest.raises(QueryError):
        q.limit(-1)
    with pytest.raises(QueryError):
        q.run({"others": users})
    assert q.run({"users": users}).count() == 5


def test_top_k_and_pushdown(spark, tmp_path, users):
    users.write.parquet(str(tmp_path / "users"))
    df = spark.read.parquet(str(tmp_path / "users"))
    q = Query.collection("users").filter(Filter.and_(Filter.gt("age", 24), Filter.contains("name", "a"))).sort(Sort.asc("age")).offset(1).limit(2)
    plan = q.on(df)
    assert "TakeOrderedAndProject" in plan._jdf.queryExecution().executedPlan().toString()
    assert any("GreaterThan(age,24)" in x and "StringContains(name,a)" in x for x in pushed_filters(plan))


def test_access_paths():
    indexes = [IndexInfo("age", IndexKind.BTree), IndexInfo("name", IndexKind.Hash)]
    path = lambda w, total=300: access_path(Query.collection("u").filter(w), indexes, total)
    assert access_path(Query.collection("u"), indexes, 300).strategy == "full"
    assert (path(Filter.eq("name", "x")).strategy, path(Filter.eq("name", "x")).cost) == ("hash", 1)
    assert path(Filter.eq("age", 3)).low == path(Filter.eq("age", 3)).high == (3, True)
    gt, lte = path(Filter.gt("age", 3)), path(Filter.lte("age", 3))
    assert (gt.low, gt.high, gt.cost) == ((3, False), None, 100) and (lte.low, lte.high) == (None, (3, True))
    assert path(Filter.gt("name", "x")).strategy == path(Filter.contains("name", "x")).strategy == "full"
    assert path(Filter.or_(Filter.eq("name", "x"))).strategy == "full"
    assert path(Filter.and_(Filter.gt("age", 3), Filter.eq("name", "x"))).strategy == "hash"
    assert path(Filter.and_(Filter.gt("age", 3), Filter.eq("name", "x")), 2).strategy == "range"  # a third of 2 is 0
    assert path(Filter.and_(Filter.and_(Filter.eq("name", "x")))).strategy == "full"  # nested ones don't count


def base():
    return Schema.builder("Parcel").required_field("label", FieldType.String).field("note", FieldType.String).field("grams", FieldType.Int)


def test_schema_builder():
    s = base().version(3).sync_authority(SyncAuthority.RemoteFirst).field("stops", FieldType.Collection).build()
    assert s.field("stops").hint is CrdtHint.OrSet and s.field("grams").hint is CrdtHint.Lww
    assert (s.field_count, s.version_label, str(s.authority)) == (4, "v3", "RemoteFirst")
    assert Schema.from_json(s.to_json()) == s
    spark = s.to_spark()
    assert not spark["label"].nullable and spark["stops"].metadata["hint"] == "orset"
    assert all(FieldType[t].spark is not None for t in ("Reference", "Bytes", "Bool", "Float"))
    again = SchemaBuilder.of("Parcel", T.StructType(spark.fields[1:])).version(3).sync_authority(SyncAuthority.RemoteFirst).build()
    assert again == s
    with pytest.raises(SchemaError):
        SchemaBuilder.of("x", T.StructType([T.StructField("at", T.DateType())]))


@pytest.mark.parametrize(
    "make",
    [
        lambda: Schema.builder("").field("a", FieldType.Int),
        lambda: Schema.builder("a"),
        lambda: Schema.builder("a").field("", FieldType.Int),
        lambda: Schema.builder("a").field("x", FieldType.Int).field("x", FieldType.Bool),
        lambda: Schema.builder("a").field("x", FieldType.String, CrdtHint.Counter),
        lambda: Schema.builder("a").field("x", FieldType.Collection, CrdtHint.Lww),
        lambda: Schema.builder("a").field("x", FieldType.Int, CrdtHint.OrSet),
    ],
)
def test_schemas_that_cannot_be_built(make):
    with pytest.raises(SchemaError):
        make().build()


def test_evolution():
    old = base().build()
    assert evolution(old, base().build()).kind == "Identical"
    more = base().required_field("route", FieldType.String).build()
    assert evolution(old, more).new_fields == ("route",) and evolution(old, more).kind == "Additive"
    loose = Schema.builder("Parcel").field("label", FieldType.String).field("note", FieldType.String).field("grams", FieldType.Int).build()
    assert evolution(old, loose).kind == "Identical"
    assert [(c.kind, c.field) for c in evolution(loose, old).breaking] == [("required", "label")]
    other = Schema.builder("Parcel").sync_authority(SyncAuthority.RemoteAuthority).field("label", FieldType.Bytes).field("grams", FieldType.Int, CrdtHint.Counter).build()
    changes = evolution(old, other).breaking
    assert [(c.kind, c.field, c.old, c.new) for c in changes] == [
        ("type", "label", "String", "Bytes"), ("removed", "note", None, None), ("hint", "grams", "Lww", "Counter"), ("authority", None, "LocalFirst", "RemoteAuthority"),
    ]
    assert "label" in str(changes[0]) and "RemoteAuthority" in str(changes[3])
    assert is_valid_evolution(old, more) and not is_valid_evolution(old, other)
    bumped = Schema(other.name, other.fields, 2, other.authority)
    assert is_valid_evolution(old, bumped)
