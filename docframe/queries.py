"""Every operator over the tables of a folder, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import Conflict
from .functions import clocks
from .operators import crdt, diff, indexes, merge
from .operators.ranks import numbered
from .plans.access import IndexInfo, IndexKind, access_path
from .plans.filters import Filter
from .plans.query import Query, Sort, by_id, count, ids
from .plans.schema import SchemaBuilder, SyncAuthority, evolution
from .sources.documents import VersionedStore
from .sources.files import saved, scratch
from .sources.store import Config, Store
from .streaming import live
from .streaming.incremental import filtered_changes

Run = Callable[[SparkSession, str], DataFrame]
_RUNS: dict[str, Run] = {}
_SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def keep(run: Run) -> Run:
        _RUNS[name] = run
        if sql:
            _SQL[name] = sql
        return run

    return keep


class _Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def labelled(self) -> DataFrame:
        """Documents with a quality, where one was given."""
        return self.documents.select("doc_id", "lang", "source", "n_chars").join(self.labels.select("doc_id", "quality"), "doc_id", "left")

    def writes(self) -> DataFrame:
        """Events as writes to registers of their users, with clock and device."""
        return self.events.select(
            F.col("user_id").alias("doc_id"), "event_id", "event_type", F.col("props").alias("value"),
            clocks.epoch_ms(F.col("ts")).alias("physical"), (F.col("event_id") % 3).cast("int").alias("logical"), (F.col("event_id") % 7).alias("device"),
        )

    def versions(self) -> DataFrame:
        """Events as versions of keys; an error deletes."""
        return self.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("_seq"), F.col("props").alias("value"), (F.col("event_type") == "error").alias("is_tombstone"))


def _simple(name: str, table: str, sql: str, run: Callable[[DataFrame], DataFrame]) -> None:
    _add(name, sql)(lambda spark, d: run(getattr(_Tables(spark, d), table)))


def _q(source: str, where: Filter | None = None) -> Query:
    q = Query.collection(source)
    return q if where is None else q.filter(where)


# -- scans and filters

_simple("full_scan", "region", "SELECT * FROM region", lambda t: _q("region").on(t))
_simple("scan_by_id", "customer", "SELECT * FROM customer WHERE c_custkey = 42", lambda t: by_id(t, 42, "c_custkey"))
_simple("scan_ids", "customer", "SELECT c_custkey FROM customer", lambda t: ids(t, "c_custkey"))
_simple("store_count", "customer", "SELECT count(*) AS n FROM customer", count)

_FILTERS: list[tuple[str, str, Filter, str, str]] = [
    ("hash_lookup_eq", "customer", Filter.eq("c_mktsegment", "BUILDING"), "*", "c_mktsegment = 'BUILDING'"),
    ("btree_point", "part", Filter.eq("p_size", 15), "*", "p_size = 15"),
    ("btree_range_gt", "part", Filter.gt("p_size", 40), "*", "p_size > 40"),
    ("btree_range_gte", "orders", Filter.gte("o_totalprice", 250000.0), "o_orderkey, o_totalprice", "o_totalprice >= 250000"),
    ("btree_range_lt", "orders", Filter.lt("o_totalprice", 20000.0), "o_orderkey, o_totalprice", "o_totalprice < 20000"),
    ("btree_range_lte", "part", Filter.lte("p_size", 3), "*", "p_size <= 3"),
    ("filter_contains", "documents", Filter.contains("text", "the"), "doc_id, lang", "contains(text, 'the')"),
    ("filter_and", "customer", Filter.and_(Filter.eq("c_mktsegment", "BUILDING"), Filter.gt("c_acctbal", 5000.0)), "*", "c_mktsegment = 'BUILDING' AND c_acctbal > 5000"),
    ("filter_or", "documents", Filter.or_(Filter.eq("lang", "en"), Filter.eq("lang", "fr")), "doc_id, lang", "lang = 'en' OR lang = 'fr'"),
    (
        "filter_nested", "documents",
        Filter.and_(Filter.or_(Filter.eq("lang", "en"), Filter.and_(Filter.eq("lang", "de"), Filter.lt("n_chars", 500))), Filter.gte("n_chars", 100)),
        "doc_id, lang, n_chars", "(lang = 'en' OR (lang = 'de' AND n_chars < 500)) AND n_chars >= 100",
    ),
    ("filter_empty_and", "nation", Filter.and_(), "*", "TRUE"),
    ("filter_empty_or", "nation", Filter.or_(), "*", "FALSE"),
    ("filter_type_mismatch", "part", Filter.eq("p_size", 15.0), "*", "FALSE"),
    ("filter_unknown_field", "part", Filter.eq("nothing", 1), "*", "FALSE"),
    (
        "residual_filter", "customer", Filter.and_(Filter.eq("c_mktsegment", "MACHINERY"), Filter.gte("c_acctbal", 1000.0), Filter.lt("c_acctbal", 2000.0)),
        "*", "c_mktsegment = 'MACHINERY' AND c_acctbal >= 1000 AND c_acctbal < 2000",
    ),
]
for _name, _table, _where, _cols, _cond in _FILTERS:
    _simple(_name, _table, f"SELECT {_cols} FROM {_table} WHERE {_cond}", lambda t, w=_where, c=_cols: _q("t", w).on(t).select(*c.split(", ")))

_simple(
    "filter_contains_bytes", "documents", "SELECT doc_id FROM documents WHERE contains(text, 'the')",
    lambda t: _q("documents", Filter.contains("raw", b"the")).on(t.withColumn("raw", F.col("text").cast("binary"))).select("doc_id"),
)
_simple("key_prefix", "part", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'blue')", lambda t: live.prefix_watch(t.withColumn("key", F.col("p_name")), "blue").select("p_partkey", "p_name"))
_simple(
    "scoped_keys", "customer", "SELECT 'customer:' || c_custkey AS key FROM customer ",
    lambda t: t.select(clocks.scoped_key("customer", F.col("c_custkey")).alias("key")).union(t.select(clocks.scoped_key("other", F.col("c_custkey")))).filter(clocks.in_scope(F.col("key"), "customer")),
)


@_add("filter_missing_field", "SELECT d.doc_id, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality = 1")
def _missing(spark: SparkSession, d: str) -> DataFrame:
    return _q("documents", Filter.eq("quality", 1)).on(_Tables(spark, d).labelled()).select("doc_id", "quality")


@_add("filter_is_null", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NULL")
def _null(spark: SparkSession, d: str) -> DataFrame:
    return _q("documents", Filter.eq("quality", None)).on(_Tables(spark, d).labelled()).select("doc_id")


# -- sort, offset, limit

_LABELLED = "documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
for _name, _sort, _by in (("sort_asc_missing_last", Sort.asc("quality"), "quality ASC NULLS LAST"), ("sort_desc_missing_first", Sort.desc("quality"), "quality DESC NULLS FIRST")):
    _add(_name, f"SELECT d.doc_id, quality, row_number() OVER (ORDER BY {_by}, d.doc_id) AS place FROM {_LABELLED}")(
        lambda spark, d, s=_sort: _q("documents").sort(s).ranked(_Tables(spark, d).labelled()).select("doc_id", "quality", "place")
    )
_add("ranked_offset_limit", f"SELECT * FROM (SELECT d.doc_id, quality, row_number() OVER (ORDER BY quality ASC NULLS LAST, d.doc_id) - 5 AS place FROM {_LABELLED}) WHERE place BETWEEN 1 AND 50")(
    lambda spark, d: _q("documents").limit(50).offset(5).sort(Sort.asc("quality")).ranked(_Tables(spark, d).labelled()).select("doc_id", "quality", "place")
)
_simple(
    "offset_limit", "customer", "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40",
    lambda t: _q("customer").limit(20).offset(40).sort(Sort.asc("c_name")).on(t, "c_custkey").select("c_custkey", "c_name"),
)
_simple("offset_beyond", "nation", "SELECT * FROM nation ORDER BY n_name OFFSET 1000", lambda t: _q("nation").offset(1000).sort(Sort.asc("n_name")).on(t, "n_nationkey"))
_simple("limit_zero", "nation", "SELECT * FROM nation LIMIT 0", lambda t: _q("nation").limit(0).on(t))


@_add(
    "filter_sort_offset_limit",
    "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 1000 ORDER BY n_chars DESC NULLS FIRST, doc_id LIMIT 20 OFFSET 5",
)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """English documents of 1,000 characters or more, the longest first."""
    q = _q("documents", Filter.and_(Filter.eq("lang", "en"), Filter.gte("n_chars", 1000))).sort(Sort.desc("n_chars")).offset(5).limit(20)
    return q.on(_Tables(spark, d).documents).select("doc_id", "lang", "source", "n_chars")


# -- differences

_OLD = "SELECT o_orderkey AS doc_id, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 3"
_NEW = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 4"


def _replicas(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _Tables(spark, d).orders.select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus", "o_totalprice")
    new = rows.withColumn("o_orderstatus", F.when(F.col("doc_id") % 5 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")))
    return rows.filter("doc_id % 7 <> 3"), new.filter("doc_id % 11 <> 4")


_DIFF = f"""SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'updated' END AS _change,
 coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN o.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus,
 coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON n.doc_id = o.doc_id
 WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.o_totalprice IS DISTINCT FROM n.o_totalprice"""
_add("query_diff", _DIFF)(lambda spark, d: diff.query_diff(*_replicas(spark, d)))
for _kind in ("added", "updated", "removed"):
    _add(f"diff_{_kind}", f"SELECT * FROM ({_DIFF}) WHERE _change = '{_kind}'")(lambda spark, d, k=_kind: diff.query_diff(*_replicas(spark, d)).filter(F.col("_change") == k))

# -- versions, merges, tables

_VERSIONS = "SELECT user_id AS key, event_id AS _seq, props AS value, event_type = 'error' AS is_tombstone FROM events"
_LAST = f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY _seq DESC) AS r FROM ({_VERSIONS})) WHERE r = 1"


_TEXT = "printf('%012d', key) AS key"


def _store(spark: SparkSession, d: str, **config: int) -> Store:
    """A new store with the versions in three commits, older ones first."""
    v = _Tables(spark, d).versions()
    last = v.agg(F.max("_seq")).first()[0] or 0
    store = Store.open(spark, scratch(spark), Config(**config))
    for low, high in ((0, last // 5), (last // 5, last * 7 // 10), (last * 7 // 10, last + 1)):
        part = v.filter((F.col("_seq") >= low) & (F.col("_seq") < high))
        store.write(part.select(F.format_string("%012d", "key").alias("key"), "value", "is_tombstone", "_seq"), order="_seq")
    return store


def _read(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) if c in ("key", "value") else F.col(c) for c in columns))


_add("kv_latest_wins", f"SELECT {_TEXT}, value FROM ({_LAST}) WHERE NOT is_tombstone")(lambda spark, d: _read(_store(spark, d).view(), "key", "value"))
_add("kv_delete_tombstones", f"SELECT {_TEXT} FROM ({_LAST}) WHERE is_tombstone")(lambda spark, d: _read(_store(spark, d).view(tombstones=True).filter("is_tombstone"), "key"))


@_add("kv_get", f"SELECT a.key AS key, value FROM (VALUES (7), (8), (9), (12), (-1)) a(key) LEFT JOIN (SELECT key, value FROM ({_LAST}) WHERE NOT is_tombstone) l ON l.key = a.key")
def _get(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark, d)
    got = [(k, store.get(f"{k:012d}")) for k in (7, 8, 9, 12, -1)]
    return spark.createDataFrame([(k, None if v is None else v.decode()) for k, v in got], "key int, value string")


@_add("kv_put_delete", "SELECT printf('n%03d', n_nationkey) AS key, CASE WHEN n_nationkey % 4 = 1 THEN 'again' ELSE n_name END AS value FROM nation WHERE n_nationkey % 3 <> 0")
def _put(spark: SparkSession, d: str) -> DataFrame:
    """Single writes, one after the other, some of which a flush cuts off, read by a store that is opened anew."""
    path, rows = scratch(spark), _Tables(spark, d).nation.collect()
    store = Store.open(spark, path)
    for i, r in enumerate(rows):
        store.put(f"n{r['n_nationkey']:03d}", r["n_name"])
        if i == len(rows) // 2:
            store.flush()
    for r in rows:
        if r["n_nationkey"] % 3 == 0:
            store.delete(f"n{r['n_nationkey']:03d}")
        elif r["n_nationkey"] % 4 == 1:
            store.put(f"n{r['n_nationkey']:03d}", "again")
    return _read(Store.open(spark, path).view(), "key", "value")


def _logged(spark: SparkSession, d: str) -> Store:
    """A store opened on the log that another one has left behind: customers' names, in their keys' order."""
    path = scratch(spark)
    rows = _Tables(spark, d).customer.select("c_custkey", "c_name").orderBy("c_custkey")
    Store.open(spark, path, Config(flush_bytes=1 << 40)).put_all((f"{r['c_custkey']:012d}", r["c_name"]) for r in rows.toLocalIterator())
    return Store.open(spark, path, Config(flush_bytes=1 << 40))


_add("store_recover", "SELECT printf('%012d', c_custkey) AS key, c_name AS value FROM customer")(lambda spark, d: _read(_logged(spark, d).view(), "key", "value"))
_add("wal_replay_order", "SELECT row_number() OVER (ORDER BY c_custkey) AS place, row_number() OVER (ORDER BY c_custkey) AS seq, printf('%012d', c_custkey) AS key, c_name AS value FROM customer")(
    lambda spark, d: _read(_logged(spark, d).log_entries(), "place", "seq", "key", "value")
)


@_add(
    "store_flush",
    """SELECT 0::INT AS level, printf('%012d', min(c_custkey)) AS smallest, printf('%012d', max(c_custkey)) AS largest, count(*) AS entries, count(*) AS sequence,
 count(*) AS pending_before, 0::BIGINT AS pending_after FROM customer""",
)
def _flushed(spark: SparkSession, d: str) -> DataFrame:
    store = _logged(spark, d)
    before = len(store.pending)
    store.flush()
    hexed = lambda c: F.unhex(c).cast("string").alias(c)
    now = (F.lit(n).cast("long").alias(a) for n, a in ((store.sequence, "sequence"), (before, "pending_before"), (len(store.pending), "pending_after")))
    return store.manifest().select("level", hexed("smallest"), hexed("largest"), "entries", *now)


def _orders_store(spark: SparkSession, d: str) -> Store:
    store, o = Store.open(spark, scratch(spark)), _Tables(spark, d).orders
    key = F.format_string("%012d", F.col("o_orderkey"))
    store.write(o.select(key.alias("key"), F.col("o_orderstatus").alias("value")))
    store.write(o.filter("o_orderkey % 10 = 0").select(key.alias("key"), F.lit("").alias("value"), F.lit(True).alias("is_tombstone")))
    return store


_add(
    "kv_range_scan",
    "SELECT printf('%012d', o_orderkey) AS key, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE o_orderstatus END AS value, o_orderkey % 10 = 0 AS is_tombstone FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000",
)(lambda spark, d: _read(_orders_store(spark, d).scan(f"{100:012d}", f"{5000:012d}"), "key", "value", "is_tombstone"))
_add(
    "sstable_full_scan",
    "SELECT printf('%012d', o_orderkey) AS key, o_orderstatus AS value, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_orderkey % 10 <> 0",
)(lambda spark, d: _read(numbered(_orders_store(spark, d).view(), F.col("key")), "key", "value", "place"))


@_add("compact_merge", f"SELECT {_TEXT}, value, is_tombstone, 1::INT AS level FROM ({_LAST})")
def _compact(spark: SparkSession, d: str) -> DataFrame:
    """The one table that compaction leaves."""
    store = _store(spark, d, level_threshold=3)
    store.compact()
    table = store.tables_at_level(1)[0]
    rows = spark.read.parquet(store.files.at(table.path))
    return _read(rows.withColumn("level", F.lit(table.level)), "key", "value", "is_tombstone", "level")


@_add("compaction_stats", f"SELECT count(*) AS entries, 3::BIGINT AS tables_merged, 1::BIGINT AS tables_written, 0::BIGINT AS tables_left, 3::BIGINT AS files_kept FROM ({_LAST})")
def _compaction(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark, d, level_threshold=3)
    old = store.tables_at_level(0)
    stats = store.run_if_idle()
    kept = sum(store.files.exists(t.path) for t in old)
    row = (sum(t.entries for t in store.tables()), stats.tables_merged, stats.tables_written, len(store.tables_at_level(0)), kept)
    return spark.createDataFrame([row], "entries long, tables_merged long, tables_written long, tables_left long, files_kept long")


@_add(
    "manifest_tables",
    f"""WITH v AS (SELECT *, (SELECT max(event_id) FROM events) AS last FROM ({_VERSIONS}))
 SELECT CASE WHEN _seq < last // 5 THEN 1 WHEN _seq < last * 7 // 10 THEN 2 ELSE 3 END::BIGINT AS id, 0::INT AS level, printf('%012d', min(key)) AS smallest,
 printf('%012d', max(key)) AS largest, count(DISTINCT key) AS entries FROM v GROUP BY 1 HAVING id <> 2""",
)
def _manifest(spark: SparkSession, d: str) -> DataFrame:
    """The tables of the three commits without the second, which is taken out."""
    store = _store(spark, d)
    store.remove_table(2)
    hexed = lambda c: F.unhex(c).cast("string").alias(c)
    return store.manifest().select("id", "level", hexed("smallest"), hexed("largest"), "entries")


_simple(
    "sstable_stats", "documents", "SELECT source, min(doc_id) AS smallest_key, max(doc_id) AS largest_key, count(*) AS entry_count FROM documents GROUP BY source",
    lambda t: merge.table_stats(t, "doc_id", ["source"]),
)
_simple(
    "level_counts", "documents", "SELECT (doc_id % 7)::INT AS level, count(*) AS tables, count(*) >= 4 AS needs_compaction FROM documents GROUP BY 1",
    lambda t: merge.level_counts(t.select((F.col("doc_id") % 7).cast("int").alias("level"))),
)


@_add("store_bloom", "SELECT c_custkey, EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = a.c_custkey) AS may_contain FROM (VALUES (3::BIGINT), (77), (140), (-1), (1099511627776), (-77)) a(c_custkey)")
def _bloom(spark: SparkSession, d: str) -> DataFrame:
    """One half of the keys by the executors, the other inserted by hand or merged; asked after encoding and decoding."""
    c = _Tables(spark, d).customer.select("c_custkey")
    n = c.count()
    bloom = indexes.Bloom.of(c.filter("c_custkey % 2 = 0"), "c_custkey", n, 1e-6)
    bloom.merge(indexes.Bloom.of(c.filter("c_custkey % 2 = 1 and c_custkey <> 77"), "c_custkey", n, 1e-6))
    if c.filter("c_custkey = 77").count():
        bloom.insert(77)
    bloom = indexes.Bloom.decode(spark, bloom.encode())
    return spark.createDataFrame([(k, bloom.may_contain(k)) for k in (3, 77, 140, -1, 1 << 40, -77)], "c_custkey long, may_contain boolean")


# -- keys, clocks, indexes

_simple(
    "index_key_int", "customer", "SELECT c_custkey, printf('%016x', (c_custkey::HUGEINT + 9223372036854775808)::UBIGINT) AS key FROM customer",
    lambda t: t.select("c_custkey", clocks.int_key(F.col("c_custkey")).alias("key")),
)
_add("index_key_float", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS place FROM customer")(
    lambda spark, d: numbered(_Tables(spark, d).customer.select("c_custkey", clocks.float_key(F.col("c_acctbal")).alias("key")), F.col("key"), F.col("c_custkey")).select("c_custkey", "place")
)
_simple("index_key_bool", "customer", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN '01' ELSE '00' END AS key FROM customer", lambda t: t.select("c_custkey", clocks.bool_key(F.col("c_acctbal") > 0).alias("key")))
_simple("index_key_bytes", "nation", "SELECT n_nationkey, lower(hex(n_name)) AS key FROM nation", lambda t: t.select("n_nationkey", clocks.bytes_key(F.col("n_name").cast("binary")).alias("key")))
_simple("index_entries", "orders", "SELECT DISTINCT o_custkey AS key, o_orderkey AS doc_id FROM orders", lambda t: indexes.index_entries(t, "o_custkey", "o_orderkey"))
_simple("index_entry_count", "orders", "SELECT count(DISTINCT (o_orderpriority, o_custkey)) AS entry_count FROM orders", lambda t: indexes.entry_count(t, "o_orderpriority", "o_custkey"))
_simple("index_lookup_sorted", "orders", "SELECT DISTINCT o_orderkey AS doc_id FROM orders WHERE o_custkey = 7", lambda t: indexes.lookup(t, "o_custkey", 7, "o_orderkey"))
_simple(
    "index_range_sorted", "orders", "SELECT *, row_number() OVER (ORDER BY key, doc_id) AS place FROM (SELECT DISTINCT o_custkey AS key, o_orderkey AS doc_id FROM orders WHERE o_custkey > 10 AND o_custkey <= 30)",
    lambda t: numbered(indexes.range_lookup(t, "o_custkey", 10, 30, low_inclusive=False, key="o_orderkey"), F.col("key"), F.col("doc_id")),
)
_simple(
    "index_remove", "orders", "SELECT DISTINCT o_custkey AS key, o_orderkey AS doc_id FROM orders WHERE o_orderkey % 3 <> 0",
    lambda t: indexes.remove_entries(indexes.index_entries(t, "o_custkey", "o_orderkey"), indexes.index_entries(t.filter("o_orderkey % 3 = 0"), "o_custkey", "o_orderkey")),
)
_simple(
    "index_add", "orders", "SELECT DISTINCT o_custkey AS key, o_orderkey AS doc_id FROM orders",
    lambda t: indexes.add_entries(indexes.index_entries(t.filter("o_orderkey % 3 <> 0"), "o_custkey", "o_orderkey"), indexes.index_entries(t.filter("o_orderkey % 2 = 0 or o_orderkey % 3 = 0"), "o_custkey", "o_orderkey")),
)
_simple(
    "index_removed", "orders", "SELECT DISTINCT CASE WHEN o_orderkey % 7 = 0 THEN -1 - o_custkey ELSE o_custkey END AS key, o_orderkey AS doc_id, o_orderkey % 7 <> 0 AS was_there FROM orders WHERE o_orderkey % 3 = 0",
    lambda t: indexes.removed(
        indexes.index_entries(t, "o_custkey", "o_orderkey"),
        indexes.index_entries(t.filter("o_orderkey % 3 = 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 == 0, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey"))), "o_custkey", "o_orderkey"),
    ),
)


@_add(
    "access_paths",
    """SELECT * FROM (SELECT unnest(['eq', 'range', 'both', 'unindexed', 'hash_range', 'or']) AS name, unnest(['hash', 'range', 'hash', 'full', 'full', 'full']) AS strategy,
 unnest([1, n // 3, 1, n, n, n])::BIGINT AS cost, unnest([1, 1, 2, 1, 1, 0])::BIGINT AS conditions FROM (SELECT count(*) AS n FROM customer))""",
)
def _paths(spark: SparkSession, d: str) -> DataFrame:
    """What the access-path model takes for filters over customers with a hash and a tree index."""
    n = _Tables(spark, d).customer.count()
    found = [IndexInfo("c_mktsegment", IndexKind.Hash, n), IndexInfo("c_acctbal", IndexKind.BTree, n)]
    eq, more = Filter.eq("c_mktsegment", "BUILDING"), Filter.gt("c_acctbal", 0.0)
    asked = {"eq": eq, "range": more, "both": Filter.and_(more, eq), "unindexed": Filter.eq("c_name", "x"), "hash_range": Filter.gt("c_mktsegment", "C"), "or": Filter.or_(eq, more)}
    rows = [(name, p.strategy, p.cost, len(list(f.conjuncts()))) for name, f in asked.items() for p in [access_path(_q("customer", f), found, n)]]
    return spark.createDataFrame(rows, "name string, strategy string, cost long, conditions long")


_WRITES = "SELECT user_id AS doc_id, event_id, event_type, props AS value, epoch_us(ts) // 1000 AS physical, (event_id % 3)::INT AS logical, event_id % 7 AS device FROM events"
_add("hlc_order", f"SELECT event_id, physical, logical, row_number() OVER (ORDER BY physical DESC, logical DESC, event_id DESC) AS place FROM ({_WRITES})")(
    lambda spark, d: numbered(_Tables(spark, d).writes(), clocks.hlc(F.col("physical"), F.col("logical")).desc(), F.desc("event_id")).select("event_id", "physical", "logical", "place")
)
# -- replicated values


@_add("lww_merge", f"SELECT doc_id, value, physical, logical, device FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY physical DESC, logical DESC, device DESC, value DESC) AS r FROM ({_WRITES})) WHERE r = 1")
def _lww(spark: SparkSession, d: str) -> DataFrame:
    return crdt.lww_merge(_Tables(spark, d).writes().withColumn("tie", F.col("value")), ["doc_id"], clock=(*crdt.CLOCK, "tie")).drop("tie")


def _counters(spark: SparkSession, d: str, side: int) -> DataFrame:
    e = _Tables(spark, d).events.filter(F.col("event_id") % 2 == side)
    return e.groupBy(F.col("user_id").alias("doc_id"), (F.col("event_id") % 7).alias("device")).agg(F.sum(F.col("event_id") % 5 - 1).alias("delta"))


def _side(n: int) -> str:
    return f"SELECT user_id AS doc_id, event_id % 7 AS device, sum(event_id % 5 - 1)::BIGINT AS delta FROM events WHERE event_id % 2 = {n} GROUP BY 1, 2"


_TWO = f"""SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, coalesce(l.device, r.device) AS device,
 CASE WHEN r.doc_id IS NULL THEN l.delta ELSE greatest(coalesce(l.delta, 0), r.delta) END AS delta
 FROM ({_side(0)}) l FULL JOIN ({_side(1)}) r ON l.doc_id = r.doc_id AND l.device = r.device"""
_add("counter_two_way", _TWO)(lambda spark, d: crdt.counter_join(_counters(spark, d, 0), _counters(spark, d, 1), ["doc_id"]))
_add("counter_value", f"SELECT doc_id, sum(delta)::BIGINT AS value FROM ({_TWO}) GROUP BY doc_id")(
    lambda spark, d: crdt.counter_value(crdt.counter_join(_counters(spark, d, 0), _counters(spark, d, 1), ["doc_id"]), ["doc_id"])
)


def _totals(spark: SparkSession, d: str) -> DataFrame:
    e = _Tables(spark, d).events
    return e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 7).alias("device"), (F.col("event_id") % 11).alias("delta"))


_GROUP_MAX = "SELECT user_id AS doc_id, event_id % 7 AS device, max(event_id % 11) AS delta FROM events GROUP BY 1, 2"
_add("counter_merge_value", f"SELECT doc_id, sum(delta)::BIGINT AS value FROM ({_GROUP_MAX}) GROUP BY doc_id")(lambda spark, d: crdt.counter_value(crdt.counter_merge(_totals(spark, d), ["doc_id"]), ["doc_id"]))
_add("counter_device_delta", f"SELECT coalesce(max(delta), 0)::BIGINT AS delta FROM ({_GROUP_MAX}) WHERE doc_id = 5 AND device = 3")(
    lambda spark, d: crdt.device_delta(crdt.counter_merge(_totals(spark, d), ["doc_id"]).filter("doc_id = 5"), 3)
)
_add("counter_increment", f"SELECT doc_id, device, sum(delta)::BIGINT AS delta FROM (SELECT * FROM ({_side(0)}) UNION ALL SELECT user_id, event_id % 7, -(event_id % 4) FROM events) GROUP BY 1, 2")(
    lambda spark, d: crdt.counter_add(_counters(spark, d, 0), _Tables(spark, d).events.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 7).alias("device"), (-(F.col("event_id") % 4)).alias("delta")), ["doc_id"])
)


def _tags(spark: SparkSession, d: str, side: int | None = None) -> DataFrame:
    t = _Tables(spark, d).writes()
    t = t if side is None else t.filter(F.col("event_id") % 2 == side)
    return t.select("doc_id", F.col("event_type").alias("element"), "device", F.lit(0).cast("long").alias("physical"), "logical")


_TAGS = f"SELECT DISTINCT doc_id, event_type AS element, device, 0::BIGINT AS physical, logical FROM ({_WRITES})"
_add("orset_merge_tags", _TAGS)(lambda spark, d: crdt.orset_merge(_tags(spark, d, 0), _tags(spark, d, 1)))
_add("orset_elements", f"SELECT DISTINCT doc_id, element FROM ({_TAGS})")(lambda spark, d: crdt.orset_elements(_tags(spark, d), ["doc_id"]))
_add("orset_size", f"SELECT doc_id, count(DISTINCT element) AS size FROM ({_TAGS}) GROUP BY doc_id")(lambda spark, d: crdt.orset_size(_tags(spark, d), ["doc_id"]))
_add("orset_contains", f"SELECT doc_id, bool_or(element = 'error') AS contains FROM ({_TAGS}) GROUP BY doc_id")(lambda spark, d: crdt.orset_contains(_tags(spark, d), ["doc_id"], "error"))
_add(
    "orset_remove",
    f"SELECT * FROM ({_TAGS}) t WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = t.doc_id AND e.event_type = t.element AND e.event_id % 10 = 0)",
)(lambda spark, d: crdt.orset_remove(crdt.orset_merge(_tags(spark, d)), _Tables(spark, d).writes().filter("event_id % 10 = 0").withColumnRenamed("event_type", "element"), ["doc_id"]))


def _registers(spark: SparkSession, d: str, side: int) -> DataFrame:
    w = _Tables(spark, d).writes().filter(F.col("event_id") % 2 == side).withColumn("device", F.col("event_id"))
    return crdt.lww_merge(w, ["doc_id"])


def _register(side: int) -> str:
    return f"SELECT doc_id, value, physical, logical, event_id AS device FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY physical DESC, logical DESC, event_id DESC) AS r FROM ({_WRITES}) WHERE event_id % 2 = {side}) WHERE r = 1"


_MERGED = f"SELECT doc_id, value, physical, logical, device FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY physical DESC, logical DESC, device DESC) AS r FROM (SELECT * FROM ({_register(0)}) UNION ALL SELECT * FROM ({_register(1)}))) WHERE r = 1"
_TAKEN = "SELECT * FROM ({b}) UNION ALL SELECT * FROM ({a}) l WHERE NOT EXISTS (SELECT 1 FROM ({b}) r WHERE r.doc_id = l.doc_id)"
for _mode in SyncAuthority:
    _remote = _mode is SyncAuthority.RemoteAuthority
    _suffix = {"LocalFirst": "local", "RemoteAuthority": "remote", "RemoteFirst": "remote_first"}[_mode.value]
    _add(f"authority_resolve_lww_{_suffix}", _TAKEN.format(a=_register(0), b=_register(1)) if _remote else _MERGED)(
        lambda spark, d, m=_mode: crdt.resolve_lww(_registers(spark, d, 0), _registers(spark, d, 1), ["doc_id"], m)
    )
_add("authority_resolve_counter", _TAKEN.format(a=_side(0), b=_side(1)))(
    lambda spark, d: crdt.resolve_counter(_counters(spark, d, 0), _counters(spark, d, 1), ["doc_id"], SyncAuthority.RemoteAuthority)
)
_HALF = "SELECT DISTINCT doc_id, event_type AS element, device, 0::BIGINT AS physical, logical FROM ({w}) WHERE event_id % 2 = {n} AND doc_id % 3 <> {n}"
_add("authority_resolve_orset", _TAKEN.format(a=_HALF.format(w=_WRITES, n=0), b=_HALF.format(w=_WRITES, n=1)))(
    lambda spark, d: crdt.resolve_orset(
        _tags(spark, d, 0).filter("doc_id % 3 <> 0").distinct(), _tags(spark, d, 1).filter("doc_id % 3 <> 1").distinct(), ["doc_id"], SyncAuthority.RemoteAuthority
    )
)

# -- transactions, schemas, live queries, replayed as batches


_ORDERS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("status", T.StringType())])
_CHANGED = "SELECT o_orderkey AS doc_id, 'P' AS status, row_number() OVER (ORDER BY o_orderkey) + (SELECT count(*) FROM orders) AS _version FROM orders WHERE o_orderkey % 6 = 0"
_FIRST = "SELECT o_orderkey AS doc_id, o_orderstatus AS status, row_number() OVER (ORDER BY o_orderkey) AS _version FROM orders"
_NOW = f"SELECT * FROM (SELECT * FROM ({_FIRST}) WHERE doc_id % 6 <> 0 UNION ALL SELECT * FROM ({_CHANGED})) WHERE doc_id % 9 <> 0"


def _versioned(spark: SparkSession, d: str) -> VersionedStore:
    """All orders, then new versions of each sixth, then each ninth deleted."""
    store, o = VersionedStore(spark, scratch(spark), _ORDERS), _Tables(spark, d).orders
    o = o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"))
    store.insert(o)
    store.insert(o.filter("doc_id % 6 = 0").withColumn("status", F.lit("P")))
    store.remove(o.filter("doc_id % 9 = 0"))
    return store


_add("txn_apply", _NOW)(lambda spark, d: _versioned(spark, d).documents())


@_add("txn_compact", f"SELECT *, 1::INT AS tables FROM ({_NOW})")
def _txn_compact(spark: SparkSession, d: str) -> DataFrame:
    store = _versioned(spark, d)
    store.compact()
    return store.documents().withColumn("tables", F.lit(len(store._state()[1]["tables"])))


@_add(
    "txn_conflicts",
    f"""SELECT r.doc_id, r._version AS read_version, coalesce(n._version, 0) AS current_version FROM (SELECT * FROM ({_FIRST}) WHERE doc_id % 5 = 0) r
 LEFT JOIN ({_NOW}) n ON n.doc_id = r.doc_id WHERE r._version <> coalesce(n._version, 0)""",
)
def _conflicts(spark: SparkSession, d: str) -> DataFrame:
    """What a transaction that has read each fifth order at the beginning would have to be told."""
    store = _versioned(spark, d)
    first = store.documents(store._state()[1]["tables"][:1]).filter("doc_id % 5 = 0")
    return store.conflicts(first.select("doc_id", F.col("_version").alias("read_version")))


@_add(
    "txn_nations",
    """SELECT n_nationkey::BIGINT AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN 'X' ELSE n_name END AS status,
 CASE WHEN n_nationkey % 2 = 0 THEN (SELECT count(*) FROM nation) + row_number() OVER (PARTITION BY n_nationkey % 2, n_nationkey % 5 = 0 ORDER BY n_nationkey) ELSE n_nationkey + 1 END AS _version,
 TRUE AS refused, 2::BIGINT AS refused_id, 0::BIGINT AS pending FROM nation WHERE n_nationkey % 5 <> 0""",
)
def _transactions(spark: SparkSession, d: str) -> DataFrame:
    """A transaction that writes, one that had read what it changes, and one that is rolled back."""
    store = VersionedStore(spark, scratch(spark), _ORDERS)
    store.insert(_Tables(spark, d).nation.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.col("n_name").alias("status")))
    ids = [r["doc_id"] for r in store.documents().select("doc_id").orderBy("doc_id").collect()]
    one, late, never = store.begin(), store.begin(), store.begin()
    late.read(2)
    late.put({"doc_id": 3, "status": "late"})
    never.delete(1)
    never.rollback()
    one.put_batch({"doc_id": i, "status": "X"} for i in ids if i % 2 == 0 and i % 5)
    for i in ids:
        if i % 5 == 0:
            one.delete(i)
    one.commit()
    try:
        late.commit()
        refused = None
    except Conflict as e:
        refused = e.doc_id
    pending = sum(not t.is_active for t in (one, late, never)) - 3
    return store.documents().withColumns({"refused": F.lit(refused is not None), "refused_id": F.lit(refused).cast("long"), "pending": F.lit(pending).cast("long")})


_KINDS = {"BIGINT": "Int", "INTEGER": "Int", "DOUBLE": "Float", "VARCHAR": "String", "BOOLEAN": "Bool", "BLOB": "Bytes"}
_COLUMNS = "SELECT column_name AS field, CASE data_type {} ELSE 'Collection' END AS type FROM duckdb_columns() WHERE table_name = '{{}}'".format(" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()))


@_add("schema_fields", f"SELECT field, type, CASE WHEN type = 'Collection' THEN 'OrSet' ELSE 'Lww' END AS hint, FALSE AS required FROM ({_COLUMNS.format('embeddings')} UNION ALL {_COLUMNS.format('customer')})")
def _fields(spark: SparkSession, d: str) -> DataFrame:
    t = _Tables(spark, d)
    found = [SchemaBuilder.of(n, df.schema).build() for n, df in (("embeddings", t.embeddings), ("customer", t.customer))]
    return spark.createDataFrame([(f.name, f.type.name, f.hint.name, f.required) for s in found for f in s.fields], "field string, type string, hint string, required boolean")


_PAIRS = (("documents", "benchmark"), ("labels", "conversations"), ("embeddings", "labels"), ("customer", "customer"))


@_add(
    "schema_evolution",
    " UNION ALL ".join(
        f"""SELECT '{o}' AS old, '{n}' AS new, change, field FROM (SELECT 'removed' AS change, a.field FROM ({_COLUMNS.format(o)}) a ANTI JOIN ({_COLUMNS.format(n)}) b ON a.field = b.field
 UNION ALL SELECT 'type', a.field FROM ({_COLUMNS.format(o)}) a JOIN ({_COLUMNS.format(n)}) b ON a.field = b.field AND a.type <> b.type
 UNION ALL SELECT 'new', a.field FROM ({_COLUMNS.format(n)}) a ANTI JOIN ({_COLUMNS.format(o)}) b ON a.field = b.field)"""
        for o, n in _PAIRS
    ),
)
def _evolution(spark: SparkSession, d: str) -> DataFrame:
    """What would change if one table's schema took the place of another's."""
    schema = lambda n: SchemaBuilder.of("t", getattr(_Tables(spark, d), n).schema).build()
    rows = []
    for old, new in _PAIRS:
        e = evolution(schema(old), schema(new))
        rows += [(old, new, c.kind, c.field) for c in e.breaking] + [(old, new, "new", f) for f in e.new_fields]
    return spark.createDataFrame(rows, "old string, new string, change string, field string")


def _log(spark: SparkSession, events: DataFrame) -> live.ChangeLog:
    """A log of the events, as updates of their users in a collection named by the event's type."""
    log = live.ChangeLog(spark, scratch(spark))
    log.publish_all(_updates(events), "event_id")
    return log


def _updates(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("collection"), F.col("user_id").alias("doc_id"), F.lit("update").alias("mutation_type"), F.lit("local").alias("origin"), "event_id")


def _followed(stream: DataFrame) -> DataFrame:
    """What a stream gives until it has caught up."""
    out, spark = scratch(stream.sparkSession), stream.sparkSession
    stream.writeStream.format("parquet").option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


_EVENTS = "SELECT event_type AS collection, user_id AS doc_id, row_number() OVER (ORDER BY event_id) AS seq FROM events"
_add("live_collection_filter", f"SELECT doc_id, seq FROM ({_EVENTS}) WHERE collection = 'click'")(
    lambda spark, d: _followed(_log(spark, _Tables(spark, d).events).subscribe("click", replay=True)).select("doc_id", "seq")
)


@_add("live_no_replay", f"SELECT * FROM ({_EVENTS}) WHERE seq > (SELECT count(*) FROM events WHERE event_id % 2 = 0)".replace("ORDER BY event_id", "ORDER BY event_id % 2, event_id"))
def _later(spark: SparkSession, d: str) -> DataFrame:
    """Who subscribes to a log sees what is published from then on."""
    e = _Tables(spark, d).events
    log = _log(spark, e.filter("event_id % 2 = 0"))
    stream = log.subscribe()
    log.publish_all(_updates(e.filter("event_id % 2 = 1")), "event_id")
    return _followed(stream).select("collection", "doc_id", "seq")


_AT = "SELECT doc_id, value FROM (SELECT user_id AS doc_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE {n}) WHERE r = 1 AND event_type <> 'error' AND value >= 50"
_A, _B = _AT.format(n="event_id < (SELECT max(event_id) // 2 FROM events)"), _AT.format(n="TRUE")


@_add(
    "live_diff_replay",
    f"""SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'updated' END AS _change, coalesce(n.doc_id, o.doc_id) AS doc_id,
 CASE WHEN n.doc_id IS NULL THEN o.value ELSE n.value END AS value FROM ({_A}) o FULL JOIN ({_B}) n ON n.doc_id = o.doc_id
 WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.value IS DISTINCT FROM n.value""",
)
def _live(spark: SparkSession, d: str) -> DataFrame:
    """A live query over users' latest events, which are those of the first half when it starts and all later."""
    e = _Tables(spark, d).events.select(F.col("user_id").alias("doc_id"), "event_id", "value", "event_type")
    half = e.agg(F.max("event_id")).first()[0] // 2
    seen, out = [F.col("event_id") < half], []
    source = lambda: merge.latest(e.filter(seen[-1]), ["doc_id"], ["event_id"]).filter("event_type <> 'error'").select("doc_id", "value")
    log = live.ChangeLog(spark, scratch(spark))
    query = live.LiveQuery(log, _q("users", Filter.gte("value", 50.0)), source, scratch(spark), lambda diff: out.append(saved(diff)))
    stream = query.start(interval="0 seconds")
    try:
        seen.append(F.lit(True))
        log.publish([live.Event.update("users", 0)])
        stream.processAllAvailable()
    finally:
        stream.stop()
    return out[0] if out else diff.query_diff(*[_q("users").on(source())] * 2)


@_add("live_incremental", f"SELECT 'added' AS _change, doc_id, value FROM ({_B})")
def _incremental(spark: SparkSession, d: str) -> DataFrame:
    """The same result kept by a stream of versions, each user's state apart."""
    e = _Tables(spark, d).events.select(F.col("user_id").alias("doc_id"), "value", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("is_tombstone"))
    path = scratch(spark)
    e.write.parquet(path)
    return _followed(filtered_changes(spark.readStream.schema(e.schema).parquet(path), Filter.gte("value", 50.0)))


@_add("watch_prefix", "SELECT 'user:' || user_id AS key, event_id AS seq FROM events WHERE starts_with('user:' || user_id, 'user:1')")
def _watched(spark: SparkSession, d: str) -> DataFrame:
    """The changes of keys with a prefix, as a stream."""
    return _followed(live.prefix_watch(_changes(spark, d), "user:1")).select("key", "seq")


@_add("watch_collection", "SELECT 'user:' || user_id AS key, event_id AS seq FROM events WHERE event_id % 2 = 0")
def _watched_all(spark: SparkSession, d: str) -> DataFrame:
    return _followed(live.collection_watch(_changes(spark, d), "user")).filter("seq % 2 = 0").select("key", "seq")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    e, path = _Tables(spark, d).events, scratch(spark)
    rows = lambda c: e.select(clocks.scoped_key(c, F.col("user_id")).alias("key"), F.col("props").alias("value"), F.lit(False).alias("is_tombstone"), F.col("event_id").alias("seq"))
    rows("user").union(rows("other")).write.parquet(path)
    return spark.readStream.schema(live.CHANGES).parquet(path)


@_add("filter_dynamic", "SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 1000")
def _dynamic(spark: SparkSession, d: str) -> DataFrame:
    """Documents as maps of tagged values."""
    none = {k: F.lit(None).cast(t) for k, t in (("s", "string"), ("i", "long"), ("f", "double"), ("b", "boolean"), ("x", "binary"))}
    tagged = lambda tag, slot, c: F.struct(F.lit(tag).alias("tag"), *((c if k == slot else v).alias(k) for k, v in none.items()))
    docs = _Tables(spark, d).documents
    docs = docs.select("doc_id", F.create_map(F.lit("lang"), tagged("string", "s", F.col("lang")), F.lit("n_chars"), tagged("int", "i", F.col("n_chars"))).alias("fields"))
    return _q("documents", Filter.and_(Filter.eq("lang", "en"), Filter.gt("n_chars", 1000), Filter.or_(Filter.eq("lang", "en"), Filter.eq("n_chars", 1.0)))).on(docs).select("doc_id")


def queries() -> dict[str, Run]:
    return dict(_RUNS)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

