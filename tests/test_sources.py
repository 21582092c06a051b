"""The store, versioned documents with transactions, and live queries."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe import Filter, Query, Sort
from docframe.errors import AlreadyFinalised, ClosedError, CommitConflict, Conflict, LogError, ManifestError, StorageError
from docframe.operators import crdt
from docframe.operators.ranks import numbered
from docframe.plans.schema import SyncAuthority
from docframe.protocols import DocumentSource, Mergeable, Runner
from docframe.sources.documents import VersionedStore, applied, conflicts
from docframe.sources.files import Commits, Files, scratch
from docframe.sources.store import Collection, Config, Store
from docframe.streaming.incremental import filtered_changes
from docframe.streaming.live import CHANGES, ChangeLog, Event, LiveQuery, collection_watch, prefix_watch


def test_put_get_delete_reopen(spark, tmp_path):
    path = str(tmp_path / "db")
    s = Store.open(spark, path)
    assert s.get("a") is None
    s.put("a", "1")
    s.put(b"b", b"")
    s.delete("never")
    assert s.get("a") == b"1" and s.get("b") == b"" and s.sequence == 3
    reader = Store.open(spark, path, write=False)
    assert reader.get("a") == b"1" and [(r["place"], bytes(r["key"])) for r in reader.log_entries().collect()] == [(1, b"a"), (2, b"b"), (3, b"never")]
    with pytest.raises(StorageError):
        reader.put("a", "x")
    s.put("a", "1")  # a reader takes nothing over
    again = Store.open(spark, path)  # the log brings back what wasn't flushed
    assert again.get("a") == b"1" and again.sequence == 4 and (len(again.pending), again.pending.is_empty, again.pending.should_flush(5)) == (3, False, True)
    again.flush()
    again.flush()
    assert len(again.tables()) == 1 and again.files.names("_wal") == []
    again.put("a", "2")
    again.delete("b")
    again.close()
    again.close()
    with pytest.raises(ClosedError):
        again.get("a")
    last = Store.open(spark, path)
    assert last.get("a") == b"2" and last.get("b") is None and len(last.tables_at_level(0)) == 2
    assert [bytes(r["key"]) for r in last.scan("a").collect()] == [b"a", b"b", b"never"]
    assert [bytes(r["key"]) for r in last.scan("a", "b").collect()] == [b"a"]
    assert last.view().count() == 1 and last.view(tombstones=True).count() == 3
    t = last.tables()[0]
    assert (t.entries, bytes.fromhex(t.smallest), bytes.fromhex(t.largest)) == (3, b"a", b"never") and last.manifest().count() == 2


def test_bulk_writes_and_compaction(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "db"), Config(level_threshold=3, flush_bytes=40))
    rows = lambda n, v: spark.range(n).select(F.format_string("key-%05d", "id").alias("key"), F.lit(v).alias("value"))
    s.write(rows(50, "old"))
    assert s.compact().levels_compacted == 0
    s.write(rows(20, "new"))
    s.write(rows(10, "").withColumn("is_tombstone", F.lit(True)))
    before = sorted((bytes(r["key"]), bytes(r["value"])) for r in s.view().collect())
    stats = s.compact()
    assert (stats.levels_compacted, stats.tables_merged, stats.tables_written, stats.tables_deleted) == (1, 3, 1, 3)
    assert len(s.tables_at_level(1)) == 1 and s.tables_at_level(0) == [] and s.tables()[0].entries == 50  # tombstones stay
    assert sorted((bytes(r["key"]), bytes(r["value"])) for r in s.view().collect()) == before
    assert s.get("key-00005") is None and s.get("key-00015") == b"new" and s.get("key-00045") == b"old"
    s.write(spark.createDataFrame([("dup", "1", 1), ("dup", "2", 2)], "key string, value string, at int"), order="at")
    assert s.get("dup") == b"2"
    s.put("x" * 30, "y" * 30)  # enough to be flushed
    assert not s.files.names("_wal")


def test_no_task_sorts_a_whole_table(spark, tmp_path):
    """However little they take compressed, and with fewer shuffle partitions than pieces, rows of a table are sorted in pieces."""
    setting = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    s = Store.open(spark, str(tmp_path / "db"), Config(level_threshold=2, sort_bytes=4 << 20))
    rows = spark.range(200_000).select(F.sha1(F.col("id").cast("string")).alias("key"), F.lit("O").alias("value"))
    again = rows.filter("key < '1'").withColumn("value", F.lit("P"))
    s.write(rows.union(again))
    s.write(rows.filter("key >= 'fff'").withColumn("is_tombstone", F.lit(True)))

    def pieces(t):
        files = spark.read.parquet(s.files.at(t.path)).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("z")).collect()
        return sorted((bytes(r["a"]), bytes(r["z"]), r["n"]) for r in files)

    def sorted_in_pieces(t):
        found = pieces(t)
        assert sum(n for _, _, n in found) == t.entries == 200_000 and max(n for _, _, n in found) * 201 < 3 * (4 << 20)
        assert all(before[1] < after[0] for before, after in zip(found, found[1:]))

    large, small = s.tables()
    sorted_in_pieces(large)
    assert len(pieces(small)) == 1  # what fits in a piece is one file
    s.compact()
    sorted_in_pieces(*s.tables())
    assert s.view().count() == rows.filter("key < 'fff'").count() and s.view().filter("value = cast('P' as binary)").count() == again.count()
    assert setting == {k: spark.conf.get(k) for k in setting}


def test_a_table_is_read_in_pieces(spark, tmp_path):
    """A full scan's tasks can't divide a row group, so a table isn't one."""
    s = Store.open(spark, str(tmp_path / "db"), Config(sort_bytes=4 << 20))
    rows = spark.range(200_000).select(F.sha1(F.col("id").cast("string")).alias("key"), F.lit("O").alias("value"))
    s.write(rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        tasks = [r["count"] for r in s.versions().groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sum(tasks) == 200_000 and max(tasks) * 201 < 3 * (4 << 20)
    placed = numbered(s.view(), F.col("key")).select(F.col("key").cast("string").alias("key"), "place").filter("place % 20000 = 1").collect()
    in_order = sorted(r["key"] for r in rows.collect())
    assert sorted((r["place"], r["key"]) for r in placed) == [(i + 1, in_order[i]) for i in range(0, 200_000, 20_000)]


def test_store_errors(spark, tmp_path):
    path = str(tmp_path / "db")
    a = Store.open(spark, path)
    a.put("k", "v")
    (name,) = a.files.names("_wal")
    log = tmp_path / "db" / "_wal" / name
    text = log.read_text()
    log.write_text(text.replace("6b", "6c"))
    with pytest.raises(LogError):
        Store.open(spark, path, write=False)
    log.write_text(text + text[:20])  # a torn line at the end was never acknowledged
    b = Store.open(spark, path)
    assert b.get("k") == b"v"
    b.put("k", "b")
    b.flush()
    with pytest.raises(StorageError):
        a.put("more", "x")
    with pytest.raises(CommitConflict):
        a.flush()
    with pytest.raises(ManifestError):
        b.remove_table(99)
    b.files.delete(b.tables()[0].path)
    with pytest.raises(ManifestError):
        b.get("k")
    b.remove_table(b.tables()[0].id)
    assert b.get("k") is None


def test_two_writers(spark, tmp_path):
    """Nothing that was acknowledged is lost, whoever flushes what."""
    path = str(tmp_path / "db")
    a = Store.open(spark, path)
    a.put("k1", "a")
    b = Store.open(spark, path)
    b.put("k2", "b")
    assert b.get("k1") == b"a"
    with pytest.raises(StorageError):  # what it was told to write may or may not count
        a.put("k3", "a")
    c = Store.open(spark, path)
    c.put("k4", "c")
    c.flush()
    with pytest.raises(CommitConflict):
        b.flush()
    last = Store.open(spark, path)
    assert [last.get(k) for k in ("k1", "k2", "k4")] == [b"a", b"b", b"c"] and last.pending.is_empty


def test_flush_that_dies_before_it_clears_the_log(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "db")
    a = Store.open(spark, path)
    a.put("k", "old")
    with monkeypatch.context() as m:
        m.setattr(a.files, "delete", lambda name: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            a.flush()
    b = Store.open(spark, path)
    assert b.pending.is_empty and b.get("k") == b"old" and b.files.names("_wal") == []


def test_commits(spark, tmp_path):
    files = Files(spark, str(tmp_path / "c"))
    chain = Commits(files)
    chain.KEEP = 5
    assert chain.last() is None
    for i in range(12):
        chain.make(i, {"n": i})
    assert chain.last().state == {"n": 11} and len(files.names("_commits")) == 5
    for late in (11, 3, 0):  # made by another one, lately or so long ago that it was cleared
        with pytest.raises(CommitConflict):
            chain.make(late, {})
    assert chain.last().number == 12 and all(n.endswith(".json") for n in files.names("_commits"))
    files.create("x", "whole")  # a part that a crash has left behind blocks nothing
    files.delete("x")
    assert files.create("x", "again") and not files.create("x", "twice") and files.read("x") == "again"


def test_compaction_under_a_reader(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "db"), Config(level_threshold=2))
    for v in ("1", "2"):
        s.write(spark.createDataFrame([("a", v), ("b", v)], "key string, value string"))
    reader = s.view()
    assert s.run_if_idle().tables_merged == 2
    assert sorted(bytes(r["value"]) for r in reader.collect()) == [b"2", b"2"]
    assert s.vacuum() == 0 and s.vacuum(older_than=0) == 2 and s.view().count() == 2
    s.put("c", "3")
    s.write(spark.createDataFrame([("d", "1"), ("d", "2")], "key string, value string"))
    assert s.get("d") == b"2" and s.compact().levels_compacted == 1


def test_collections_and_watches(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "db"))
    users, seen = Collection(s, "user"), []
    users.put(1, {"name": "Alice"})
    users.put(12, {"name": "Bob"})
    s.put("other:1", "x")
    stop = users.observe_all(seen.append)
    assert users.get(1) == {"name": "Alice"} and users.get(2) is None
    assert sorted(r["id"] for r in users.documents().collect()) == ["1", "12"]
    assert users.delete(12) == {"name": "Bob"} and users.delete(99) is None
    s.put("other:2", "y")
    stop()
    users.put(3, {})
    assert set(seen[0]) == {"user:1", "user:12"} and seen[1:] == [{"user:12": None}, {"user:99": None}]


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("name", T.StringType())])


@pytest.fixture
def versioned(spark, tmp_path):
    v = VersionedStore(spark, str(tmp_path / "docs"), SCHEMA)
    v.insert(spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, "Charlie")], SCHEMA))
    return v


def test_versions(versioned):
    assert sorted((r["doc_id"], r["_version"]) for r in versioned.documents().collect()) == [(1, 1), (2, 2), (3, 3)]
    assert versioned.get(2) == ({"doc_id": 2, "name": "Bob"}, 2) and versioned.get(9) is None
    assert versioned.versions_of([1, 9]) == {1: 1, 9: 0} and versioned.count() == 3


def test_transactions(versioned):
    t = versioned.begin()
    assert t.read(1)["name"] == "Alice" and t.read(9) is None
    t.put({"doc_id": 1, "name": "Ann"})
    t.delete(2)
    t.put_batch([{"doc_id": 4, "name": "Dan"}, {"doc_id": 5, "name": "Eve"}])
    t.delete(5)
    assert (t.pending_writes, t.pending_deletes, t.is_active) == (2, 2, True)
    assert t.read(1)["name"] == "Ann" and t.read(2) is None and versioned.count() == 3
    t.commit()
    assert not t.is_active
    assert sorted(tuple(r) for r in versioned.documents().collect()) == [(1, "Ann", 4), (3, "Charlie", 3), (4, "Dan", 5)]
    with pytest.raises(AlreadyFinalised):
        t.commit()


def test_versioned_compaction(spark, versioned):
    versioned.insert(spark.createDataFrame([(2, "B"), (2, "A"), (5, "E")], SCHEMA))
    versioned.remove(spark.createDataFrame([(1,)], "doc_id long"))
    assert sorted(tuple(r) for r in versioned.documents().collect()) == [(2, "B", 4), (3, "Charlie", 3), (5, "E", 5)]
    t = versioned.begin()
    assert versioned.compact() == 3 and versioned.compact() == 1
    assert t.read(1) is None and t.read(2)["name"] == "B"
    t.commit()
    assert sorted(tuple(r) for r in versioned.documents().collect()) == [(2, "B", 4), (3, "Charlie", 3), (5, "E", 5)]
    assert versioned.vacuum() == 0 and versioned.vacuum(0) == 3 and versioned.count() == 3
    versioned.insert(spark.createDataFrame([(7, "G")], SCHEMA))
    assert versioned.get(7)[1] == 6


def test_numbers_of_events(spark, tmp_path):
    """Two publishers of one log share no number; a log that is far behind lags."""
    a, b = (ChangeLog(spark, str(tmp_path / "log"), capacity=3) for _ in range(2))
    a.publish([Event.insert("x", 1), Event.insert("x", 2)])
    b.publish([Event.insert("x", 3)])
    a.publish_all(spark.createDataFrame([("x", 5, "insert", "local", 9), ("x", 4, "insert", "local", 1)], "collection string, doc_id long, mutation_type string, origin string, o int"), "o")
    got = sorted((r["seq"], r["doc_id"]) for r in spark.read.parquet(a.path).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)] and b.last == 5 and b.lags(1) and not b.lags(2)


def test_protocols(spark, tmp_path):
    class Longest:
        def merge(self, local, remote, keys):
            return local.unionByName(remote).groupBy(*keys).agg(F.max_by("value", F.length("value")).alias("value"))

    class Runs:
        def run(self, query):
            return query.on(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA))

    assert isinstance(Longest(), Mergeable) and isinstance(Runs(), Runner) and not isinstance(Longest(), Runner)
    old, new = (spark.createDataFrame(r, "doc_id long, value string") for r in ([(1, "aaa"), (2, "b")], [(1, "a"), (3, "c")]))
    got = lambda mode: sorted(map(tuple, crdt.resolve(Longest(), old, new, ["doc_id"], mode).collect()))
    assert got(SyncAuthority.LocalFirst) == [(1, "aaa"), (2, "b"), (3, "c")] and got(SyncAuthority.RemoteAuthority) == [(1, "a"), (2, "b"), (3, "c")]
    live = LiveQuery(ChangeLog(spark, str(tmp_path / "log")), Query.collection("users").filter(Filter.eq("name", "b")), Runs(), str(tmp_path / "live"), print)
    assert [r["doc_id"] for r in live._run()[1].collect()] == [2]
    assert isinstance(versioned_store(spark, tmp_path), DocumentSource)


def versioned_store(spark, tmp_path):
    return VersionedStore(spark, str(tmp_path / "v"), SCHEMA)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(StorageError):
        scratch(Session())
    Context.master = "local[4]"
    assert scratch(Session()).startswith("/")


def test_conflicts(versioned):
    a, b, c, d = (versioned.begin() for _ in range(4))
    a.read(1)
    b.read(1)
    d.read(7)
    a.put({"doc_id": 1, "name": "A"})
    a.put({"doc_id": 7, "name": "G"})
    b.put({"doc_id": 1, "name": "B"})
    c.put({"doc_id": 1, "name": "blind"})
    a.commit()
    with pytest.raises(Conflict) as e:
        b.commit()
    assert (e.value.doc_id, e.value.read_version, e.value.current_version) == (1, 1, 4)
    with pytest.raises(Conflict):
        d.commit()
    c.commit()  # wrote without reading
    assert versioned.get(1)[0]["name"] == "blind"
    r = versioned.begin()
    r.delete(3)
    r.rollback()
    assert versioned.get(3) is not None
    r = versioned.begin()
    r.read(3)
    r.commit()


def test_reads_see_the_snapshot(versioned):
    a, b = versioned.begin(), versioned.begin()
    b.put({"doc_id": 2, "name": "late"})
    b.commit()
    assert a.read(2)["name"] == "Bob"
    with pytest.raises(Conflict):
        a.commit()


def test_transactions_as_tables(spark):
    now = spark.createDataFrame([(1, 4), (2, 1)], "doc_id long, _version long")
    read = spark.createDataFrame([(1, 3), (2, 1), (3, 0), (4, 2)], "doc_id long, read_version long")
    assert sorted(map(tuple, conflicts(read, now).collect())) == [(1, 3, 4), (4, 2, 0)]
    docs = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    got = applied(docs, spark.createDataFrame([(2, "B"), (3, "C")], SCHEMA), spark.createDataFrame([(1,), (9,)], "doc_id long"))
    assert sorted(map(tuple, got.collect())) == [(2, "B"), (3, "C")]


def test_live_query(spark, tmp_path):
    log, docs, out = ChangeLog(spark, str(tmp_path / "log")), {}, []
    docs.update({1: ("a", 30), 2: ("b", 20)})
    source = lambda: spark.createDataFrame([(i, *v) for i, v in docs.items()], "doc_id long, name string, age int")
    log.publish([Event.insert("users", 1)])  # before anybody listens
    q = Query.collection("users").filter(Filter.gte("age", 18)).sort(Sort.asc("age")).limit(3)
    live = LiveQuery(log, q, source, str(tmp_path / "live"), lambda d: out.append([(r["_change"], r["doc_id"]) for r in d.collect()]))
    stream = live.start(interval="0 seconds")
    try:
        stream.processAllAvailable()
        assert out == []
        docs.update({3: ("c", 40), 1: ("A", 30)})
        del docs[2]
        log.publish([Event.insert("users", 3), Event.update("users", 1), Event.delete("users", 2, "remote")])
        stream.processAllAvailable()
        assert out == [[("added", 3), ("removed", 2), ("updated", 1)]]
        log.publish([Event.update("orders", 1), Event.update("users", 3)])  # another collection; nothing has changed
        stream.processAllAvailable()
        assert len(out) == 1 and log.subscriber_count == 1
    finally:
        stream.stop()


def test_watches_as_streams(spark, tmp_path):
    path = str(tmp_path / "changes")
    spark.createDataFrame([("user:1", "a", False, 1), ("user:12", None, True, 2), ("order:1", "b", False, 3)], CHANGES).write.parquet(path)
    stream = spark.readStream.schema(CHANGES).parquet(path)
    for name, df in (("w1", prefix_watch(stream, "user:")), ("w2", collection_watch(stream, "user", 1)), ("w3", collection_watch(stream, "order"))):
        q = df.writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
    got = {n: sorted(r["key"] for r in spark.table(n).collect()) for n in ("w1", "w2", "w3")}
    assert got == {"w1": ["user:1", "user:12"], "w2": ["user:1"], "w3": ["order:1"]}


def test_incremental_changes(spark, tmp_path):
    kind = "doc_id long, name string, age int, seq long, is_tombstone boolean"
    batches = [
        [(1, "a", 30, 1, False), (2, "b", 10, 2, False), (3, None, 40, 3, False)],
        [(1, "a", 31, 4, False), (2, "b", 20, 5, False), (3, None, 40, 6, False)],
        [(1, "a", 5, 8, False), (1, "a", 50, 7, False), (2, None, None, 9, True), (4, "d", 1, 10, False), (3, "late", 99, 2, False)],
    ]
    path, out = str(tmp_path / "versions"), []
    spark.createDataFrame([], kind).write.parquet(path)
    stream = filtered_changes(spark.readStream.schema(kind).parquet(path), Filter.gte("age", 18))
    for rows in batches:
        spark.createDataFrame(rows, kind).write.mode("append").parquet(path)
        seen = []
        q = stream.writeStream.foreachBatch(lambda df, _, seen=seen: seen.extend(sorted(map(tuple, df.collect())))).trigger(availableNow=True)
        q.option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
        out.append(seen)
    assert out == [[("added", 1, "a", 30), ("added", 3, None, 40)], [("added", 2, "b", 20), ("updated", 1, "a", 31)], [("removed", 1, "a", 31), ("removed", 2, "b", 20)]]
