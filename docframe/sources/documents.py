"""Versioned documents on Parquet, and optimistic transactions over them.

Every put has a version, numbered over the whole table. A commit appends the rows it has staged as one table; the
current documents are the latest rows of each id that aren't deletions. compact() makes one table of them; the files
of the old ones stay for snapshots that still read them, until vacuum().
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from time import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AlreadyFinalised, CommitConflict, Conflict
from ..operators.merge import latest
from .files import Commits, Files

VERSION = "_version"


class VersionedStore:
    """schema: the documents' columns, doc_id among them."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.schema = spark, schema
        self.files = Files(spark, path)
        self.commits = Commits(self.files)
        extra = T.StructType.fromDDL(f"{VERSION} long, _deleted boolean, _commit long")
        self.stored = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields] + extra.fields)

    def _state(self) -> tuple[int, dict[str, Any]]:
        last = self.commits.last()
        return (last.number, last.state) if last else (0, {"version": 0, "tables": [], "gone": []})

    def rows(self, tables: list[str] | None = None) -> DataFrame:
        """All versions of all documents."""
        tables = self._state()[1]["tables"] if tables is None else tables
        if not tables:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*map(self.files.at, tables))

    def documents(self, tables: list[str] | None = None) -> DataFrame:
        """The current documents, with their versions."""
        now = latest(self.rows(tables), ["doc_id"], ["_commit", VERSION])
        return now.filter("not _deleted").select(*self.schema.names, VERSION)

    def get(self, doc_id: int) -> tuple[dict[str, Any], int] | None:
        """The document and its version."""
        row = latest(self.rows().filter(F.col("doc_id") == doc_id), ["doc_id"], ["_commit", VERSION]).filter("not _deleted").first()
        return None if row is None else ({n: row[n] for n in self.schema.names}, row[VERSION])

    def versions_of(self, ids: Iterable[int], tables: list[str] | None = None) -> dict[int, int]:
        """Current versions, 0 for ids without a document. For the few ids of a transaction."""
        wanted = list(ids)
        rows = self.rows(tables).filter(F.col("doc_id").isin(wanted)).select("doc_id", VERSION, "_deleted", "_commit")
        found = {r["doc_id"]: r[VERSION] for r in latest(rows, ["doc_id"], ["_commit", VERSION]).filter("not _deleted").collect()}
        return {i: found.get(i, 0) for i in wanted}

    def count(self) -> int:
        return self.documents().count()

    def conflicts(self, read_set: DataFrame, tables: list[str] | None = None) -> DataFrame:
        """Rows of read_set (doc_id, read_version) whose document has another version now."""
        return conflicts(read_set, self.documents(tables))

    def insert(self, documents: DataFrame) -> None:
        """Put many documents as one commit; each gets a version of its own, by ascending doc_id. Of rows with one doc_id
        the greatest counts, its columns compared one after the other."""
        number, state = self._state()
        rest = [n for n in self.schema.names if n != "doc_id"]
        rows = documents.select(*self.schema.names)
        rows = latest(rows, ["doc_id"], rest) if rest else rows.distinct()
        # versions number the rows partition by partition, without bringing them together
        rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("_n", F.monotonically_increasing_id())
        path = f"data/{uuid.uuid4().hex}-raw"
        rows.write.parquet(self.files.at(path))
        raw = self.spark.read.schema(T.StructType([*self.stored.fields[: len(self.schema.names)], T.StructField("_n", T.LongType())])).parquet(self.files.at(path))
        part = F.shiftright("_n", 33)
        sizes = sorted((r["p"], r["c"]) for r in raw.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect())
        before, total = [], 0
        for p, c in sizes:
            before.append((p, total))
            total += c
        starts = self.spark.createDataFrame(before or [(0, 0)], "_p long, _before long")
        version = F.col("_before") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(state["version"] + 1)
        out = raw.withColumn("_p", part.cast("long")).join(F.broadcast(starts), "_p").withColumn(VERSION, version)
        self._append(number, state, out, total)
        self.files.delete(path)

    def remove(self, ids: DataFrame) -> None:
        """Delete many documents (a column doc_id) as one commit."""
        number, state = self._state()
        rows = ids.select(*(F.col(n) if n == "doc_id" else F.lit(None).cast(self.schema[n].dataType).alias(n) for n in self.schema.names))
        self._append(number, state, rows.withColumn(VERSION, F.lit(0).cast("long")).withColumn("_deleted", F.lit(True)), 0)

    def compact(self) -> int:
        """Make one table of the current documents; returns how many there were. Fails if somebody commits meanwhile."""
        number, state = self._state()
        if len(state["tables"]) < 2:
            return len(state["tables"])
        now = latest(self.rows(state["tables"]), ["doc_id"], ["_commit", VERSION]).filter("not _deleted")
        path = f"data/{uuid.uuid4().hex}"
        now.select(*self.stored.names).write.parquet(self.files.at(path))
        self.commits.make(number, {"version": state["version"], "tables": [path], "gone": [*state["gone"], *([t, time()] for t in state["tables"])]})
        return len(state["tables"])

    def vacuum(self, older_than: float = 3600.0) -> int:
        """Delete the files of tables that no commit has named for so many seconds."""
        number, state = self._state()
        old = [g for g in state["gone"] if g[1] <= time() - older_than]
        if old:
            self.commits.make(number, state | {"gone": [g for g in state["gone"] if g not in old]})
        for path, _ in old:
            self.files.delete(path)
        return len(old)

    def _append(self, number: int, state: dict[str, Any], rows: DataFrame, puts: int) -> None:
        if "_deleted" not in rows.columns:
            rows = rows.withColumn("_deleted", F.lit(False))
        path = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_commit", F.lit(number + 1).cast("long")).select(*self.stored.names).write.parquet(self.files.at(path))
        self.commits.make(number, state | {"version": state["version"] + puts, "tables": [*state["tables"], path]})

    def begin(self) -> Transaction:
        return Transaction(self)


class Transaction:
    """Reads come from the snapshot at its beginning and its own writes; nothing is seen by others before commit."""

    def __init__(self, store: VersionedStore):
        self.store = store
        self._tables = store._state()[1]["tables"]
        self._read: dict[int, int] = {}
        self._puts: dict[int, Mapping[str, Any]] = {}
        self._deletes: set[int] = set()
        self._active = True

    def _check(self) -> None:
        if not self._active:
            raise AlreadyFinalised

    def read(self, doc_id: int) -> dict[str, Any] | None:
        """Own writes first; else the document of the snapshot, whose version is then asked for at commit."""
        self._check()
        if doc_id in self._deletes:
            return None
        if doc_id in self._puts:
            return dict(self._puts[doc_id])
        row = self.store.documents(self._tables).filter(F.col("doc_id") == doc_id).first()
        self._read.setdefault(doc_id, 0 if row is None else row[VERSION])
        return None if row is None else {n: row[n] for n in self.store.schema.names}

    def put(self, document: Mapping[str, Any]) -> None:
        self._check()
        self._deletes.discard(document["doc_id"])
        self._puts[document["doc_id"]] = dict(document)

    def put_batch(self, documents: Iterable[Mapping[str, Any]]) -> None:
        for d in documents:
            self.put(d)

    def delete(self, doc_id: int) -> None:
        self._check()
        self._puts.pop(doc_id, None)
        self._deletes.add(doc_id)

    def commit(self) -> None:
        """All or nothing. Raises Conflict if a document that was read has another version by now; documents that
        were written without being read never conflict."""
        self._check()
        self._active = False
        while True:
            number, state = self.store._state()
            if self._read:
                read = self.store.spark.createDataFrame(sorted(self._read.items()), "doc_id long, read_version long")
                first = self.store.conflicts(read, state["tables"]).orderBy("doc_id").first()
                if first:
                    raise Conflict(*first)
            if not self._puts and not self._deletes:
                return
            names = self.store.schema.names
            rows = [(*(d.get(n) for n in names), state["version"] + i, False) for i, d in enumerate(self._puts.values(), 1)]
            rows += [(*(i if n == "doc_id" else None for n in names), 0, True) for i in sorted(self._deletes)]
            kinds = T.StructType(self.store.stored.fields[: len(names) + 2])
            try:
                self.store._append(number, state, self.store.spark.createDataFrame(rows, kinds).coalesce(1), len(self._puts))
                return
            except CommitConflict:
                continue  # somebody else was first: validate again

    def rollback(self) -> None:
        self._check()
        self._active = False

    @property
    def is_active(self) -> bool:
        return self._active

    @property
    def pending_writes(self) -> int:
        return len(self._puts)

    @property
    def pending_deletes(self) -> int:
        return len(self._deletes)


def conflicts(read_set: DataFrame, current: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of read_set (key, read_version) whose current version is another one (0 if there is none)."""
    now = read_set.join(current.select(key, F.col(VERSION).alias("current_version")), key, "left")
    now = now.withColumn("current_version", F.coalesce("current_version", F.lit(0)))
    return now.filter("read_version <> current_version").select(key, "read_version", "current_version")


def applied(documents: DataFrame, puts: DataFrame, deletes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents after puts and then deletes."""
    kept = documents.join(puts.select(key), key, "left_anti").unionByName(puts.select(*documents.columns))
    return kept.join(deletes.select(key), key, "left_anti")
