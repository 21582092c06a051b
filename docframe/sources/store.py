"""A key-value store as a log of mutations on Parquet.

Writes are rows with a sequence number; a deletion is a row too. Tables of rows lie on levels, new ones on level
0; a commit names the tables that count, so readers see whole commits. Reads take the latest row of each key.
Compaction rewrites a level's tables as one on the next; the old files stay for a while, for readers that still
name them. Single puts are kept in a write-ahead log, one append-only file of their writer, until they are flushed;
bulk writes (write) go to a table of their own and are the way to load data.

One writer at a time: a store that is opened for writing takes over the logs that it finds by renaming them. A writer
looks for its log after each append, so what it has acknowledged was there to be taken over, and it fails from then on.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field
from time import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ClosedError, LogError, ManifestError, StorageError
from ..functions.clocks import Hlc
from ..operators.merge import key_range, latest, live
from .files import Commits, Files, Log

SCHEMA = "key binary, value binary, is_tombstone boolean, _seq long, physical long, logical int"
_ORDER = ["_seq"]
_ROW_BYTES = 160  # what a sort holds in memory for a row besides its key and value


@dataclass(frozen=True)
class Table:
    id: int
    level: int
    path: str
    smallest: str
    largest: str
    entries: int
    bytes: int


@dataclass(frozen=True)
class Config:
    """Pending bytes that make a flush, tables of a level that make a compaction, levels, bytes of a row group (what a
    reader takes or skips at once) and of a file, at most, for how long files that no commit names are kept, and bytes of
    memory that one task should sort, which bounds a file too."""

    flush_bytes: int = 4 << 20
    level_threshold: int = 4
    levels: int = 7
    block_bytes: int = 128 << 20
    file_bytes: int = 1 << 30
    retention_seconds: float = 3600.0
    sort_bytes: int = 256 << 20


@dataclass
class CompactionStats:
    levels_compacted: int = 0
    tables_merged: int = 0
    tables_written: int = 0
    tables_deleted: int = 0


@dataclass
class Pending:
    """Writes that aren't in a table yet, the latest of each key."""

    rows: dict[bytes, tuple[bytes | None, int, Hlc]] = field(default_factory=dict)
    size: int = 0

    def __len__(self) -> int:
        return len(self.rows)

    @property
    def is_empty(self) -> bool:
        return not self.rows

    def should_flush(self, limit: int) -> bool:
        return self.size >= limit

    def add(self, key: bytes, value: bytes | None, seq: int, clock: Hlc) -> None:
        if key in self.rows:
            self.size -= len(key) + len(self.rows[key][0] or b"")
        self.rows[key] = (value, seq, clock)
        self.size += len(key) + len(value or b"")

    def drained(self) -> list[tuple]:
        """Rows of SCHEMA, by key."""
        return [(k, v, v is None, seq, h.physical, h.logical) for k, (v, seq, h) in sorted(self.rows.items())]


def _raw(x: bytes | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


class Store:
    """Open one with Store.open."""

    def __init__(self, spark: SparkSession, path: str, config: Config, device: int):
        self.spark, self.config, self.device = spark, config, device
        self.files = Files(spark, path)
        self.commits = Commits(self.files)
        self.clock, self._sequence, self._closed, self._writes = Hlc(), 0, False, True
        self._log: Log | None = None
        self._logs: list[str] = []  # whose entries are pending
        self.pending, self._watchers = Pending(), {}

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config = Config(), device: int = 0, write: bool = True) -> Store:
        """The store in the folder, with what its write-ahead logs still hold. Without write, nothing is taken over."""
        s = cls(spark, path, config, device)
        s._writes = write
        found = s.files.names("_wal")
        s._load(s.commits.last())
        for name in sorted(n for n in found if n.endswith((".log", ".taken"))):
            if name in s._done:  # flushed, but not deleted before a crash
                if write:
                    s.files.delete(f"_wal/{name}")
                continue
            if write and name.endswith(".log"):
                if not s.files.rename(f"_wal/{name}", f"_wal/{name}.taken"):
                    continue  # somebody else was faster
                name += ".taken"
            s._logs.append(name)
        for e in sorted((e for name in s._logs for e in s._replay(name)), key=lambda e: e[:5]):
            seq, clock, key, value = e[0], Hlc(e[1], e[2]), e[4], e[5]
            s._take(key, value, seq, clock)
        return s

    def _load(self, last: Any) -> None:
        self._number, state = (last.number, last.state) if last else (0, {"sequence": 0, "clock": [0, 0], "next": 1, "tables": [], "done": [], "gone": []})
        self._tables, self._next, self._done, self._gone = [Table(**t) for t in state["tables"]], state["next"], state["done"], state["gone"]
        self._sequence, self.clock = state["sequence"], Hlc(*state["clock"])

    # -- writing

    def put(self, key: bytes | str, value: bytes | str) -> None:
        self.put_all([(key, value)])

    def delete(self, key: bytes | str) -> None:
        """Deleting a key that isn't there is fine."""
        self.put_all([(key, None)])

    def put_all(self, items: Iterable[tuple[bytes | str, bytes | str | None]]) -> None:
        """Put (or, without a value, delete) one after the other, with one append to the log for all."""
        self._write()
        entries, seq, clock = [], self._sequence, self.clock
        for key, value in items:
            seq, clock = seq + 1, clock.advance()
            entries.append((_raw(key), None if value is None else _raw(value), seq, clock))
        if not entries:
            return
        if self._log is None:
            name = f"{uuid.uuid4().hex}.log"
            self._log = self.files.log(f"_wal/{name}")
            self._logs.append(name)
        self._log.add(*map(self._line, entries))
        for key, value, seq, clock in entries:
            self._take(key, value, seq, clock)
            for prefix, callback in list(self._watchers.values()):
                if key.startswith(prefix):
                    callback({key.decode(): None if value is None else value.decode()})
        if self.pending.should_flush(self.config.flush_bytes):
            self.flush()

    def write(self, rows: DataFrame, order: str | None = None) -> None:
        """Put all rows (key, value; is_tombstone if any are deletions) as one commit. Of equal keys the greatest
        `order` counts, without one the greatest value."""
        self._write()
        self.flush()
        if "is_tombstone" not in rows.columns:
            rows = rows.withColumn("is_tombstone", F.lit(False))
        by = F.col(order) if order else F.col("value")
        rows = rows.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "is_tombstone", by.alias("_order"))
        pieces = self._pieces(rows)
        rows = latest(rows, ["key"], ["_order"]).drop("_order")
        self.clock = self.clock.advance()
        self._sequence += 1  # the rows of a commit have different keys, so they can share a number
        rows = rows.select("key", "value", "is_tombstone", F.lit(self._sequence).cast("long").alias("_seq"), F.lit(self.clock.physical).cast("long").alias("physical"), F.lit(self.clock.logical).alias("logical"))
        table = self._save(rows, 0, pieces)
        self._commit([*self._tables, table] if table else self._tables)

    def flush(self) -> None:
        """Make a table of the pending writes; nothing happens without any."""
        self._write()
        if self.pending.is_empty:
            return
        rows = self.spark.createDataFrame(self.pending.drained(), SCHEMA)
        table = self._save(rows, 0, self._pieces(rows))
        self._commit([*self._tables, table], done=self._logs)
        if self._log:
            self._log.close()
        for name in self._logs:  # these and no others: their entries are in the table
            self.files.delete(f"_wal/{name}")
        self.pending, self._log, self._logs = Pending(), None, []

    def compact(self) -> CompactionStats:
        """Merge the tables of the first level that has enough of them into one on the next. Tombstones stay."""
        self._write()
        for level in range(self.config.levels - 1):
            old = self.tables_at_level(level)
            if len(old) >= self.config.level_threshold:
                rows = self._read(old)
                new = self._save(latest(rows, ["key"], _ORDER), level + 1, self._pieces(rows))
                self._commit([t for t in self._tables if t.level != level] + [new])
                self.vacuum()
                return CompactionStats(1, len(old), 1, len(old))
        return CompactionStats()

    def run_if_idle(self) -> CompactionStats:
        """Compact unless writes are pending."""
        return self.compact() if self.pending.is_empty else CompactionStats()

    def remove_table(self, number: int) -> None:
        """Take a table out of the store."""
        self._write()
        if number not in {t.id for t in self._tables}:
            raise ManifestError(f"no table has the number {number}")
        self._commit([t for t in self._tables if t.id != number])

    def vacuum(self, older_than: float | None = None) -> int:
        """Delete the files of tables that no commit has named for so many seconds; returns how many tables went."""
        self._write()
        before = time() - (self.config.retention_seconds if older_than is None else older_than)
        old = [g for g in self._gone if g[1] <= before]
        for path, _ in old:
            self.files.delete(path)
        if old:
            self._gone = [g for g in self._gone if g not in old]
            self._commit(self._tables)
        return len(old)

    def close(self) -> None:
        """Idempotent."""
        if not self._closed:
            if self._writes:
                self.flush()
            self._closed = True

    # -- reading

    def get(self, key: bytes | str) -> bytes | None:
        self._open()
        k = _raw(key)
        if k in self.pending.rows:
            return self.pending.rows[k][0]
        near = [t for t in self._tables if t.smallest <= k.hex() <= t.largest]
        if not near:
            return None
        row = self._read(near).filter(F.col("key") == F.lit(k)).agg(F.max_by(F.struct("value", "is_tombstone"), "_seq").alias("r")).first()["r"]
        return None if row is None or row["is_tombstone"] else bytes(row["value"])

    def versions(self) -> DataFrame:
        """All rows of all tables and of the pending writes."""
        self._open()
        return self._read(self._tables).unionByName(self.spark.createDataFrame(self.pending.drained(), SCHEMA))

    def view(self, tombstones: bool = False) -> DataFrame:
        """The latest row of each key, without the deleted ones if not asked for."""
        rows = latest(self.versions(), ["key"], _ORDER)
        return rows if tombstones else live(rows).select("key", "value")

    def scan(self, start: bytes | str, end: bytes | str | None = None) -> DataFrame:
        """Keys from start up to but not including end, ascending, with tombstones."""
        wanted = key_range(self.versions(), _raw(start), None if end is None else _raw(end))
        return latest(wanted, ["key"], _ORDER).orderBy("key")

    def log_entries(self) -> DataFrame:
        """(place, seq, key, value, physical, logical) of what the write-ahead logs hold, in the order of replay."""
        self._open()
        entries = sorted((e for name in self._logs for e in self._replay(name)), key=lambda e: e[:5])
        rows = [(i, seq, key, value, physical, logical) for i, (seq, physical, logical, _, key, value) in enumerate(entries, 1)]
        return self.spark.createDataFrame(rows, "place long, seq long, key binary, value binary, physical long, logical int")

    @property
    def sequence(self) -> int:
        return self._sequence

    @property
    def is_closed(self) -> bool:
        return self._closed

    @property
    def path(self) -> str:
        return self.files.root

    def tables(self) -> list[Table]:
        return list(self._tables)

    def tables_at_level(self, level: int) -> list[Table]:
        return [t for t in self._tables if t.level == level]

    def manifest(self) -> DataFrame:
        """A row for each table that counts."""
        schema = "id long, level int, path string, smallest string, largest string, entries long, bytes long"
        return self.spark.createDataFrame([tuple(asdict(t).values()) for t in self._tables], schema)

    # -- watching

    def watch(self, prefix: str, callback: Callable[[dict[str, str | None]], None]) -> Callable[[], None]:
        """Call back now with all keys that start with prefix, and with each later single write of one.

        Returns a function that ends this. For streams of changes see streaming.live.
        """
        rows = self.view().filter(F.startswith(F.col("key"), F.lit(prefix.encode()))).toLocalIterator()
        callback({bytes(r["key"]).decode(): bytes(r["value"]).decode() for r in rows})
        handle = uuid.uuid4()
        self._watchers[handle] = (prefix.encode(), callback)
        return lambda: self._watchers.pop(handle, None) and None

    # -- inside

    def _open(self) -> None:
        if self._closed:
            raise ClosedError("the store is closed")

    def _write(self) -> None:
        self._open()
        if not self._writes:
            raise StorageError("the store was opened for reading")

    def _take(self, key: bytes, value: bytes | None, seq: int, clock: Hlc) -> None:
        self.pending.add(key, value, seq, clock)
        self._sequence, self.clock = max(self._sequence, seq), max(self.clock, clock)

    def _line(self, entry: tuple[bytes, bytes | None, int, Hlc]) -> str:
        key, value, seq, clock = entry
        body = json.dumps([seq, clock.physical, clock.logical, self.device, key.hex(), None if value is None else value.hex()])
        return f"{zlib.crc32(body.encode()):08x}{body}"

    def _replay(self, name: str) -> Iterator[tuple]:
        """The entries of a log. A last line without an end was never acknowledged and doesn't count."""
        for line in self.files.read(f"_wal/{name}").split("\n")[:-1]:
            if f"{zlib.crc32(line[8:].encode()):08x}" != line[:8]:
                raise LogError(f"checksum mismatch in {name}")
            seq, physical, logical, device, key, value = json.loads(line[8:])
            yield seq, physical, logical, device, bytes.fromhex(key), None if value is None else bytes.fromhex(value)

    def _read(self, tables: list[Table]) -> DataFrame:
        missing = [t.path for t in tables if not self.files.exists(t.path)]
        if missing:
            raise ManifestError(f"files of {missing[0]} are missing")
        if not tables:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*(self.files.at(t.path) for t in tables))

    def _pieces(self, rows: DataFrame) -> tuple[int, int]:
        """How many tasks it takes to sort the rows with sort_bytes each, and the shuffled bytes that are a piece for one.

        Shuffled rows are taken to be compressed to a quarter, and small ones take many times their bytes in memory.
        """
        r = rows.agg(F.count("*").alias("n"), F.sum(F.length("key") + F.coalesce(F.length("value"), F.lit(0))).alias("b")).first()
        data = r["b"] or 0
        memory = max(data + r["n"] * _ROW_BYTES, 1)
        return -(-memory // self.config.sort_bytes), max(self.config.sort_bytes * data // (4 * memory), 1 << 20)

    def _save(self, rows: DataFrame, level: int, pieces: tuple[int, int]) -> Table | None:
        name = f"L{level}/{self._next:06d}-{uuid.uuid4().hex[:8]}"
        # adaptive execution joins small partitions up to a piece, so the number of partitions has to allow for all of them
        n, piece = pieces
        conf = self.spark.conf
        wanted = {
            "spark.sql.shuffle.partitions": str(max(n, int(conf.get("spark.sql.shuffle.partitions")))),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(min(piece, self.config.file_bytes)),
            "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        }
        old = {k: conf.get(k) for k in wanted}
        try:
            for k, v in wanted.items():
                conf.set(k, v)
            writer = rows.repartitionByRange("key").sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true")
            writer.option("parquet.block.size", str(self.config.block_bytes)).parquet(self.files.at(name))
        finally:
            for k, v in old.items():
                conf.set(k, v)
        r = self.spark.read.schema(SCHEMA).parquet(self.files.at(name)).agg(F.min("key").alias("a"), F.max("key").alias("z"), F.count("*").alias("n")).first()
        if not r["n"]:
            self.files.delete(name)
            return None
        table = Table(self._next, level, name, bytes(r["a"]).hex(), bytes(r["z"]).hex(), r["n"], self.files.size(name))
        self._next += 1
        return table

    def _commit(self, tables: list[Table], done: Iterable[str] = ()) -> None:
        if len({t.id for t in tables}) != len(tables):
            raise ManifestError("a table is registered twice")
        kept = {t.id for t in tables}
        gone = [*self._gone, *([t.path, time()] for t in self._tables if t.id not in kept)]
        done = [*(n for n in self._done if self.files.exists(f"_wal/{n}")), *done]
        state = {"sequence": self._sequence, "clock": [self.clock.physical, self.clock.logical], "next": self._next, "tables": [asdict(t) for t in tables], "done": done, "gone": gone}
        self._number = self.commits.make(self._number, state).number
        self._tables, self._done, self._gone = tables, done, gone


class Collection:
    """Documents of one collection in a store, as JSON under `<collection>:<id>`."""

    def __init__(self, store: Store, name: str, dump: Callable[[dict], str] = json.dumps, load: Callable[[str], dict] = json.loads):
        self.store, self.name, self._dump, self._load = store, name, dump, load

    def _key(self, doc_id: object) -> str:
        return f"{self.name}:{doc_id}"

    def put(self, doc_id: object, document: dict) -> None:
        self.store.put(self._key(doc_id), self._dump(document))

    def get(self, doc_id: object) -> dict | None:
        got = self.store.get(self._key(doc_id))
        return None if got is None else self._load(got.decode())

    def delete(self, doc_id: object) -> dict | None:
        """The document that was there, if any."""
        old = self.get(doc_id)
        self.store.delete(self._key(doc_id))
        return old

    def documents(self) -> DataFrame:
        """id and json of all documents."""
        rows = self.store.view().filter(F.startswith(F.col("key"), F.lit(self._key("").encode())))
        return rows.select(F.substring(F.col("key").cast("string"), F.lit(len(self.name) + 2), F.length("key")).alias("id"), F.col("value").cast("string").alias("json"))

    def observe(self, doc_id: object, callback: Callable[[dict], None]) -> Callable[[], None]:
        return self.store.watch(self._key(doc_id), callback)

    def observe_all(self, callback: Callable[[dict], None]) -> Callable[[], None]:
        return self.store.watch(self._key(""), callback)
