"""Change logs as streams, live queries that emit what changes in a result, and prefix watches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import CommitConflict
from ..operators.diff import is_empty, ordered, query_diff
from ..operators.ranks import numbered
from ..plans.query import Query
from ..protocols import Runner
from ..sources.files import Commits, Files

EVENTS = "collection string, doc_id long, mutation_type string, origin string, seq long"
CHANGES = "key string, value string, is_tombstone boolean, seq long"


@dataclass(frozen=True)
class Event:
    """mutation_type: insert, update or delete; origin: local or remote, carried along only."""

    collection: str
    doc_id: int
    mutation_type: str
    origin: str = "local"

    @classmethod
    def insert(cls, collection: str, doc_id: int, origin: str = "local") -> Event:
        return cls(collection, doc_id, "insert", origin)

    @classmethod
    def update(cls, collection: str, doc_id: int, origin: str = "local") -> Event:
        return cls(collection, doc_id, "update", origin)

    @classmethod
    def delete(cls, collection: str, doc_id: int, origin: str = "local") -> Event:
        return cls(collection, doc_id, "delete", origin)


class ChangeLog:
    """A folder of Parquet files to which publishers append; every stream over it is a subscriber of its own.

    Publishers claim their events' numbers by a commit, so no two events share one; a publisher that dies in between
    leaves a gap. A subscriber that is more than `capacity` events behind is said to lag: it loses nothing, as
    the log keeps everything.
    """

    def __init__(self, spark: SparkSession, path: str, capacity: int = 256):
        self.spark, self.files, self.capacity = spark, Files(spark, path), capacity
        self.path = self.files.root
        self._claims = Commits(self.files, "_claims")
        if not self.files.exists("_claims"):
            spark.createDataFrame([], EVENTS).write.mode("append").parquet(self.path)
        self._subscribers = 0

    @property
    def last(self) -> int:
        """The greatest number that was claimed."""
        made = self._claims.last()
        return made.state["seq"] if made else 0

    def _claim(self, n: int) -> int:
        """The first of n numbers that nobody else gets."""
        while True:
            made = self._claims.last()
            number, seq = (made.number, made.state["seq"]) if made else (0, 0)
            try:
                self._claims.make(number, {"seq": seq + n})
                return seq + 1
            except CommitConflict:
                continue

    def publish(self, events: Iterable[Event]) -> int:
        """Append events in order; returns how many subscriptions this log has handed out."""
        events = list(events)
        first = self._claim(len(events))
        rows = [(e.collection, e.doc_id, e.mutation_type, e.origin, first + i) for i, e in enumerate(events)]
        self.spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(self.path)
        return self._subscribers

    def publish_all(self, events: DataFrame, order: str) -> int:
        """The same for a table (collection, doc_id, mutation_type, origin and the column order)."""
        rows = numbered(events, F.col(order)).drop(order)
        first = self._claim(rows.count())
        rows = rows.withColumn("seq", F.col("place") + F.lit(first - 1))
        rows.select("collection", "doc_id", "mutation_type", "origin", "seq").write.mode("append").parquet(self.path)
        return self._subscribers

    def subscribe(self, collection: str | None = None, replay: bool = False) -> DataFrame:
        """A stream of the events published from now on, or of all with replay."""
        self._subscribers += 1
        stream = self.spark.readStream.schema(EVENTS).parquet(self.path)
        if not replay:
            stream = stream.filter(F.col("seq") > self.last)
        return stream if collection is None else stream.filter(F.col("collection") == collection)

    def lags(self, seq: int) -> bool:
        """Whether a subscriber that has seen the events up to seq is more than `capacity` behind."""
        return self.last - seq > self.capacity

    @property
    def subscriber_count(self) -> int:
        return self._subscribers


class LiveQuery:
    """Runs a query again whenever its collection changes and emits the difference to its last result.

    source gives the collection's current documents: a function or a Runner, which answers the query itself. All events of a micro-batch are answered by one run, so a
    stream that lags behind catches up with one difference. Results are written to files below `path`.
    """

    def __init__(self, log: ChangeLog, query: Query, source: Callable[[], DataFrame] | Runner, path: str, emit: Callable[[DataFrame], None], key: str = "doc_id"):
        self.log, self.query, self.source, self.emit, self.key = log, query, source, emit, key
        self.files = Files(log.spark, path)
        self._name = ""
        self._last: DataFrame | None = None
        self.lagged = 0  # runs that answered more events than the log's capacity at once

    def _run(self) -> tuple[str, DataFrame]:
        name = f"results/{uuid.uuid4().hex}"
        result = self.source.run(self.query) if isinstance(self.source, Runner) else self.query.on(self.source(), self.key)
        result.write.parquet(self.files.at(name))
        return name, self.log.spark.read.schema(result.schema).parquet(self.files.at(name))

    def _batch(self, events: DataFrame, _: int) -> None:
        n = events.count()
        if not n:
            return
        self.lagged += n > self.log.capacity
        name, now = self._run()
        diff = query_diff(self._last, now, self.key)
        if not is_empty(diff):
            self.emit(ordered(diff, self.key))
        self.files.delete(self._name)
        self._name, self._last = name, now

    def start(self, available_now: bool = False, interval: str = "1 second") -> StreamingQuery:
        """Take the first snapshot, which isn't emitted, and follow the log; stop() of the result ends it."""
        stream = self.log.subscribe(self.query.source)
        self._name, self._last = self._run()
        writer = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.files.at("checkpoint"))
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def prefix_watch(changes: DataFrame, prefix: str) -> DataFrame:
    """The changes (batch or stream) of keys that start with prefix; no state is kept."""
    return changes.filter(F.startswith(F.col("key"), F.lit(prefix)))


def collection_watch(changes: DataFrame, collection: str, doc_id: int | None = None) -> DataFrame:
    """The changes of a collection's documents, or of one of them."""
    key = F.lit(f"{collection}:") if doc_id is None else F.lit(f"{collection}:{doc_id}")
    return changes.filter(F.startswith(F.col("key"), key) if doc_id is None else F.col("key") == key)
