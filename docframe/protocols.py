"""What types of users' own have to offer to be used in place of the library's."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from .plans.query import Query


@runtime_checkable
class Runner(Protocol):
    """Answers queries, say from a store of its own."""

    def run(self, query: Query) -> DataFrame: ...


@runtime_checkable
class Mergeable(Protocol):
    """A kind of replicated value: tables of two replicas become one. Merging must not depend on grouping or order."""

    def merge(self, local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame: ...


@runtime_checkable
class DocumentSource(Protocol):
    """Where a collection's documents come from."""

    def documents(self) -> DataFrame: ...

    def count(self) -> int: ...


@runtime_checkable
class EntryIndex(Protocol):
    """An index as a table (key, doc_id)."""

    def lookup(self, value: object) -> DataFrame: ...

    def range(self, low: object, high: object) -> DataFrame: ...
