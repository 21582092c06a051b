"""The query builder: filter, then sort, then offset, then limit, in whatever order it is built."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..operators.ranks import numbered
from .filters import Filter


@dataclass(frozen=True)
class Sort:
    """By one field. Documents without it come last ascending and first descending; ties by ascending doc_id."""

    field: str
    descending: bool = False

    @classmethod
    def asc(cls, field: str) -> Sort:
        return cls(field)

    @classmethod
    def desc(cls, field: str) -> Sort:
        return cls(field, True)

    def columns(self, schema: T.StructType, key: str) -> list[Column]:
        if "fields" in schema.names and isinstance(schema["fields"].dataType, T.MapType):
            by = F.try_element_at(F.col("fields"), F.lit(self.field))
        else:
            by = F.col(f"`{self.field}`") if self.field in schema.names else F.lit(None).cast("string")
        return [by.desc_nulls_first() if self.descending else by.asc_nulls_last(), F.col(key).asc()]


@dataclass(frozen=True)
class Query:
    """Immutable; each call returns a new one, the last call of a kind counts.

    Results are whole documents. Without a sort their order is unspecified.
    """

    source: str
    where: Filter | None = None
    order: Sort | None = None
    most: int | None = None
    skip: int = 0

    @classmethod
    def collection(cls, name: str) -> Query:
        return cls(name)

    def filter(self, where: Filter) -> Query:
        return replace(self, where=where)

    def sort(self, order: Sort) -> Query:
        return replace(self, order=order)

    def limit(self, n: int) -> Query:
        return replace(self, most=_count(n))

    def offset(self, n: int) -> Query:
        return replace(self, skip=_count(n))

    def on(self, df: DataFrame, key: str = "doc_id") -> DataFrame:
        """Run over the documents of df, whose ids are in the column key."""
        if self.where is not None:
            df = df.filter(self.where.compile(df.schema))
        if self.order is not None:
            df = df.orderBy(*self.order.columns(df.schema, key))
        if self.skip:
            df = df.offset(self.skip)
        return df if self.most is None else df.limit(self.most)

    def ranked(self, df: DataFrame, key: str = "doc_id", name: str = "place") -> DataFrame:
        """The same result with each document's place in it, from 1 on. For whole results that are to be written in order:
        nothing is brought together in one task."""
        if self.order is None:
            raise QueryError("a rank needs a sort")
        rows = df if self.where is None else df.filter(self.where.compile(df.schema))
        rows = numbered(rows, *self.order.columns(df.schema, key), name=name).withColumn(name, F.col(name) - F.lit(self.skip))
        return rows.filter(F.col(name) > 0) if self.most is None else rows.filter(F.col(name).between(1, self.most))

    def run(self, collections: Mapping[str, DataFrame], key: str = "doc_id") -> DataFrame:
        if self.source not in collections:
            raise QueryError(f"no collection {self.source!r}")
        return self.on(collections[self.source], key)


def _count(n: int) -> int:
    if n < 0:
        raise QueryError("limit and offset can't be negative")
    return n


def by_id(df: DataFrame, doc_id: int, key: str = "doc_id") -> DataFrame:
    """The document with the id, if there is one."""
    return df.filter(F.col(key) == F.lit(doc_id))


def ids(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.select(key)


def count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))
