"""Filters on fields, compiled to columns.

A condition compares a field with a literal of one of the types String, Int, Float, Bool, Bytes and Null. Nothing
is coerced: a condition between different types is false, as is one on a missing field or on NaN. Typed tables
have a column for each field; there a missing field and an explicit null are both NULL, so eq(field, None) is IS
NULL. Dynamic tables have one column `fields`, a map from names to tagged values, which keeps them apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError

#: Type of the column `fields` of dynamic tables, and where a tag's value is.
DYNAMIC = "map<string, struct<tag: string, s: string, i: bigint, f: double, b: boolean, x: binary>>"
_SLOT = {"string": "s", "int": "i", "float": "f", "bool": "b", "bytes": "x"}


def tag_of(value: Any) -> str:
    """The type of a literal."""
    if value is None:
        return "null"
    for kind, tag in ((bool, "bool"), (int, "int"), (float, "float"), (str, "string"), ((bytes, bytearray), "bytes")):
        if isinstance(value, kind):
            return tag
    raise QueryError(f"no field holds a {type(value).__name__}")


def tag_of_type(kind: T.DataType) -> str | None:
    """The type of a column's values, None if no literal can equal them."""
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return "float"
    return {T.StringType: "string", T.BooleanType: "bool", T.BinaryType: "bytes"}.get(type(kind))


@dataclass(frozen=True)
class Filter:
    """Make one with eq, lt, gt, lte, gte, contains, and_, or_."""

    def compile(self, schema: T.StructType) -> Column:
        """A column that is true for matching rows; on others it is false or NULL."""
        raise NotImplementedError

    def conjuncts(self) -> Iterator[Condition]:
        """The conditions that all matching rows meet, as far as they stand at the top."""
        return iter(())

    @staticmethod
    def eq(field: str, value: Any) -> Filter:
        return Condition(field, "eq", value)

    @staticmethod
    def lt(field: str, value: Any) -> Filter:
        return Condition(field, "lt", value)

    @staticmethod
    def gt(field: str, value: Any) -> Filter:
        return Condition(field, "gt", value)

    @staticmethod
    def lte(field: str, value: Any) -> Filter:
        return Condition(field, "lte", value)

    @staticmethod
    def gte(field: str, value: Any) -> Filter:
        return Condition(field, "gte", value)

    @staticmethod
    def contains(field: str, value: str | bytes) -> Filter:
        return Condition(field, "contains", value)

    @staticmethod
    def and_(*parts: Filter) -> Filter:
        """True without parts."""
        return Combined(parts, True)

    @staticmethod
    def or_(*parts: Filter) -> Filter:
        """False without parts."""
        return Combined(parts, False)


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b,
    "lt": lambda a, b: a < b,
    "gt": lambda a, b: a > b,
    "lte": lambda a, b: a <= b,
    "gte": lambda a, b: a >= b,
    "contains": F.contains,
}


@dataclass(frozen=True)
class Condition(Filter):
    field: str
    op: str
    value: Any

    def conjuncts(self) -> Iterator[Condition]:
        yield self

    def compile(self, schema: T.StructType) -> Column:
        tag = tag_of(self.value)
        if "fields" in schema.names and isinstance(schema["fields"].dataType, T.MapType):
            slot = F.try_element_at(F.col("fields"), F.lit(self.field))
            if tag == "null":
                return (slot["tag"] == "null") if self.op == "eq" else F.lit(False)
            return (slot["tag"] == tag) & self._holds(slot[_SLOT[tag]], tag)
        if self.field not in schema.names:
            return F.lit(False)
        column = F.col(f"`{self.field}`")
        if tag == "null":
            return column.isNull() if self.op == "eq" else F.lit(False)
        if tag_of_type(schema[self.field].dataType) != tag:
            return F.lit(False)
        return self._holds(column, tag)

    def _holds(self, column: Column, tag: str) -> Column:
        if self.op == "contains" and tag not in ("string", "bytes"):
            return F.lit(False)
        value = bytes(self.value) if tag == "bytes" else self.value
        if tag == "float" and math.isnan(value):
            return F.lit(False)
        out = _COMPARE[self.op](column, F.lit(value))
        # Spark has NaN equal to itself and above everything
        return out & ~F.isnan(column) if tag == "float" and self.op in ("eq", "gt", "gte") else out


@dataclass(frozen=True)
class Combined(Filter):
    parts: tuple[Filter, ...]
    every: bool

    def conjuncts(self) -> Iterator[Condition]:
        return (p for p in self.parts if self.every and isinstance(p, Condition))

    def compile(self, schema: T.StructType) -> Column:
        if not self.parts:
            return F.lit(self.every)
        return reduce(and_ if self.every else or_, (p.compile(schema) for p in self.parts))
