"""docframe: document analytics on Spark DataFrames."""

from .errors import DocframeError
from .plans.filters import Filter
from .plans.query import Query, Sort
from .plans.schema import CrdtHint, FieldType, Schema, SyncAuthority

__all__ = ["CrdtHint", "DocframeError", "FieldType", "Filter", "Query", "Schema", "Sort", "SyncAuthority"]
