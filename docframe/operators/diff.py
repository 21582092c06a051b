"""What changes between two results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _comparable(df: DataFrame, name: str) -> Column:
    """Maps don't compare; their sorted entries do."""
    c = F.col(f"`{name}`")
    return F.sort_array(F.map_entries(c)) if isinstance(df.schema[name].dataType, T.MapType) else c


def index_by_id(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each id."""
    return df.dropDuplicates([key])


def query_diff(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """_change (added, updated or removed), key and the new document, or the old one where it was removed.

    Documents are compared as wholes, null being equal to null and NaN to NaN; their places in the results don't
    count. Both sides have the same columns and each id once; the full outer join shuffles each side by id once.
    """
    rest = [c for c in new.columns if c != key]

    def side(df: DataFrame, name: str) -> DataFrame:
        whole = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.struct(F.lit(1).alias("_"))
        same = F.struct(*(_comparable(df, c).alias(c) for c in rest)) if rest else F.struct(F.lit(1).alias("_"))
        return df.select(key, whole.alias(name), same.alias(f"{name}_same"))

    both = side(old, "_old").join(side(new, "_new"), key, "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(~F.col("_old_same").eqNullSafe(F.col("_new_same")), "updated")
    )
    out = both.select(change.alias("_change"), key, F.coalesce("_new", "_old").alias("_doc")).filter("_change is not null")
    return out.select("_change", key, *(F.col("_doc").getField(c).alias(c) for c in rest))


def is_empty(diff: DataFrame) -> bool:
    """Nothing has changed."""
    return diff.isEmpty()


def ordered(diff: DataFrame, key: str = "doc_id") -> DataFrame:
    """By kind of change and then by id."""
    return diff.orderBy("_change", key)
