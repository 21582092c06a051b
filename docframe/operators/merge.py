"""Merging versions of keys: the latest counts, deletions are kept as tombstones until a view drops them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """For each key the row with the greatest order. An aggregate, so versions are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*(F.col(c) for c in rest)), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *(F.col("_row").getField(c).alias(c) for c in rest))


def live(df: DataFrame, tombstone: str = "is_tombstone") -> DataFrame:
    """Without deleted keys."""
    return df.filter(~F.col(tombstone)).drop(tombstone)


def merge_runs(runs: Sequence[DataFrame], key: str = "key") -> DataFrame:
    """Rows of several runs, oldest first, by key; the newest run counts and tombstones stay."""
    tagged = [r.withColumn("_run", F.lit(i)) for i, r in enumerate(runs)]
    return latest(reduce(lambda a, b: a.unionByName(b), tagged), [key], ["_run"]).drop("_run")


def key_range(df: DataFrame, start: object, end: object | None = None, key: str = "key") -> DataFrame:
    """Keys from start up to but not including end."""
    df = df.filter(F.col(key) >= F.lit(start))
    return df if end is None else df.filter(F.col(key) < F.lit(end))


def table_stats(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Least and greatest key and the count of rows of each table."""
    return df.groupBy(*by).agg(F.min(key).alias("smallest_key"), F.max(key).alias("largest_key"), F.count("*").alias("entry_count"))


def level_counts(tables: DataFrame, threshold: int = 4) -> DataFrame:
    """Tables on each level, and whether they are enough to be compacted."""
    out = tables.groupBy("level").agg(F.count("*").alias("tables"))
    return out.withColumn("needs_compaction", F.col("tables") >= threshold)
