"""Conflict-free replicated values as tables: registers, counters and sets, and who decides on a conflict.

A register is a row for each write, a counter a row for each device with its total, a set a row for each tag
(element, device, clock) that asserts an element.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.schema import SyncAuthority
from ..protocols import Mergeable

CLOCK = ("physical", "logical", "device")


def lww_merge(writes: DataFrame, keys: Sequence[str], values: Sequence[str] = ("value",), clock: Sequence[str] = CLOCK) -> DataFrame:
    """The write with the greatest clock for each key; its value may be null."""
    won = F.max_by(F.struct(*values, *clock), F.struct(*clock)).alias("_won")
    return writes.groupBy(*keys).agg(won).select(*keys, "_won.*")


def lww_join(local: DataFrame, remote: DataFrame, keys: Sequence[str], values: Sequence[str] = ("value",), clock: Sequence[str] = CLOCK) -> DataFrame:
    """Merge of two replicas. With equal clocks the local write stays."""
    both = local.withColumn("_local", F.lit(1)).unionByName(remote.withColumn("_local", F.lit(0)))
    return lww_merge(both, keys, values, (*clock, "_local")).drop("_local")


def counter_value(deltas: DataFrame, keys: Sequence[str], delta: str = "delta") -> DataFrame:
    """The sum of all devices."""
    return deltas.groupBy(*keys).agg(F.sum(delta).alias("value"))


def counter_merge(deltas: DataFrame, keys: Sequence[str], device: str = "device", delta: str = "delta") -> DataFrame:
    """The greatest total of each device, over any number of replicas that all know the device."""
    return deltas.groupBy(*keys, device).agg(F.max(delta).alias(delta))


def counter_join(local: DataFrame, remote: DataFrame, keys: Sequence[str], device: str = "device", delta: str = "delta") -> DataFrame:
    """What the local replica holds after the remote one was merged into it.

    A device that only the remote replica knows starts at 0 here, so its total counts if it is positive, and
    devices that only the local one knows stay as they are: the result depends on which side is local.
    """
    on = [*keys, device]
    both = local.select(*on, F.col(delta).alias("_l")).join(remote.select(*on, F.col(delta).alias("_r")), on, "full_outer")
    mine = F.coalesce("_l", F.lit(0))
    return both.select(*on, F.when(F.col("_r").isNull(), F.col("_l")).otherwise(F.greatest(mine, "_r")).alias(delta))


def counter_add(deltas: DataFrame, operations: DataFrame, keys: Sequence[str], device: str = "device", delta: str = "delta") -> DataFrame:
    """Totals after increments (and decrements, as negative amounts) of devices."""
    on = [*keys, device]
    return deltas.select(*on, delta).unionByName(operations.select(*on, delta)).groupBy(*on).agg(F.sum(delta).alias(delta))


def device_delta(deltas: DataFrame, device_id: object, device: str = "device", delta: str = "delta") -> DataFrame:
    """The device's total, 0 if it isn't known."""
    return deltas.filter(F.col(device) == F.lit(device_id)).agg(F.coalesce(F.max(delta), F.lit(0)).alias(delta))


def orset_merge(*replicas: DataFrame) -> DataFrame:
    """All tags of all replicas. A removal leaves no trace, so a tag that another replica still has comes back."""
    out = replicas[0]
    for r in replicas[1:]:
        out = out.unionByName(r)
    return out.distinct()


def orset_remove(tags: DataFrame, removed: DataFrame, keys: Sequence[str], element: str = "element") -> DataFrame:
    """Without the tags now seen of the removed elements."""
    return tags.join(removed.select(*keys, element).distinct(), [*keys, element], "left_anti")


def orset_elements(tags: DataFrame, keys: Sequence[str], element: str = "element") -> DataFrame:
    """Elements that have a tag."""
    return tags.select(*keys, element).distinct()


def orset_size(tags: DataFrame, keys: Sequence[str], element: str = "element") -> DataFrame:
    return tags.groupBy(*keys).agg(F.count_distinct(element).alias("size"))


def orset_contains(tags: DataFrame, keys: Sequence[str], value: object, element: str = "element") -> DataFrame:
    """For each set whether it has the element."""
    return tags.groupBy(*keys).agg(F.max(F.col(element) == F.lit(value)).alias("contains"))


def _overrides(authority: SyncAuthority, is_remote: bool) -> bool:
    return is_remote and authority is SyncAuthority.RemoteAuthority


def _replaced(local: DataFrame, remote: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The remote state of every value that the remote side has, the local state of the others."""
    return remote.unionByName(local.join(remote.select(*keys).distinct(), list(keys), "left_anti").select(*remote.columns))


def resolve_lww(local: DataFrame, remote: DataFrame, keys: Sequence[str], authority: SyncAuthority, is_remote: bool = True, values: Sequence[str] = ("value",), clock: Sequence[str] = CLOCK) -> DataFrame:
    """Registers after a sync: the remote ones if the remote side is the authority and sent them, else merged."""
    columns = [*keys, *values, *clock]
    if _overrides(authority, is_remote):
        return _replaced(local.select(*columns), remote.select(*columns), keys)
    return lww_join(local.select(*columns), remote.select(*columns), keys, values, clock)


def resolve_counter(local: DataFrame, remote: DataFrame, keys: Sequence[str], authority: SyncAuthority, is_remote: bool = True) -> DataFrame:
    """Counters after a sync; an authority's replaces all devices' totals."""
    columns = [*keys, "device", "delta"]
    if _overrides(authority, is_remote):
        return _replaced(local.select(*columns), remote.select(*columns), keys)
    return counter_join(local, remote, keys).select(*columns)


def resolve_orset(local: DataFrame, remote: DataFrame, keys: Sequence[str], authority: SyncAuthority, is_remote: bool = True) -> DataFrame:
    """Sets after a sync; an authority's replaces all tags."""
    if _overrides(authority, is_remote):
        return _replaced(local, remote.select(*local.columns), keys)
    return orset_merge(local, remote.select(*local.columns))


def resolve(rule: Mergeable, local: DataFrame, remote: DataFrame, keys: Sequence[str], authority: SyncAuthority, is_remote: bool = True) -> DataFrame:
    """Values of a kind of one's own after a sync, by its merge()."""
    if _overrides(authority, is_remote):
        return _replaced(local, remote.select(*local.columns), keys)
    return rule.merge(local, remote, list(keys))
