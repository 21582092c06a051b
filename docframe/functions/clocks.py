"""Hybrid logical clocks, keys and checksums as columns."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greatest logical part; beyond it the physical part advances, so a clock never goes back.
LOGICAL = 65535


@dataclass(frozen=True, order=True)
class Hlc:
    """Milliseconds, and a counter for events within one; ordered by both."""

    physical: int = 0
    logical: int = 0

    def advance(self, now: int | None = None) -> Hlc:
        now = time.time_ns() // 1_000_000 if now is None else now
        if now > self.physical:
            return Hlc(now, 0)
        return Hlc(self.physical, self.logical + 1) if self.logical < LOGICAL else Hlc(self.physical + 1, 0)


def hlc(physical: Column, logical: Column) -> Column:
    """A struct that compares like the clock."""
    return F.struct(physical.cast("long").alias("physical"), logical.cast("int").alias("logical"))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp (without zone: in UTC)."""
    return F.floor(F.unix_micros(F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone())) / F.lit(1000)).cast("long")


def scoped_key(collection: str, doc_id: Column) -> Column:
    """`<collection>:<id>`."""
    return F.concat(F.lit(f"{collection}:"), doc_id.cast("string"))


def in_scope(key: Column, collection: str) -> Column:
    return F.startswith(key, F.lit(f"{collection}:"))


def int_key(value: Column) -> Column:
    """Eight bytes whose order is that of the integers, as hex digits."""
    return F.lower(F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))


def float_key(value: Column) -> Column:
    """Eight bytes whose order is that of the floats (negative ones inverted, others with the sign flipped), as hex."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double")).cast("long")
    return F.lower(F.lpad(F.hex(F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(2**63))))), 16, "0"))


def bool_key(value: Column) -> Column:
    return F.when(value, F.lit("01")).when(~value, F.lit("00"))


def bytes_key(value: Column) -> Column:
    """Strings and bytes order as they are."""
    return F.lower(F.hex(value))


def device_key(device: Column) -> Column:
    """An integer device id as 16 big-endian bytes, compared unsigned."""
    return F.unhex(F.lpad(F.hex(device.cast("long")), 32, "0"))


def checksum(*parts: Column) -> Column:
    """CRC-32 over the parts, each led by its length."""
    return F.crc32(F.concat(*(F.concat(F.unhex(F.lpad(F.hex(F.length(p)), 16, "0")), p.cast("binary")) for p in parts)))
