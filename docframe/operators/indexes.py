"""Secondary indexes: as tables of (key, doc_id), and as layouts of files that Spark prunes by itself."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def index_entries(df: DataFrame, field: str, key: str = "doc_id") -> DataFrame:
    """(key, doc_id), each pair once; documents without the field have no entry."""
    return df.filter(F.col(field).isNotNull()).select(F.col(field).alias("key"), F.col(key).alias("doc_id")).distinct()


def entry_count(df: DataFrame, field: str, key: str = "doc_id") -> DataFrame:
    return index_entries(df, field, key).agg(F.count("*").alias("entry_count"))


def lookup(df: DataFrame, field: str, value: Any, key: str = "doc_id") -> DataFrame:
    """Ids of documents with the value, ascending."""
    return df.filter(F.col(field) == F.lit(value)).select(F.col(key).alias("doc_id")).distinct().orderBy("doc_id")


def range_lookup(df: DataFrame, field: str, low: Any = None, high: Any = None, low_inclusive: bool = True, high_inclusive: bool = True, key: str = "doc_id") -> DataFrame:
    """Ids by value and then by id."""
    c = F.col(field)
    if low is not None:
        df = df.filter(c >= F.lit(low) if low_inclusive else c > F.lit(low))
    if high is not None:
        df = df.filter(c <= F.lit(high) if high_inclusive else c < F.lit(high))
    return df.filter(c.isNotNull()).select(c.alias("key"), F.col(key).alias("doc_id")).distinct().orderBy("key", "doc_id")


def add_entries(index: DataFrame, more: DataFrame) -> DataFrame:
    """Entries that are there already don't count twice."""
    return index.unionByName(more).distinct()


def remove_entries(index: DataFrame, gone: DataFrame) -> DataFrame:
    return index.join(gone.select("key", "doc_id").distinct(), ["key", "doc_id"], "left_anti")


def removed(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The entries of gone, and whether each was there to be removed."""
    gone = gone.select("key", "doc_id").distinct()
    there = index.select("key", "doc_id", F.lit(True).alias("was_there")).distinct()
    return gone.join(there, ["key", "doc_id"], "left").withColumn("was_there", F.coalesce("was_there", F.lit(False)))


def write_sorted(df: DataFrame, path: str, field: str, files: int | None = None) -> None:
    """Files that each hold a range of the field, sorted: range and point filters skip files and row groups."""
    ranged = df.repartitionByRange(files, field) if files else df.repartitionByRange(field)
    ranged.sortWithinPartitions(field).write.mode("errorifexists").parquet(path)


def write_hashed(df: DataFrame, path: str, field: str, distinct: int) -> None:
    """Files with a Bloom filter on the field: point filters skip row groups that can't have the value."""
    writer = df.write.mode("errorifexists").option(f"parquet.bloom.filter.enabled#{field}", "true")
    writer.option(f"parquet.bloom.filter.expected.ndv#{field}", str(distinct)).parquet(path)


class Bloom:
    """A set of values that may be asked for without reading them; false answers are always right."""

    def __init__(self, spark: SparkSession, filter_: Any):
        self.spark, self.filter = spark, filter_

    @classmethod
    def of(cls, df: DataFrame, field: str, expected: int, rate: float = 0.01) -> Bloom:
        """Built by the executors, a part of the rows each."""
        return cls(df.sparkSession, df._jdf.stat().bloomFilter(field, expected, rate))

    @classmethod
    def decode(cls, spark: SparkSession, data: bytes) -> Bloom:
        return cls(spark, spark._jvm.org.apache.spark.util.sketch.BloomFilter.readFrom(spark._jvm.java.io.ByteArrayInputStream(data)))

    def encode(self) -> bytes:
        out = self.spark._jvm.java.io.ByteArrayOutputStream()
        self.filter.writeTo(out)
        return bytes(out.toByteArray())

    def insert(self, value: Any) -> bool:
        """Whether the filter has changed, so the value is a new one for sure."""
        return bool(self.filter.put(value))

    def merge(self, other: Bloom) -> None:
        """Take in the values of another filter of the same size."""
        self.filter.mergeInPlace(other.filter)

    def may_contain(self, value: Any) -> bool:
        return bool(self.filter.mightContain(value))
