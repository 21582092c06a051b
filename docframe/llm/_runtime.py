"""Where intermediate tables live and how code reaches the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import StorageError
from ..sources.files import scratch

#: Stands for a null doc_id inside the operators; it sorts below every other id.
NO_ID = -(2**63)


#: Has Spark remove a statement's shuffle files when it is done.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_checked: set[tuple[str, str]] = set()


def materialise(df: DataFrame, **metrics: Column) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors.

    The shuffle files behind it go at once. The attribute seen of the result has the number of rows, n, and what the
    aggregates `metrics` give, found while writing. The first table of an application is counted again: it raises if
    fewer rows can be read than were written, as in a folder that isn't shared.
    """
    spark = df.sparkSession
    path, written = scratch(spark), Observation()
    watched = df.observe(written, F.count(F.lit(1)).alias("n"), *(m.alias(name) for name, m in metrics.items()))
    old = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        # a statement, not a writer: only for statements Spark removes the files
        spark.sql(f"INSERT OVERWRITE DIRECTORY '{path}' USING parquet OPTIONS (compression 'zstd') SELECT * FROM {{df}}", df=watched)
    finally:
        spark.conf.set(_CLEAN, old)
    seen, out = dict(written.get), spark.read.schema(df.schema).parquet(path)
    place = (spark.sparkContext.applicationId, os.path.dirname(path))
    if place not in _checked and seen["n"]:
        if (n := out.count()) != seen["n"]:
            raise StorageError(f"{seen['n']} rows were written to {path}, {n} can be read: is the folder shared?")
        _checked.add(place)
    out._docframe_path, out.seen = path, seen
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() has written, once nothing reads them any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._docframe_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application."""
    sc = spark.sparkContext
    if getattr(ship, "sent", None) == sc.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="docframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "docframe_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    ship.sent = sc.applicationId


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, keep: bool = False) -> DataFrame:
    """(id, th, text): id is doc_id or NO_ID, th a hash of the text (null as empty). Two rows with one id and
    different texts stay apart by th. Other columns are dropped, so names can't clash, or are in the struct
    rest with keep; unkeyed() gives them back."""
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    out = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), th.alias("th"), F.col("text")]
    if keep:
        out.append(F.struct(*(c for c in docs.columns if c != "text")).alias("rest"))
    return docs.select(*out)


def unkeyed(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, from what keyed(docs, keep=True) has made of them."""
    return df.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns))


def doc_id() -> Column:
    """The id that keyed() was given."""
    return F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id")


def added(df: DataFrame, ddl: str) -> StructType:
    """The schema of df with more columns behind."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])
