"""The corpus pipeline: stages over documents, each written and read again before the next.

All stages take any columns beside doc_id and text, whatever their names, and all but the last return them. Null and
empty texts have no words, so nothing is found in them; very long texts are read whole. Rows whose doc_id is null or
occurs again are rows of their own; where rows are told apart by id and text, equal ones share their fate. Ties go
to the least id, then to the least hash of the text. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docframe.llm._runtime import documents, keyed, materialise, unkeyed
from docframe.llm.decontaminate import decontaminate
from docframe.llm.jaccard_join import jaccard_classes
from docframe.llm.sentencepiece_codec import sentencepiece_encode
from docframe.llm.substring_dedup import substring_dedup
from docframe.llm.toxicity import held_out, learn, score

#: Stages can't be expressed in SQL (the toxicity model is fitted).
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from labels that aren't held out.

    Null and empty texts have the model's leak as their score, far below the threshold, so they stay; equal texts
    stay or go together. Without a toxic label nothing goes.
    """
    model = learn(docs.filter(~held_out("doc_id")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unkeyed(score(docs, model).filter("predicted = 0"), docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the least doc_id (a null one is the least, ties go by a hash
    of the text, and of equal rows any one stays); all documents without words stay."""
    found = jaccard_classes(docs)
    first = found.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct("id", "th", F.col("n_shingles").alias("n"))).alias("first")).select("first.*")
    blank = found.filter("n_shingles = 0").select("id", "th", F.lit(0).cast("long").alias("n")).distinct()
    keep = materialise(first.unionByName(blank).groupBy("id", "th").agg(F.min("n").alias("n")))
    rows = keyed(docs, keep=True).join(keep, ["id", "th"])
    copy = F.row_number().over(Window.partitionBy("id", "th").orderBy("n"))
    return unkeyed(rows.withColumn("copy", copy).filter("copy = 1 or n = 0"), docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that one with a smaller doc_id has.

    A text that loses words is what is left, joined by spaces, and n_chars its length; others stay as they are, null
    ones too. Rows with one doc_id don't remove each other's words; a null doc_id counts as the least.
    """
    cut = materialise(substring_dedup(docs, keep_text=True).filter("n_removed > 0").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "th", "kept").dropDuplicates(["id", "th"]))
    rows = keyed(docs, keep=True).join(cut, ["id", "th"], "left").withColumn("text", F.coalesce("kept", "text"))
    out = unkeyed(rows.select("text", "rest", "kept"), docs)
    if "n_chars" in docs.columns:
        out = unkeyed(rows.select(F.col("text"), F.when(F.col("kept").isNull(), F.col("rest")).otherwise(F.col("rest").withField("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType))).alias("rest")), docs)
    return out


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; null and empty texts have none. An empty benchmark rejects nothing."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return unkeyed(found.filter("not contaminated"), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their digests of the remaining documents, a row for each row; null counts as the empty text, which
    has no ids."""
    return sentencepiece_encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", clean),
    ("jaccard_join", distinct),
    ("substring_dedup", unrepeated),
    ("decontamination", uncontaminated),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
