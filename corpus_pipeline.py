"""A training corpus from raw documents: language, lines, near copies, secrets, sequences.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents; the last returns the
packed pieces. Stages work on whole texts of all that the stage before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioscope.llm import langid, line_dedup, packing, secrets, simhash
from folioscope.llm.common import cut_lineage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not identified go: null texts, texts without letters or near to no known n-gram."""
    return langid.keep_identified(docs, langid.learn(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are deleted from the texts; a document that is left empty goes."""
    return line_dedup.dedup_columns(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: of the smallest doc_id, null ids last; of that, the text with the least hash."""
    row_key = F.xxhash64(F.lit("row"), "doc_id", "text").alias("row_key")
    found = simhash.near_duplicates(docs.select(row_key.alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    ids = docs.select(row_key, "doc_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("least")
    stay = cut_lineage(found.join(ids, "row_key").groupBy("component_id").agg(least).select(F.col("least.row_key").alias("kept_key")))
    own = [F.col(f"`{c}`") for c in docs.columns]
    plain = [c for c, kind in zip(own, docs.dtypes, strict=True) if not any(k in kind[1] for k in ("map<", "variant"))]  # maps have no hash and no order
    rows = docs.select(F.struct(*own).alias("row"), row_key, F.xxhash64(*plain).alias("all"))
    kept = rows.join(stay, F.col("row_key") == F.col("kept_key")).withColumn("nth", F.row_number().over(W.partitionBy("kept_key").orderBy("all")))
    return kept.filter("nth = 1").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to the names of their kinds."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts' ids in sequences of 1024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Winnowed line dedup and packing patterns are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
