"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet in the folder that executors share and read again as the next one's docs. What a
stage wrote on its way is removed when its result stands, and that result when the next
one does; the last one stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomfield.llm import common, content_sort, language, mixing, near_dedup, packing


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.recognised(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return content_sort.without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the total follows from the weights and capacities; no document leaves
    return mixing.mixture(docs, share=None)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    before = None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with common.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            common.removed(spark, before)
        before = f"{folder}/{name}"
    return docs


#: SQL can't express language ID and packing; tests hold the stages against plain versions.
ORACLE_SQL = None
