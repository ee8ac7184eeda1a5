"""From raw documents to training shards, in five stages.

Each stage gets the Parquet that the one before has written, and works on all of it:

1. language: documents without a language (no letters) go;
2. near duplicates: of each group of linked fingerprints the document with the smallest id stays;
3. contamination: documents of which a twentieth or more stands in benchmark passages go;
4. mixing: sources are brought to their target weights; a document taken twice stands twice;
5. shards: eight of near equal bytes, as shard and slot per document.

A null text is without a language. Extra columns, whatever their names, are kept as they are up to the last stage. An empty table
gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import contamination, langcrf, mixing, sharding, simhash
from faultline.llm.common import fold, packed, unpacked
from faultline.session import shared_folder, ship

#: The stages take labels, links and weights that plain SQL doesn't express.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    field = langcrf.learn(docs.where(fold(F.col("doc_id"), 5) != 0))
    return langcrf.keep_identified(spark, docs, field)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return unpacked(simhash.keep_first(packed(docs, "doc_id", "text")), docs, "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return unpacked(contamination.clean(packed(docs, "doc_id", "text"), benchmark), docs, "doc_id", "text")


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(packed(docs, "doc_id", "text", "source")).where("copies > 0")
    return unpacked(mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))), docs, "doc_id", "text", "source")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("contamination", decontamination),
    ("mixing", mixing_sources),
    ("shards", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each one keeps is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
