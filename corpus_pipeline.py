"""Cleaning pipeline over ``documents``: STAGES in order, each on what the one before kept.

Each stage is (spark, docs, sf_dir) -> DataFrame; ``run`` writes every result as
Parquet in the shared folder and reads it again as the next stage's documents.
Stages decide per row, by the id (a null id is one like any other) and a hash of
what the decision looked at; an id on two texts gets a decision for each.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuescope.llm import exact, jaccard, mixing, pieces, toxicity
from valuescope.llm.common import row_key, table
from valuescope.llm.queries import PIECES
from valuescope.session import ensure_checkpoint_dir


def _keep(docs: DataFrame, key: Column, rows: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id (null too) and ``key`` are among ``rows`` (doc_id, key); columns as they are."""
    same = docs["doc_id"].cast("long").eqNullSafe(rows["doc_id"]) & (key == rows["key"])
    return docs.join(rows, same, "left_semi")


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon rejects go."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the rows with the smallest id stay; where none has an id, all stay."""
    groups = exact.exact_groups(docs).where("kept").select("doc_id", F.xxhash64("text_sha256").alias("key"))
    return _keep(docs, F.xxhash64(F.sha2(exact.normal(docs["text"]), 256)), groups)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id. Texts without words and rows without id stay."""
    return _keep(docs, row_key(docs, "text"), jaccard.one_of_each(docs))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that meets the target weights stays; rows without id are drawn too."""
    return _keep(docs, row_key(docs, *mixing.KEY), mixing.mix(docs, keyed=True).where("sampled").select("doc_id", "key"))


def stage_sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with seeded merge-dropout, checked to decode to the text."""
    return pieces.encode(docs, public_tokenizers.path(PIECES))


STAGES = [("toxicity", stage_toxicity), ("exact_dedup", stage_exact_dedup), ("ngram_jaccard", stage_near_dedup),
          ("mixing", stage_mixing), ("sentencepiece", stage_sentencepiece)]
ORACLE_SQL = None  # learning, near copies and dropout have no SQL form; tests/llm/test_pipeline.py runs it against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
