"""The corpus pipeline (part of glossa.llm): quality, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and
read again as the next one's docs. Stages before the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import common, packing, quality, secrets, sketch_join
from glossa.llm.registry import KEEP_FROM
from glossa.session import Scratch, reach_workers, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    reach_workers(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=KEEP_FROM)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near-duplicates."""
    reach_workers(spark)
    return sketch_join.keep_one(docs, words=5, percent=75)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret's span masked; n_chars follows the text."""
    reach_workers(spark)
    scratch = Scratch(spark, "mask")
    ledger = scratch.cut(secrets.update_ledger(docs), "ledger")
    spans = f"_spans_{uuid.uuid4().hex}"
    found = secrets.join_back(docs, ledger, scratch, into=spans)
    text = secrets.redact(F.col("text"), F.col(spans))
    masked = F.size(spans) > 0
    return found.withColumns({"text": text, "n_chars": F.when(masked, F.length(text).cast("long")).otherwise(F.col("n_chars"))}).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens, a row for each piece of a document."""
    reach_workers(spark)
    return packing.pack_documents(docs, common.public_path("word_bpe_49k.json"), end_id=2, window=4096, most_words=100_000)


STAGES = [("quality classifier", keep_good), ("n-gram Jaccard join", keep_one_of_each_group), ("secret scans", mask_secrets), ("packing", pack)]

#: No SQL: a fitted classifier, a similarity join and a tokenizer are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
