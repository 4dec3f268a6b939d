"""A corpus pipeline: toxicity, line dedup, near duplicates, secrets, packing. Each stage reads what the one before wrote.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridag.llm.common import stored, table
from veridag.llm.lines import dedup_lines
from veridag.llm.secrets import redact
from veridag.llm.shingles import keep_one
from veridag.llm.tokens import pack
from veridag.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go."""
    return score_toxicity(docs, table(spark, sf_dir, "labels")).where("score < 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents stay in one of them; n_chars follows the text."""
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 5-word shingles of a similarity of 0.8 or more connect, the smallest doc_id stays."""
    return keep_one(docs, words=5, percent=80).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return redact(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as pieces of sequences of 1024 ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_jaccard", near_duplicates), ("secret_scan", secret_scan), ("packing", packing)]
#: A trained classifier and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
