"""From raw documents to token ids: quality rules, line dedup, near-dedup, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents, whatever their names.

In every stage: null and empty texts are documents without words; repeated rows are judged alike and stay or go
together; rows with a null doc_id cannot be told apart and stay in every stage; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm import bpe, decontam, lines, minhash, quality
from pitpanel.llm.store import by_size, materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts have under 50 words and go."""
    judged = quality.quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    gone = materialise(judged.where("not kept").select("doc_id").distinct())
    return by_size(docs, gone, "doc_id", "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; one that loses all its lines goes.

    A document that is as a whole a copy of another keeps what it has from there: near_dedup, next, takes it out.
    """
    left = lines.drop_lines(docs, lines.line_dedup(docs), whole=0.8)
    ink = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    emptied = by_size(docs.where(ink).select("doc_id"), materialise(left.where(~ink).select("doc_id").distinct()), "doc_id", "left_semi")
    return by_size(left, materialise(emptied.distinct()), "doc_id", "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    found = minhash.near_duplicates(docs, shingle=5, percent=80)
    gone = materialise(found.where("not kept").select("doc_id").distinct())
    return by_size(docs, gone, "doc_id", "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = materialise(found.select("doc_id").distinct())
    return by_size(docs, gone, "doc_id", "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests of every document."""
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: No SQL: binomial cutoffs, edit joins and merges are beyond it; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
