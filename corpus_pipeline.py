"""A corpus pipeline over documents: each stage's rows are written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, decontam, near_dup, secret_scan, toxicity
from lexmill.llm.queries import CATEGORIES
from lexmill.session import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on labels, doesn't reject.

    Null and empty texts stay; rows that repeat are judged alike; without usable labels nothing is rejected. An empty table
    gives an empty one, and columns besides those of documents pass unchanged, as in every stage but the last.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", *CATEGORIES)
    chain = toxicity.train(docs, labels, CATEGORIES)
    return toxicity.predict(docs, chain).where("not __rejected").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, and of rows that repeat it one.

    Documents without words, null texts among them, are in no group and all stay.
    """
    return near_dup.deduplicate(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; those that mostly are such passages go.

    Null and empty texts stay as they are; n_chars follows the text. Without items nothing changes.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n_chars="n_chars")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each secret that isn't a widely copied example.

    `source` stands for both repository and owner; a null one counts as none. Null texts stay null; n_chars follows the text.
    """
    return secret_scan.redact(docs, n_chars="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of the texts: numbers of ids, and digests of the ids and of what they decode to, a row for each document.

    Null and empty texts have no ids. lang and source come along where they exist.
    """
    return bpe.roundtrip(
        docs,
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        [c for c in ("doc_id", "lang", "source") if c in docs.columns],
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: No stage but the last has a form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.write(stage(spark, docs, sf_dir), name)
    return docs
