"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of ``documents``; the last returns where every piece of every document lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.common import materialise, table
from mnemora.llm.jaccard import drop_duplicates
from mnemora.llm.language import fit, keep_identified
from mnemora.llm.packing import pack
from mnemora.llm.queries import BYTE_VOCABULARY, held_out
from mnemora.llm.secrets import redact

#: Documents whose language is predicted with less than this go: random letters, hexadecimal, symbols and other scripts score
#: at most 0.20. Of labelled documents of sf0.1 and check_s none of FEW n-grams or more scores below 0.25; shorter ones, a word
#: or two, go down to 0.19 and are kept from LEAST_OF_FEW.
LEAST_SCORE, FEW, LEAST_OF_FEW = 0.22, 20, 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: rejected documents go."""
    model = fit(docs.filter(~held_out()), "doc_id", "text", "lang")
    return keep_identified(docs, "text", model, LEAST_SCORE, FEW, LEAST_OF_FEW)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the first document of each group stays."""
    return drop_duplicates(docs, "doc_id", "text", 5, 0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: secrets and access keys are replaced by a mark, and n_chars follows."""
    return redact(docs, "text").withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing into sequences of 1024 tokens."""
    return pack(docs, "doc_id", "text", BYTE_VOCABULARY, 1024, 0)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: SQL can express none of the stages in full; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
