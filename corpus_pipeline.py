"""A training-data pipeline over `documents`: five stages, each one operator of panelforge.llm.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of `documents`. Filtering stages keep rows whose decision is
unknown, and null or empty texts follow the operator's defined case.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import decontam, gam, secretscan, simhash, wfst
from panelforge.llm._base import importable, store
from panelforge.llm.queries import table, vocabulary

#: Some operator of this pipeline isn't expressible in SQL, so its test is a brute-force version.
ORACLE_SQL = None


def stage(f):
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, **settings) -> DataFrame:
        importable(spark)
        return f(spark, docs, sf_dir, **settings)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts score as the model scores all-zero features; rows that repeat are judged each."""
    model = gam.train(docs, table(spark, sf_dir, "labels"))
    return gam.filtered(docs, model, threshold)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; of rows that repeat a doc_id, one. Grouped are texts whose sets
    of five-word shingles have a similarity of 0.8 or more. Texts without words, null ones included, are one group; rows without a doc_id stay."""
    return simhash.representatives(docs, simhash.similar_documents(docs, width=5, similarity=0.8))


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a share of benchmark text go. The decision is by doc_id, which the stage before leaves once: of rows that repeat one all go if any is contaminated; rows
    without a doc_id stay, as do null and word-free texts."""
    found = store(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct(), "contaminated")
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


@stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; n_chars follows where the text changes. Every row stays; null texts stay null."""
    return secretscan.redact_secrets(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, one row each; null and empty texts have none."""
    return wfst.encode_texts(docs, wfst.load(vocabulary())).select("doc_id", "n_tokens", F.col("ids").alias("token_ids"), "round_trip")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("SentencePiece encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = store(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
