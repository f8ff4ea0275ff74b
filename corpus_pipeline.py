"""A pipeline over ``documents``: toxicity, repeated lines, near-duplicates, benchmark passages, token ids.

``STAGES`` lists ``(name, function)``. Each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and reread as the next one's ``docs``. All but the last return the columns of ``documents``; the last adds
the token ids and their number.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import decontam, line_dedup, piece_codec, simhash_trie, toxicity_kn
from topicloom.llm.registry import query, table
from topicloom.session import shared_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold.

    Null and empty texts have a score like any text. Without a document that is labelled toxic there is no model, and all documents stay.
    """
    settings = toxicity_kn.Settings()
    model = toxicity_kn.train(docs, table(spark, sf_dir, "labels"), settings)
    return toxicity_kn.score(docs, model, settings).where("predicted = 0").select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more share, which stay in the first document that holds them.

    ``n_chars`` follows a changed text. Of a text copied ten times and more, the copy of the smallest id keeps its lines, and the others
    become empty texts, which the next stage takes as one group. A null text comes back as an empty one.
    """
    cut = line_dedup.drop_repeated_lines(docs, keep_first=True)
    return cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link within two bits (three-word shingles): that of the smallest id.

    Empty texts have one fingerprint and are one group. Rows without an id stay.
    """
    return simhash_trie.keep_one(docs, shingle=3, budget=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, exact or within its edits; without items all stay."""
    return decontam.without_items(docs, table(spark, sf_dir, "benchmark"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids; every row must decode to its text again, or the job fails."""
    coded = piece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), verify=True)
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("piece_encoding", piece_encoding),
]

# Trained scores and fingerprints have no SQL.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
