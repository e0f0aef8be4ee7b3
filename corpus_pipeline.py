"""The corpus pipeline: five stages from raw documents to sampled segmentations.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the
last return documents with their own columns. ``run`` writes each stage's result
as Parquet in the shared folder and gives it to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontam, exact_dedup, langid, minhash, pieces
from marlstone.llm.common import fresh, read, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts and texts without a letter. Learns from the labels of docs."""
    kernel = langid.train(docs.where(~langid.held_out()))
    if kernel is None:  # nothing to learn from: no document is rejected for that
        return docs.where(docs.text.rlike(r"\p{L}"))
    label, score = fresh(docs, "label"), fresh(docs, "score")
    return langid.classify(docs, kernel, label, score).where(f"{label} != '{langid.NONE}'").drop(label, score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts with a similarity of 0.8 on shingles of five words."""
    return minhash.dedup(docs, k=5, threshold=80, bands=28)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten words of a benchmark item stand."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces and lossless of what is left."""
    return pieces.round_trip(docs)


STAGES = [
    ("language", identify_language),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("segment", segment),
]

#: SQL can't express language identification or sampling; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return stored(STAGES[-1][1](spark, docs, sf_dir))
