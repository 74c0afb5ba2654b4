"""The corpus pipeline: documents pass the quality classifier, exact and near dedup, mixing, and encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs, so that a lost executor never costs more than one stage.

Cases, in every stage: columns of other names, whatever they are called, pass through (the last stage replaces
ids and n_tokens); an empty table gives an empty one; texts of any length pass whole. A null text counts as
empty, which the classifier judges like any text; of several, exact dedup keeps one; it has no near copies;
its size is 0, so that mixing takes none of it. Rows without doc_id count as the smallest id in exact dedup, and
are nobody's near copies. Rows that repeat a doc_id are rows of their own in all but near dedup, which takes
them for one document."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import exact_dedup, mixing, near_dup, quality_model, sentencepiece_fst
from gridloom.llm.common import load, remove, shared_dir


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_model.keep_good(docs, load(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the smallest doc_id stays."""
    return near_dup.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken at their target weights, some rows several times."""
    return mixing.resample(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts get their piece ids."""
    return sentencepiece_fst.encode(docs)


STAGES = [
    ("quality_classifier", classify_quality),
    ("exact_dedup", drop_copies),
    ("near_dup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]
ORACLE_SQL = None  # the classifier, the sketches and the transducer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = load(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    before = None
    for place, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{place}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # what has been read through goes
            remove(spark, before)
        before = path
    return docs
