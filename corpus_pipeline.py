"""The corpus pipeline: documents without toxic ones and near duplicates, mixed to target weights, as piece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import jaccard_join, mixing, pieces, toxicity
from lodestrata.llm.common import new_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the scorer learns from the labelled ones among them."""
    model = toxicity.fit(toxicity.training(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.scored(docs.withColumnsRenamed({c: f"d_{c}" for c in docs.columns if c != "text"}), model, [f"d_{c}" if c != "text" else c for c in docs.columns])
    return scored.filter(scored["score"] < toxicity.THRESHOLD).select(*[scored[f"d_{c}" if c != "text" else c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard_join.one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids in place of the text."""
    return pieces.encode_pieces(docs, pieces.model_path())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mix", mix_sources), ("pieces", encode)]

#: SQL can express neither the scorer nor the segmentation; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
