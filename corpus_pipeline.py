"""The corpus pipeline: toxicity, line dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemospark.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from mnemospark.llm.common import read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models call toxic go."""
    return toxicity.keep_ordinary(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; copies of a text stay whole, for the next stage to keep one of them."""
    return line_dedup.dedup_lines(docs, spare_copies=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap an item of the benchmark go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 2048."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Models and packing cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, each on all that the one before kept, handed on as Parquet."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _handed_on(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def _handed_on(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """Write a stage's result into the shared checkpoint folder and read it again."""
    import uuid

    path = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{name}-{uuid.uuid4().hex}.parquet"
    docs.write.parquet(path)
    return spark.read.parquet(path)
