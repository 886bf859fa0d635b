"""From raw documents to a training mix: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.llm.common import materialise
from waymill.llm.decontaminate import drop_leaks
from waymill.llm.langid import drop_rejected, train_on_documents
from waymill.llm.lines import drop_line_copies
from waymill.llm.minhash import drop_near_duplicates
from waymill.llm.mixing import mix_sources, word_count


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that some language model accepts; the models learn from the documents' own lang."""
    return drop_rejected(docs, train_on_documents(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that stand, or nearly stand, in an earlier place, and documents of nothing else."""
    return drop_line_copies(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least id of each group of near copies."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove documents that hold an item of the benchmark table."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes."""
    return mix_sources(docs, word_count(F.col("text")))


STAGES = [
    ("language ID", identify_languages),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("mixing", mix),
]
#: Language models, alignments and edit distances have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written out before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
