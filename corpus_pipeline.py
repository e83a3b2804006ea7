"""A training-data pipeline over `documents`: quality rules, one document of each near-duplicate group, repeated passages out, sources mixed to weights, tokens.

Each stage takes (spark, docs, sf_dir) and works on what the stage before kept. All but the last return the columns of `documents`. Rows with nulls,
repeated rows and empty tables pass through as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merganser.llm import bpe_automaton, mixing, near_copies, quality, suffix_dedup
from merganser.llm.queries import PASSAGE, vocabulary
from merganser.llm.shared import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of 5-word shingles 0.8 or more) stays: the one of the smallest doc_id."""
    return near_copies.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under strings of `PASSAGE` bytes that stand elsewhere, too, are cut out of the texts; n_chars follows, no document goes."""
    cut = suffix_dedup.dedup_text(docs, length=PASSAGE)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it: its words taken over its size, rounded up or down by a seeded draw. Not taken: it goes."""
    return mixing.repeated_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with hashes of ids and of the text they decode to."""
    return bpe_automaton.encode(docs, vocabulary(), token_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("source mix", mixed_sources),
    ("bpe encoding", tokens),
]

#: No stage but mixing can be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs)
    return docs
