"""The corpus pipeline: classify, drop near copies, cut repeats, mix sources, pack sequences.

Each stage takes what its predecessor kept, as written and read back, and returns rows with the
columns of ``documents``; the last one returns the packed pieces. Stages handle nulls, empty
and very long texts, ties, repeated rows, empty tables and further columns as the operators
they call do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.llm import jaccard, mixing, packing, quality_model, substrings
from grainmill.llm.words import bounded_rows, documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score passes; the rest go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.good_documents(docs, labels)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id.

    Near copies share 80 % of their runs of five words.
    """
    return jaccard.one_of_each(docs, n=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that also start earlier are cut out of the texts."""
    cut = substrings.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_rows(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read back."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = bounded_rows(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# A trained classifier and a tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None

PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
