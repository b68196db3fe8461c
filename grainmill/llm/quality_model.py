"""A quality classifier: histogram gradient-boosted trees over statistics of whole texts.

The trees are fitted on a bounded sample of labels: the ``train_rows`` with the smallest hash of
their doc_id. Features are numbers from the text alone; doc_id, language, source and
labels are never inputs of a score. Scoring is one Arrow step over the feature table.

Nulls and odd cases: a null text is an empty one and is scored as such. A null doc_id has crc32
of the empty string and no label. A null label is no label; a doc_id with several labels gives
a training row for each. Repeated rows are scored each. Without labels every score is 0.5. An
empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from grainmill.llm import words as W
from grainmill.llm.boost import Forest, fit
from grainmill.llm.docstats import COUNTS, document_counts, text_counts

TRAIN_ROWS = 20_000
PASS_SCORE = 0.7
HELD_OUT = 2


def remainder(mod: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One row of finite numbers for each document."""
    c = {k: np.asarray(v, dtype=np.float64) for k, v in counts.items()}
    words, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    letters = np.maximum(c["n_upper"] + c["n_lower"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words,
            c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_words"] / lines,
            c["n_upper"] / letters, c["n_digits"] / words, c["n_loud"] / words,
            c["n_stops"] / words, c["n_distinct"] / words, c["n_short"] / words,
            c["n_capital"] / words,
        ],
        axis=1,
    )


def _score(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in COUNTS})
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(forest.chance(x))],
                names=["doc_id", "held_out", "score"],
            )

    return run


def _keep(forest: Forest, pass_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.steps(whole):
                scores = forest.chance(features(text_counts(batch.column("text"))))
                yield batch.filter(pa.array(scores >= pass_score))

    return run


def sampled_labels(labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, quality`` of at most ``train_rows`` labels that are not held out."""
    named = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality")
    return W.hashed_sample(named.where(remainder(4) != HELD_OUT), F.xxhash64("doc_id"), train_rows)


def train(counts: DataFrame, named: DataFrame) -> Forest:
    """Fit on the counts of the documents in the sample of labels.

    Of rows that share a doc_id one is taken, so the sample is as large as its labels at most.
    """
    found = counts.join(named, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*COUNTS)).alias("_c"))
    sample = found.select("doc_id", "quality", "_c.*").toPandas()
    sample = sample.sort_values(["doc_id", "quality", *COUNTS])
    x = features({c: sample[c].to_numpy() for c in COUNTS})
    return fit(x, (sample["quality"].to_numpy() > 0).astype(np.float64))


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    *,
    train_rows: int = TRAIN_ROWS,
    pass_score: float = PASS_SCORE,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    counts = W.bounded_rows(
        document_counts(docs).withColumn("held_out", remainder(4) == HELD_OUT), "quality-counts"
    )
    forest = train(counts, sampled_labels(labels, train_rows))
    scored = counts.select("doc_id", "held_out", *COUNTS).mapInArrow(
        _score(forest), "doc_id long, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= pass_score).cast("int"))


def good_documents(
    docs: DataFrame,
    labels: DataFrame,
    *,
    train_rows: int = TRAIN_ROWS,
    pass_score: float = PASS_SCORE,
) -> DataFrame:
    """The rows of ``docs`` that score ``pass_score`` or more; all columns are kept.

    The sample of labels has a fixed bound and is broadcast, so the filter moves no text.
    """
    W.small_batches(docs.sparkSession)
    named = sampled_labels(labels, train_rows)
    ids = F.broadcast(named.select("doc_id").distinct())
    forest = train(document_counts(docs.join(ids, "doc_id", "left_semi")), named)
    return docs.mapInArrow(_keep(forest, pass_score), docs.schema)
