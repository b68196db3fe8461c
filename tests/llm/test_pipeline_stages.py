"""Stages of the corpus pipeline."""

import random

from corpus_pipeline import ngram_jaccard
from tests.llm import odd


def test_near_copies_by_runs_of_five_words(spark):
    r = random.Random(6)
    words = ["v%d" % r.randrange(10**6) for _ in range(1000)]
    edited, far = list(words), list(words)
    for k in range(21):  # 2.1 %: 0.81 of the runs of five words are shared, 0.845 of those of four
        edited[20 + 45 * k] = f"edit{k}"
    for k in range(24):  # 2.4 %: 0.79 of the runs of five words
        far[22 + 40 * k] = f"far{k}"
    texts = {1: words, 2: edited, 3: far, 4: ["other", "words", "are", "not", "near"]}
    rows = [(i, " ".join(w), "en", "a", 1, 1, "k", 2, 3, 4, 5, 0.5) for i, w in texts.items()]
    kept = ngram_jaccard(spark, spark.createDataFrame(rows, odd.SCHEMA), "")
    assert sorted(x.doc_id for x in kept.collect()) == [1, 3, 4]
