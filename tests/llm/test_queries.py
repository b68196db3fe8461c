"""The registered queries: those with SQL against it, all of them for their columns."""

import pytest

from __spark_entry__ import oracle_sql, queries
from grainmill.llm.queries import QUERIES, SQL
from tools.check_oracle import compare, connect

COLUMNS = {
    "op1_lm_scores": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op2_top_k": ["query_id", "rank", "vec_id", "score"],
    "op3_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op4_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op5_ngram_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op6_best_two_fit": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op7_quality_rules": [
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    ],
    "op8_quality_trees": ["doc_id", "held_out", "score", "predicted"],
    "op9_html_text": ["page_id", "url", "text", "n_chars"],
    "op10_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op11_periodic_runs": [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
    ],
    "op12_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op13_prefix_trie": [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    ],
}


def test_all_are_registered():
    assert set(COLUMNS) == set(QUERIES) and {*QUERIES, "pipeline"} <= set(queries())
    assert set(SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert compare(got, connect(sf_dir).execute(SQL[name]).df()) == "ok"


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir)
    assert rows.columns[: len(COLUMNS[name])] == COLUMNS[name]
    table = {"op2": "embeddings", "op9": "pages", "op10": "pages"}.get(name.split("_")[0], "documents")
    if table != "embeddings" and name not in ("op6_best_two_fit", "op13_prefix_trie"):
        assert rows.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
