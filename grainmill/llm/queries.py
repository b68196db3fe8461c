"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.llm import (
    html_text, jaccard, lm, mixing, packing, prefix_trie, quality_model, quality_rules, runs, substrings,
    subwords, topk, warc,
)
from grainmill.llm.words import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_texts(documents(spark, folder))


def op2_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, folder))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeat_report(documents(spark, folder))


def op5_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    rows = jaccard.near_copies(documents(spark, folder))
    return rows.select("doc_id", "n_shingles", "component_id")


def op6_best_two_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge_documents(documents(spark, folder))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.array_join("broken", ",").alias("broken"),
    )


def op8_quality_trees(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return quality_model.score_documents(documents(spark, folder), labels)


def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_pages(spark.read.parquet(f"{folder}/pages.parquet"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_round_trip(spark, spark.read.parquet(f"{folder}/pages.parquet"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.run_report(runs.with_periodic_tails(documents(spark, folder)))


def op12_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return subwords.round_trip(documents(spark, folder))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    return prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(conversations))


QUERIES: dict[str, Query] = {
    "op1_lm_scores": op1_lm_scores,
    "op2_top_k": op2_top_k,
    "op3_mix_sources": op3_mix_sources,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_best_two_fit": op6_best_two_fit,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_trees": op8_quality_trees,
    "op9_html_text": op9_html_text,
    "op10_warc": op10_warc,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_prefix_trie": op13_prefix_trie,
}


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    return f"""xor(4294967295, list_reduce(
        list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
        lambda acc, b: list_reduce(
            list_concat([xor(acc, b)], list_transform(range(8), lambda z: 0::BIGINT)),
            lambda s, z: xor(s >> 1, 3988292384::BIGINT * (s & 1)))))"""


def rules_sql() -> str:
    """The counts, the bucket sketch, the limits and the verdict of ``quality_rules`` as SQL."""
    measures = quality_rules.MEASURES
    cells = " UNION ALL ".join(
        f"SELECT lang, source, '{name}' AS measure, floor(({m.value}) / {m.step}::DOUBLE) AS bucket FROM passed"
        for name, m in measures.items()
    )
    tests = ", ".join(
        f"""CASE WHEN NOT base_failed AND (floor(({m.value}) / {m.step}::DOUBLE) > (
            SELECT high FROM edges e WHERE e.lang IS NOT DISTINCT FROM c.lang
            AND e.source IS NOT DISTINCT FROM c.source AND e.measure = '{name}')"""
        + (f""" OR floor(({m.value}) / {m.step}::DOUBLE) < (
            SELECT low FROM edges e WHERE e.lang IS NOT DISTINCT FROM c.lang
            AND e.source IS NOT DISTINCT FROM c.source AND e.measure = '{name}')""" if m.both_sides else "")
        + f") THEN '{name}' END"
        for name, m in measures.items()
    )
    least = " ".join(f"WHEN '{n}' THEN {round(m.slack / m.step)}" for n, m in measures.items())
    both = ", ".join(f"'{n}'" for n, m in measures.items() if m.both_sides)
    quiet, spreads = quality_rules.QUIET, quality_rules.SPREADS
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM t
), p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), g AS (
    SELECT doc_id, i, string_agg(word, ' ') OVER win AS k, count(*) OVER win AS n FROM p
    WINDOW win AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)
), r AS (SELECT doc_id, i, n = 3 AND count(*) OVER (PARTITION BY doc_id, k, n) > 1 AS again FROM g
), v AS (
    SELECT doc_id, bool_or(again) OVER (
        PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM r
), rep AS (SELECT doc_id, count(*) FILTER (covered) AS n_repeat_words FROM v GROUP BY doc_id
), lines AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counted AS (
    SELECT t.doc_id, lang, source, len(words)::DOUBLE AS n_words,
           coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::DOUBLE AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::DOUBLE AS n_symbols,
           length(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE AS n_upper,
           length(regexp_replace(text, '[^a-z]', '', 'g'))::DOUBLE AS n_lower,
           length(regexp_replace(text, '[^!?]', '', 'g'))::DOUBLE AS n_loud,
           coalesce(n_lines, 0)::DOUBLE AS n_lines, coalesce(n_dup_lines, 0)::DOUBLE AS n_dup_lines,
           coalesce(n_repeat_words, 0)::DOUBLE AS n_repeat_words
    FROM t JOIN w USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)
), c AS (
    SELECT *, n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed
    FROM counted
), passed AS (SELECT * FROM c WHERE NOT base_failed
), sketch AS (
    SELECT lang, source, measure, bucket, count(*) AS n FROM ({cells}) GROUP BY ALL
), ranked AS (
    SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS upto,
           sum(n) OVER (PARTITION BY lang, source, measure) AS everything FROM sketch
), q AS (
    SELECT lang, source, measure,
           min(bucket) FILTER (upto >= 0.5::DOUBLE * everything) AS middle,
           min(bucket) FILTER (upto >= {quiet}::DOUBLE * everything) AS low,
           min(bucket) FILTER (upto >= {1 - quiet}::DOUBLE * everything) AS high
    FROM ranked GROUP BY ALL
), room AS (
    SELECT *, greatest({spreads} * CASE WHEN measure IN ({both}) THEN least(middle - low, high - middle)
                                        ELSE middle - low END,
                       CASE measure {least} END) AS room FROM q
), edges AS (SELECT lang, source, measure, middle + room AS high, middle - room AS low FROM room
), judged AS (SELECT *, concat_ws(',', {tests}) AS broken FROM c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND broken = '' AS kept, broken FROM judged
"""


SQL: dict[str, str] = {
    "op2_top_k": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op4_substring_dedup": r"""
WITH w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                               lambda x: x <> '') AS words FROM documents
), p AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), g AS (
    SELECT doc_id, i, word, string_agg(word, ' ') OVER win AS k, count(*) OVER win AS n FROM p
    WINDOW win AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), f AS (
    SELECT doc_id, i, word,
           n = 20 AND row_number() OVER (PARTITION BY k, n ORDER BY doc_id, i) > 1 AS later FROM g
), c AS (
    SELECT doc_id, i, word, bool_or(later) OVER (
        PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f
)
SELECT d.doc_id, count(c.word) AS n_words, count(c.word) FILTER (c.gone) AS n_removed,
       sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.i) FILTER (NOT c.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op5_ngram_jaccard": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), p AS (
    SELECT doc_id, len(words) AS total, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), g AS (
    SELECT doc_id, total, i, string_agg(word, ' ') OVER (
        PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS gram FROM p
), s AS (
    SELECT DISTINCT doc_id, gram FROM g WHERE i = 1 OR i <= total - 3
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
    FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM n
    UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(reach.b), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach ON reach.a = d.doc_id
GROUP BY d.doc_id, n.n
""",
    "op7_quality_rules": rules_sql(),
    "op11_periodic_runs": rf"""
WITH t AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                               lambda x: x <> '') AS words, {crc32_sql("doc_id::VARCHAR")} AS h FROM documents
), u AS (
    SELECT *, len(words) AS n, (h // 10) % nullif(len(words), 0) AS a,
           1 + (len(words) - (h // 10) % nullif(len(words), 0)) // (3 + (h // 10) % 8) AS p FROM t
), w AS (
    SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(
        range(n), lambda i: CASE WHEN i < a THEN words[i + 1] ELSE words[a + (i - a) % p + 1] END)
        ELSE words END AS words FROM u
), s AS (SELECT doc_id, n, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM w
), g AS (
    SELECT doc_id, n, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM s
    WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), pairs AS (
    SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM g x JOIN g y
    ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs
), stretches AS (
    SELECT doc_id, q, min(i) AS start, count(*) + 2 + q AS length FROM islands GROUP BY doc_id, q, island
), runs AS (
    SELECT doc_id, start, length, min(q) AS period FROM stretches
    WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length
), kept AS (
    SELECT s.doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM s
    WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = s.doc_id
                      AND s.i >= r.start + r.period AND s.i < r.start + r.length)
    GROUP BY s.doc_id
), best AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS place FROM runs
), lines AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(
        start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text
    FROM runs GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period,
       1000 * length // period AS exponent_milli, sha256(coalesce(l.text, '')) AS runs_sha256,
       sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM t d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
LEFT JOIN best b ON b.doc_id = d.doc_id AND place = 1
""",
    "op13_prefix_trie": rf"""
WITH o AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)
), b AS (
    SELECT c.conv_id, 0 AS part, pos, role, text FROM c
    JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND pos < h
    UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND pos >= h
), r AS (
    SELECT conv_id, row_number() OVER o AS depth, length(text) AS chars,
           string_agg(md5(length(role) || ':' || role || text), '') OVER (
               PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING) AS node
    FROM b WINDOW o AS (PARTITION BY conv_id ORDER BY part, pos)
    UNION ALL SELECT conv_id, 0, 0, '' FROM c
), k AS (
    SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS above,
           max(depth) OVER (PARTITION BY conv_id) = depth AS stops FROM r
), n AS (
    SELECT node, any_value(depth) AS depth, any_value(above) AS above, min(conv_id) AS conv_id,
           count(*) AS n_convs, any_value(chars) AS chars,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (stops), '')) AS ends_sha256
    FROM k GROUP BY node
), f AS (
    SELECT n.*, p.conv_id AS parent_conv_id, coalesce(m.n_children, 0) AS n_children
    FROM n LEFT JOIN n p ON p.node = n.above
    LEFT JOIN (SELECT above, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above) m ON m.above = n.node
), s AS (
    SELECT r.node, sum((f.n_children = 0)::BIGINT)::BIGINT AS n_leaves,
           sum((f.n_convs - 1) * f.chars)::BIGINT AS saved_tokens
    FROM f JOIN r ON r.conv_id = f.conv_id AND r.depth <= f.depth GROUP BY r.node
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM f JOIN s USING (node)
""",
    "op10_warc": """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
           sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS winner FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < winner THEN 'revisit' ELSE 'response' END
           AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < winner THEN winner END AS refers_to
FROM w
""",
}
