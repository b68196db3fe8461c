"""Queries on vocabularies, piece lookup, subwords, and special tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.constants import FIRST_BYTE_ID, FIRST_PIECE_ID, META_SPACE, SPECIAL_TOKENS, UNK
from grainmill.functions import sequences as S
from grainmill.functions.text import text_points, words
from grainmill.operators import bpe, vocab
from grainmill.sources.tables import read_table
from workloads.base import big, digest, query, sql_digest, sql_points, sql_words
from workloads.shaping import documents

VOCAB_SIZE = 32_000
N_SPECIAL = len(SPECIAL_TOKENS)

SQL_VOCAB = f"""tokens AS (SELECT doc_id, {sql_words()} AS words FROM documents),
counts AS (SELECT piece, count(*) AS n FROM (SELECT unnest(words) AS piece FROM tokens) GROUP BY piece),
vocab AS (
  SELECT piece, row_number() OVER (ORDER BY n DESC, piece) + {N_SPECIAL - 1} AS id
  FROM counts ORDER BY n DESC, piece LIMIT {VOCAB_SIZE - N_SPECIAL})"""
SQL_ENCODED = f"""{SQL_VOCAB}, placed AS (
  SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS piece FROM tokens),
encoded AS (
  SELECT doc_id, list(coalesce(id, 0) ORDER BY i) AS ids,
         list(CASE WHEN id IS NULL THEN '{UNK}' ELSE piece END ORDER BY i) AS pieces
  FROM placed LEFT JOIN vocab USING (piece) GROUP BY doc_id)"""


@query(
    "vocab_build",
    f"""WITH {SQL_VOCAB}
    SELECT id::BIGINT AS id, piece, ({N_SPECIAL} - id)::DOUBLE AS score, 'piece' AS kind FROM vocab
    UNION ALL
    SELECT i::BIGINT, {SPECIAL_TOKENS}[i + 1], 0.0::DOUBLE, 'special' FROM range({N_SPECIAL}) t(i)""",
)
def vocab_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = vocab.with_kind(vocab.word_vocab(documents(spark, sf_dir), VOCAB_SIZE))
    return built.withColumn("id", big("id"))


def encoded_words(spark: SparkSession, sf_dir: str):
    docs = documents(spark, sf_dir)
    table = vocab.collect_vocab(vocab.word_vocab(docs, VOCAB_SIZE))
    lookup = vocab.piece_ids(spark, table)
    return table, docs.select("doc_id", lookup(words(F.col("text"))).alias("input_ids"))


@query(
    "encode_words",
    f"""WITH {SQL_ENCODED}
    SELECT doc_id, len(ids)::BIGINT AS n_tokens,
           len(list_filter(ids, lambda x: x = 0))::BIGINT AS n_unknown,
           {sql_digest('ids')} AS ids_md5 FROM encoded""",
)
def encode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = encoded_words(spark, sf_dir)
    return rows.select(
        "doc_id", big(F.size("input_ids")).alias("n_tokens"),
        big(F.size(F.filter("input_ids", lambda x: x == 0))).alias("n_unknown"),
        digest("input_ids").alias("ids_md5"),
    )


@query(
    "decode_words",
    f"""WITH {SQL_ENCODED}
    SELECT doc_id, array_to_string(pieces, ' ') AS decoded FROM encoded""",
)
def decode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, rows = encoded_words(spark, sf_dir)
    pieces = vocab.id_pieces(spark, table)(F.col("input_ids"))
    return rows.select("doc_id", F.array_join(pieces, " ").alias("decoded"))


# A subword vocabulary taken from the corpus: the most frequent character runs of up to 16
# characters inside words that carry the word mark. (The engine reads vocabularies; this one
# stands for a given file, and comes from the tables so that it grows with them.)
RUN_LENGTH = 16
SUBWORDS = 4_000


def subword_vocab(docs: DataFrame) -> DataFrame:
    marked = vocab.word_counts(docs).select(
        F.concat(F.lit(META_SPACE), "word").alias("word"), F.col("n").alias("times")
    )
    runs = (
        marked.withColumn("start", F.explode(F.sequence(F.lit(1), F.length("word"))))
        .withColumn(
            "len",
            F.explode(
                F.sequence(
                    F.lit(1), F.least(F.lit(RUN_LENGTH), F.length("word") - F.col("start") + 1)
                )
            ),
        )
        .groupBy(F.substring("word", F.col("start"), F.col("len")).alias("piece"))
        .agg(F.sum("times").alias("n"))
    )
    fixed = [(i, t, 0.0) for i, t in enumerate(SPECIAL_TOKENS)]
    fixed += [(FIRST_BYTE_ID + b, f"<0x{b:02X}>", 0.0) for b in range(256)]
    head = docs.sparkSession.createDataFrame(fixed, "id int, piece string, score double")
    return head.unionByName(vocab.rank_pieces(runs, SUBWORDS, FIRST_PIECE_ID))


SQL_SUBWORDS = f"""runs AS (
  SELECT substr(word, s, l) AS piece, sum(times) AS n FROM (
    SELECT word, times, s, unnest(range(1, least({RUN_LENGTH}, length(word) - s + 1) + 1)) AS l FROM (
      SELECT word, times, unnest(range(1, length(word) + 1)) AS s FROM (
        SELECT concat('{META_SPACE}', w) AS word, count(*) AS times
        FROM (SELECT unnest({sql_words()}) AS w FROM documents) GROUP BY w)))
  GROUP BY 1),
vocab AS (
  SELECT piece, row_number() OVER (ORDER BY n DESC, piece) - 1 AS rank
  FROM runs ORDER BY n DESC, piece LIMIT {SUBWORDS})"""
# Merging, one pair per word and step: the best rank wins, the leftmost on ties.
SQL_BPE = f"""WITH RECURSIVE {SQL_SUBWORDS},
split AS (
  SELECT doc_id, regexp_extract_all(
      '{META_SPACE}' || replace(replace(text, '{META_SPACE}', ' '), ' ', '{META_SPACE}'),
      '{META_SPACE}*[^{META_SPACE}]+|{META_SPACE}+') AS words FROM documents),
placed AS (SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM split),
merging AS (
  SELECT word, string_split(word, '') AS parts, 0 AS step
  FROM (SELECT DISTINCT word FROM placed)
  UNION ALL
  SELECT word, list_concat(list_append(parts[1 : p - 1], parts[p] || parts[p + 1]), parts[p + 2 :]),
         step + 1
  FROM (
    SELECT m.word, any_value(m.parts) AS parts, any_value(m.step) AS step,
           arg_min(m.i, v.rank * 1000 + m.i) AS p
    FROM (SELECT word, parts, step, unnest(range(1, len(parts))) AS i FROM merging) m
    JOIN vocab v ON v.piece = m.parts[m.i] || m.parts[m.i + 1]
    GROUP BY m.word)),
merged AS (SELECT word, arg_max(parts, step) AS parts FROM merging GROUP BY word),
part_ids AS (
  SELECT part, CASE WHEN rank IS NOT NULL THEN [rank + {FIRST_PIECE_ID}] ELSE
    list_transform(range(octet_length(encode(part))), lambda j:
      ('0x' || substr(hex(encode(part)), 2 * j + 1, 2))::BIGINT + {FIRST_BYTE_ID}) END AS ids
  FROM (SELECT DISTINCT unnest(parts) AS part FROM merged) LEFT JOIN vocab ON piece = part),
word_ids AS (
  SELECT word, flatten(list(ids ORDER BY k)) AS ids
  FROM (SELECT word, generate_subscripts(parts, 1) AS k, unnest(parts) AS part FROM merged)
  JOIN part_ids USING (part) GROUP BY word),
encoded AS (
  SELECT doc_id, flatten(list(ids ORDER BY i)) AS ids
  FROM placed JOIN word_ids USING (word) GROUP BY doc_id)"""


@query(
    "bpe_encode",
    f"""{SQL_BPE}
    SELECT doc_id, len(ids)::BIGINT AS n_tokens, {sql_digest('ids')} AS ids_md5 FROM encoded""",
)
def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    encode = bpe.bpe_encoder(spark, vocab.collect_vocab(subword_vocab(docs)))
    rows = docs.select("doc_id", encode(F.col("text")).alias("input_ids"))
    return rows.select(
        "doc_id", big(F.size("input_ids")).alias("n_tokens"), digest("input_ids").alias("ids_md5")
    )


@query(
    "bpe_roundtrip",
    f"SELECT doc_id, md5(replace(text, '{META_SPACE}', ' ')) AS decoded_md5, true AS same FROM documents",
)
def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    table = vocab.collect_vocab(subword_vocab(docs))
    encode, decode = bpe.bpe_encoder(spark, table), bpe.bpe_decoder(spark, table)
    rows = docs.select("doc_id", "text", decode(encode(F.col("text"))).alias("decoded"))
    return rows.select(
        "doc_id", F.md5("decoded").alias("decoded_md5"),
        (~bpe.is_roundtrip_failure(F.col("text"), F.col("decoded"))).alias("same"),
    )


SMALL_VOCAB = 3_000
SQL_SMALL = SQL_VOCAB.replace(str(VOCAB_SIZE - N_SPECIAL), str(SMALL_VOCAB - N_SPECIAL))


@query(
    "roundtrip_failures",
    f"""WITH {SQL_SMALL}, rows AS (
      SELECT doc_id, unnest(words) AS piece, generate_subscripts(words, 1) AS i FROM tokens),
    back AS (
      SELECT doc_id, string_agg(piece, ' ' ORDER BY i) AS plain,
             string_agg(CASE WHEN id IS NULL THEN '{UNK}' ELSE piece END, ' ' ORDER BY i) AS decoded
      FROM rows LEFT JOIN vocab USING (piece) GROUP BY doc_id)
    SELECT doc_id, md5(decoded) AS decoded_md5 FROM back WHERE decoded <> plain AND doc_id % 4 <> 0""",
)
def roundtrip_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a small vocabulary of words does not give back; every fourth text holds the word
    mark and is therefore left alone."""
    docs = documents(spark, sf_dir)
    table = vocab.collect_vocab(vocab.word_vocab(docs, SMALL_VOCAB))
    pieces = vocab.id_pieces(spark, table)(vocab.piece_ids(spark, table)(words(F.col("text"))))
    mark = F.when(F.col("doc_id") % 4 == 0, F.lit(META_SPACE)).otherwise(F.lit(""))
    rows = docs.select(
        "doc_id", F.concat(F.array_join(words(F.col("text")), " "), mark).alias("text"),
        F.array_join(pieces, " ").alias("decoded"),
    )
    failed = rows.where(bpe.is_roundtrip_failure(F.col("text"), F.col("decoded")))
    return failed.select("doc_id", F.md5("decoded").alias("decoded_md5"))


# Two sequences per document: its first line, and the rest.
def _sql_ids(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN [] ELSE {sql_points(text)} END"


SQL_PAIRS = f"""pairs AS (
  SELECT doc_id, {_sql_ids('a')} AS a, {_sql_ids('b')} AS b
  FROM (SELECT doc_id, string_split(text, chr(10))[1] AS a,
               substr(text, length(string_split(text, chr(10))[1]) + 2) AS b FROM documents))"""


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring_index("text", "\n", 1)
    rest = F.substr(F.col("text"), F.length(first) + 2)
    return documents(spark, sf_dir).select(
        "doc_id", text_points(first).alias("a"), text_points(rest).alias("b")
    )


@query(
    "add_specials",
    f"""WITH {SQL_PAIRS}
    SELECT doc_id, {sql_digest('[1] || a || [2] || [1] || b || [2]')} AS ids_md5,
           {sql_digest('a || [2]')} AS single_md5 FROM pairs""",
)
def add_specials(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return document_pairs(spark, sf_dir).select(
        "doc_id", digest(S.add_special_tokens(a, b, bos=True, eos=True)).alias("ids_md5"),
        digest(S.add_special_tokens(a, eos=True)).alias("single_md5"),
    )


def _zeros(x: str, value: int = 0) -> str:
    return f"list_transform({x}, lambda x: {value})"


@query(
    "special_mask",
    f"""WITH {SQL_PAIRS}
    SELECT doc_id, {sql_digest(f"[1] || {_zeros('a')} || [1, 1] || {_zeros('b')} || [1]")} AS mask_md5,
           {sql_digest(f"[1] || {_zeros('a')} || [1]")} AS ready_md5 FROM pairs""",
)
def special_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    ready = S.ready_special_tokens_mask(S.add_special_tokens(a, bos=True, eos=True))
    return document_pairs(spark, sf_dir).select(
        "doc_id", digest(S.special_tokens_mask(a, b, bos=True, eos=True)).alias("mask_md5"),
        digest(ready).alias("ready_md5"),
    )


@query(
    "segment_ids",
    f"""WITH {SQL_PAIRS}
    SELECT doc_id, {sql_digest(f"[0] || {_zeros('a')} || [0, 1] || {_zeros('b', 1)} || [1]")}
           AS segments_md5 FROM pairs""",
)
def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = S.segment_ids(F.col("a"), F.col("b"), bos=True, eos=True)
    return document_pairs(spark, sf_dir).select(
        "doc_id", digest(segments).alias("segments_md5")
    )


@query(
    "prompt_ids",
    f"""SELECT item_id, length(text)::BIGINT AS input_length, {sql_digest(sql_points())} AS ids_md5
    FROM benchmark""",
)
def prompt_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "benchmark").select(
        "item_id", text_points(F.col("text")).alias("input_ids")
    )
    return rows.select(
        "item_id", big(F.size("input_ids")).alias("input_length"),
        digest("input_ids").alias("ids_md5"),
    )
