"""Subword encoding and decoding of whole corpora.

Encoding a row needs only the row and the vocabulary, so both directions are narrow Arrow
steps: no row per word is ever made or exchanged. The distinct words of a batch are merged at
once, and each task remembers the words it has encoded. Text normalisation is the identity.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession, functions as F

from grainmill.constants import FIRST_BYTE_ID, FIRST_PIECE_ID, META_SPACE, SPECIAL_TOKENS, UNK_ID
from grainmill.functions.steps import list_steps, text_steps
from grainmill.operators.merges import Merges, WordTokens, marked_tokens, merge_pairs

SPECIAL_SPLIT = re.compile("(" + "|".join(map(re.escape, SPECIAL_TOKENS)) + ")")
# A run of word marks and what follows up to the next mark. No piece crosses these borders.
WORD = re.compile(f"{META_SPACE}*[^{META_SPACE}]+|{META_SPACE}+")
CROSSES_WORDS = re.compile(f"[^{META_SPACE}]{META_SPACE}")


def text_pieces(vocab: list[tuple[int, str, float]]) -> tuple[dict[str, float], dict[str, int]]:
    """Merge priority (low first) and id of each piece that stands for text."""
    ids = {p: i for i, p, _ in vocab if i >= FIRST_PIECE_ID}
    crossing = [p for p in ids if CROSSES_WORDS.search(p)]
    if crossing:
        raise ValueError(f"pieces reach over a word border: {crossing[:3]}")
    return {p: -score for i, p, score in vocab if i >= FIRST_PIECE_ID}, ids


def encode_word(word: str, priority: dict[str, float], piece_ids: dict[str, int]) -> list[int]:
    """Ids of a word; a character without a piece becomes the ids of its UTF-8 bytes."""
    out: list[int] = []
    for part in merge_pairs(word, priority):
        found = piece_ids.get(part)
        if found is None:
            out += [FIRST_BYTE_ID + b for b in part.encode("utf-8")]
        else:
            out.append(found)
    return out


def encode_text(text: str, word_ids: Callable[[str], list[int]]) -> list[int]:
    """Ids of a text: it is given a leading word mark, and special tokens are split out."""
    if not text:
        return []
    marked = META_SPACE + text.replace(META_SPACE, " ")
    segments = SPECIAL_SPLIT.split(marked)
    if segments[0] == META_SPACE and len(segments) > 1:
        segments[0] = ""
    ids: list[int] = []
    for i, segment in enumerate(segments):
        if i % 2:
            ids.append(SPECIAL_TOKENS.index(segment))
        else:
            for word in WORD.findall(segment.replace(" ", META_SPACE)):
                ids += word_ids(word)
    return ids


def encode_texts(texts: pa.Array, known: WordTokens) -> pa.ListArray:
    """Ids of each text of a batch; all distinct words of it are merged at once."""
    texts = pc.replace_substring(texts, META_SPACE, " ")
    special = pc.fill_null(pc.match_substring_regex(texts, SPECIAL_SPLIT.pattern), False)
    marked = pc.binary_join_element_wise(
        META_SPACE, pc.replace_substring(texts, " ", META_SPACE), ""
    )
    plain = pc.and_(pc.invert(special), pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0))
    raw = pc.if_else(plain, marked, "").cast(pa.large_binary())
    flat = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(raw).to_numpy())))
    upto, ids, _ = marked_tokens(known, flat, ends, META_SPACE)
    if pc.any(special).as_py():
        def word_ids(word: str) -> list[int]:
            first, count = known.find([word])
            return known.ids[first[0] : first[0] + count[0]].tolist()

        rows = [ids[a:b] for a, b in zip(upto, upto[1:])]
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            rows[i] = np.array(encode_text(texts[i].as_py(), word_ids), np.int32)
        upto = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        ids = np.concatenate(rows)
    return pa.ListArray.from_arrays(
        pa.array(upto.astype(np.int32)), pa.array(ids, pa.int32()), mask=texts.is_null()
    )


def bpe_encoder(spark: SparkSession, vocab: list[tuple]) -> Callable[[Column], Column]:
    """Text column -> ids column."""
    shared = spark.sparkContext.broadcast(text_pieces(vocab))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = WordTokens(Merges(*shared.value, FIRST_BYTE_ID))
        for batch in batches:
            for part in text_steps(batch):
                yield encode_texts(part, known)

    return encode


def piece_bytes(vocab: list[tuple[int, str, float]]) -> list[bytes]:
    """id -> the bytes it decodes to."""
    out = []
    for i, piece, _ in vocab:
        if FIRST_BYTE_ID <= i < FIRST_PIECE_ID:
            out.append(bytes([i - FIRST_BYTE_ID]))
        elif i < FIRST_BYTE_ID:
            out.append(piece.encode())
        else:
            out.append(piece.replace(META_SPACE, " ").encode())
    return out


def bpe_decoder(
    spark: SparkSession, vocab: list[tuple], *, skip_special_tokens: bool = False
) -> Callable[[Column], Column]:
    """Ids column -> text column; the word mark that encoding put in front is taken off."""
    shared = spark.sparkContext.broadcast(piece_bytes(vocab))

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = shared.value

        def text(row: list[int]) -> str:
            if skip_special_tokens:
                row = [i for i in row if i >= FIRST_BYTE_ID]
            # An id outside the vocabulary stands for the unknown piece.
            data = b"".join([table[i if 0 <= i < len(table) else UNK_ID] for i in row])
            # Byte pieces never stand for a mark, so a leading blank from one is kept.
            marked = bool(row) and row[0] >= FIRST_PIECE_ID and data.startswith(b" ")
            return data[marked:].decode("utf-8", "replace")

        for batch in batches:
            for ids in list_steps(batch):
                rows = (None if r is None else text(r) for r in ids.to_pylist())
                yield pa.array(rows, pa.string())

    return decode


def is_roundtrip_failure(text: Column, decoded: Column) -> Column:
    """The text does not come back as it was, and not because it holds the word mark."""
    return (text != decoded) & ~F.contains(text, F.lit(META_SPACE))
