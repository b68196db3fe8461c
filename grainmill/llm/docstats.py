"""Statistics of whole texts, for quality rules and the quality classifier.

All are counted over a batch at once with Arrow and numpy; words as in ``words.py``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from grainmill.llm import words as W

SYMBOLS = "#*$%&|<>"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
    "n_upper", "n_lower", "n_digits", "n_loud", "n_stops", "n_distinct", "n_short", "n_capital",
)
SCHEMA = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)


def _table(characters: str) -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[[ord(c) for c in characters]] = 1
    return table


_CLASSES = {
    "n_symbols": _table(SYMBOLS),
    "n_upper": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "n_lower": _table("abcdefghijklmnopqrstuvwxyz"),
    "n_digits": _table("0123456789"),
    "n_loud": _table("!?"),
    "n_stops": _table(".,;:"),
}


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which entries occur twice or more with the same row and key."""
    with np.errstate(over="ignore"):
        mix = W.mixed(key.astype(np.uint64) ^ W.mixed(row.astype(np.uint64)))
    order = np.argsort(mix)
    same = (mix[order[1:]] == mix[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
    same &= row[order[1:]] == row[order[:-1]]
    out = np.zeros(len(key), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _pairs(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, code) pairs."""
    pair = np.unique((row.astype(np.int64) << 32) | code.astype(np.int64))
    return pair >> 32, pair & 0xFFFFFFFF


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text; null counts as empty."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    offsets, codes, distinct = W.coded_words(texts)
    out = {"n_words": np.diff(offsets)}
    row = np.repeat(np.arange(n), out["n_words"])
    chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False)[codes]
    out["word_chars"] = _row_sums(chars, offsets)
    out["n_short"] = _row_sums(chars <= 2, offsets)
    first = pc.utf8_slice_codeunits(distinct, 0, 1)
    capital = pc.utf8_is_upper(first).to_numpy(zero_copy_only=False)
    out["n_capital"] = _row_sums(capital[codes], offsets)
    out["n_distinct"] = np.bincount(_pairs(row, codes)[0], minlength=n)

    data = np.concatenate([np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)])
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy())))
    for name, table in _CLASSES.items():
        out[name] = _row_sums(table[data], ends)

    # A 3-word window is the number of a distinct pair and a word, so that both fit whatever the
    # number of words is.
    windows = np.zeros(len(codes), dtype=bool)
    if len(codes) >= 3:
        c = codes.astype(np.int64)
        pair = pa.array((c[:-2] << 32) | c[1:-1]).dictionary_encode().indices
        key = (pair.to_numpy(zero_copy_only=False).astype(np.int64) << 32) | c[2:]
        inside = np.flatnonzero(row[:-2] == row[2:])
        windows[inside] = _repeated(row[inside], key[inside])
    covered = windows.copy()
    covered[1:] |= windows[:-1]
    covered[2:] |= windows[:-2]
    out["n_repeat_words"] = _row_sums(covered, offsets)

    lists = pc.split_pattern(texts, "\n")
    line_row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
    lines = lists.flatten().dictionary_encode()
    text_of = pc.ascii_trim_whitespace(lines.dictionary)
    full = pc.binary_length(text_of).to_numpy(zero_copy_only=False) > 0
    line = lines.indices.to_numpy(zero_copy_only=False)
    keep = full[line] if len(line) else np.zeros(0, dtype=bool)
    out["n_lines"] = np.bincount(line_row[keep], minlength=n)
    once = np.bincount(_pairs(line_row[keep], line[keep])[0], minlength=n)
    out["n_dup_lines"] = out["n_lines"] - once
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in W.steps(whole):
            counts = text_counts(batch.column("text"))
            columns = [batch.column(c) for c in ("doc_id", "lang", "source")]
            columns += [pa.array(counts[c].astype(np.int64)) for c in COUNTS]
            yield pa.record_batch(columns, names=["doc_id", "lang", "source", *COUNTS])


def document_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and COUNTS of every row."""
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(_count, SCHEMA)
