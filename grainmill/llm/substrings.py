"""Removal of repeated passages: runs of ``window`` words that also start earlier in the corpus.

1. A count-min sketch of the corpus. A window is counted by its rarest-looking part: the
   smallest hash among its half-length shingles. Equal windows have equal smallest parts at
   equal places, so a window that occurs twice has a part that is counted twice; the estimate is
   never below the number of windows. Each task makes a sketch of its own texts with counters
   that stop at 2; the sketches of all tasks are merged by parts of the counter range. Its size
   is fixed, so what is broadcast does not grow with the data:
   a fuller sketch lets more windows through, but never loses one.
2. The texts are read again. Windows that the sketch estimates at 2 or more are grouped exactly,
   by a hash of 95 bits. Inside one step of a task, all but the first occurrence are settled at
   once, so however often a passage occurs, a step sends it once.
3. Of each group, the smallest (doc_id, text key, start) stays. All other starts go back to
   their documents, where the covered words are removed.

Nulls and odd cases: a null text has no words. A null doc_id comes before all others. Rows that
repeat a doc_id and a text are one document read twice and get the same result; different texts
with one doc_id are documents in the order of their text keys. Overlapping repeats inside a
document count. Texts with fewer words than a window are kept whole. An empty table gives no
rows. Further columns are kept by ``without_repeats`` and not read by ``repeat_report``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from grainmill.llm import sketch, words as W

WINDOW = 20
# ``packed``: 31 more bits of the hash and the start; or, negative, a settled run: its length and
# its start. Narrow rows, as this is the largest exchange.
FIRSTS = "h1 long, packed long, doc_id long, text_key long"
REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _sliding(values: np.ndarray, n: int, best) -> np.ndarray:
    """Minimum or maximum of each n consecutive values, by doubling."""
    out, width = values, 1
    while 2 * width <= n:
        out = best(out[:-width], out[width:])
        width *= 2
    return best(out[: len(out) - (n - width)], out[n - width :]) if width < n else out


class Shingled:
    """Hashes of the windows of all texts in a step, and the smallest part of each window."""

    def __init__(self, texts: pa.Array, window: int, exact: bool):
        half = max(1, window // 2)
        self.offsets, codes, distinct = W.coded_words(texts)
        first, second = W.word_hashes(distinct)
        words = first[codes]
        self.n = max(0, len(words) - window + 1)
        starts = np.arange(self.n)
        row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        self.row = row[: self.n]
        # A window must not run over the end of its text.
        self.inside = starts + window <= self.offsets[1:][self.row] if self.n else np.zeros(0, bool)
        span = window - half + 1
        parts = W.ngram_hashes(words, half)
        least = _sliding(parts, span, np.minimum) if self.n else np.empty(0, np.uint64)
        self.least = least
        held = np.where(self.inside, least, 0)
        # A part counts once for each place where it is the smallest of some window.
        padded = np.concatenate((np.zeros(span - 1, np.uint64), held, np.zeros(span - 1, np.uint64)))
        most = _sliding(padded, span, np.maximum) if self.n else np.empty(0, np.uint64)
        self.counted = parts[: len(most)][most == parts[: len(most)]]
        if exact:
            self.h1 = W.ngram_hashes(words, window)
            self.h2 = W.ngram_hashes(second[codes], window)


def _parts(window: int):
    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for step in W.steps(batch):
            yield Shingled(step.column("text"), window, exact=False).counted

    return run


def _candidates(window: int, bits: int, shared):
    """Windows estimated repeated. ``n`` 0: the first of its step; else a run of n later starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = sketch.Repeated(shared.value, bits)
        for whole in batches:
            for batch in W.steps(whole):
                shingled = Shingled(batch.column("text"), window, exact=True)
                at = np.flatnonzero(shingled.inside)
                at = at[repeated(shingled.least[at])]
                doc_ids = batch.column("doc_id")
                null = np.array(doc_ids.is_null())
                ids = np.where(null, np.iinfo(np.int64).min, doc_ids.fill_null(0).to_numpy())
                keys = batch.column("text_key").to_numpy()
                row = shingled.row[at]
                start = at - shingled.offsets[row]
                h1, h2 = shingled.h1[at], (shingled.h2[at] >> np.uint64(33)).astype(np.int64)
                order = np.lexsort((start, keys[row], ids[row], h2, h1))
                row, start, h1, h2 = row[order], start[order], h1[order], h2[order]
                doc, text = ids[row], keys[row]
                new = np.ones(len(order), dtype=bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                # The same place read twice, in a repeated row, is not a later occurrence.
                same = (doc == doc[lead]) & (text == text[lead]) & (start == start[lead])
                # In the order of the texts, so that ids repeat from row to row and compress well.
                heads = np.flatnonzero(new)
                heads = heads[np.lexsort((start[heads], row[heads]))]
                packed = (h2[heads] << 32) | start[heads]
                yield _rows(h1[heads], packed, doc[heads], text[heads])
                later = np.flatnonzero(~same)
                later = later[np.lexsort((start[later], row[later]))]
                row, start = row[later], start[later]
                if not len(row):
                    continue
                head = np.ones(len(row), dtype=bool)
                head[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)
                heads = np.flatnonzero(head)
                last = np.concatenate((heads[1:], [len(row)])) - 1
                count = start[last] - start[heads] + 1
                own = W.mixed(ids[row[heads]].astype(np.uint64) ^ start[heads].astype(np.uint64))
                packed = np.iinfo(np.int64).min | (count << 32) | start[heads]
                yield _rows(own, packed, ids[row[heads]], keys[row[heads]])

    return run


def _rows(h1, packed, doc, text) -> pa.RecordBatch:
    columns = [pa.array(c) for c in (h1.view(np.int64), packed, doc, text)]
    return pa.record_batch(columns, names=["h1", "packed", "doc_id", "text_key"])


def repeat_runs(docs: DataFrame, *, window: int = WINDOW, bits: int = sketch.BITS) -> DataFrame:
    """``doc_id, text_key, start, n``: runs of n starts whose windows occur earlier.

    A null doc_id is shown as the smallest number.
    """
    shared = sketch.repeated(docs.select("text"), _parts(window), bits)
    found = docs.select("doc_id", "text", W.text_key().alias("text_key")).mapInArrow(
        _candidates(window, bits, shared), FIRSTS
    )
    rows = found.repartition("h1").select(
        "h1", "doc_id", "text_key", (F.col("packed") < 0).alias("settled"),
        F.shiftright("packed", 32).bitwiseAND(0x7FFFFFFF).alias("high"),
        F.col("packed").bitwiseAND(0xFFFFFFFF).cast("int").alias("start"),
    )
    # Settled runs have hashes of their own and pass through with the windows.
    place = F.struct("doc_id", "text_key", "start")
    first = F.min(F.when(~F.col("settled"), place)).over(Window.partitionBy("h1", "high"))
    return rows.withColumn("_first", first).where(F.col("settled") | (place != F.col("_first"))).select(
        "doc_id", "text_key", "start", F.when(F.col("settled"), F.col("high")).otherwise(1).cast("int").alias("n")
    )


def _covered(n_words: int, starts, counts, window: int) -> np.ndarray:
    """Which words are covered by a window that starts in one of the runs."""
    change = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + counts - 1 + window, n_words), -1)
    return np.cumsum(change[:-1]) > 0


def _cut(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.steps(whole):
                rows: list[tuple] = []
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                runs = batch.column("_runs").to_pylist()
                kept_texts = []
                for text, own in zip(texts, runs):
                    words = (text or b"").split()
                    kept = words
                    if own:
                        pairs = np.array([(r["start"], r["n"]) for r in own], dtype=np.int64)
                        gone = _covered(len(words), pairs[:, 0], pairs[:, 1], window)
                        kept = [w for w, g in zip(words, gone) if not g]
                    joined = b" ".join(kept)
                    rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()))
                    kept_texts.append(text if len(kept) == len(words) else joined)
                if with_text:
                    texts = pa.array(kept_texts, pa.binary()).cast(pa.string())
                    yield pa.record_batch([batch.column("_row"), texts], names=["_row", "text"])
                    continue
                columns = list(zip(*rows)) or [[]] * 3
                types = (pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch(
                    [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    return run


def _with_runs(docs: DataFrame, rows: DataFrame, window: int, bits: int) -> DataFrame:
    """``rows`` (with doc_id, text, _key) and the runs of their document; a text is exchanged once."""
    runs = (
        repeat_runs(docs, window=window, bits=bits)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("start", "n")).alias("_runs"))  # equal rows have the same runs
        .withColumnsRenamed({"doc_id": "_doc", "text_key": "_text"})
    )
    least = F.lit(-(2**63)).cast("long")
    return rows.join(
        runs, (F.coalesce("doc_id", least) == F.col("_doc")) & (F.col("_key") == F.col("_text")), "left"
    ).drop("_doc", "_text", "_key")


def repeat_report(docs: DataFrame, *, window: int = WINDOW, bits: int = sketch.BITS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row."""
    rows = docs.select("doc_id", "text", W.text_key().alias("_key"))
    return _with_runs(docs, rows, window, bits).mapInArrow(_cut(window, False), REPORT)


def without_repeats(docs: DataFrame, *, window: int = WINDOW, bits: int = sketch.BITS) -> DataFrame:
    """The rows with repeated passages taken out of their texts.

    A text that loses words becomes its kept words, joined by one space; others stay as they are.
    """
    others = [f for f in docs.schema.fields if f.name != "text"]
    row = F.struct(*[F.col(f"`{f.name}`") for f in others])
    rows = docs.select(row.alias("_row"), "doc_id", "text", W.text_key().alias("_key"))
    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in others)
    out = _with_runs(docs, rows, window, bits).mapInArrow(
        _cut(window, True), f"_row struct<{kinds}>, text string"
    )
    return out.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
