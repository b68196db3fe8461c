"""Scoring texts with a causal attention model and with a word unigram, trained on the corpus.

1. One scan of all texts cuts them into words and token ids. A task sends the ids of its
   documents and, from training documents only, its word and token counts, which are summed over
   the corpus.
2. The ids of all training documents are gone over for the neighbours of tokens on both sides,
   which give token vectors and classes, for counts of (context class, token), and for the
   attention weights. Each task sends sums of a fixed size.
3. Attention weights begin with values from ``sample_docs`` documents. From there each task
   trains on every window of its training documents once; the mean of their weights, by the
   number of windows, is the model. It depends a little on how rows are dealt to tasks.
4. The ids are scored by ``attention.Model`` in batches of overlapping windows.
5. Word scores: a second scan looks words up in a broadcast list of the ``frequent`` most
   common ones, whose size is fixed. All other words go as counts per document to a join with
   the full word table, so no table that grows is broadcast.

Held out are documents whose crc32 of the id as text leaves 0 modulo 10. Nulls and odd cases: a
null text is an empty one, and has one token, the end. A null doc_id counts as the empty string.
Repeated rows are scored each, and count each in training. Without training documents the base is
0 and the model is the untrained one. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from grainmill.llm import attention, words as W
from grainmill.llm.packing import tokenizer_path
from grainmill.llm.quality_model import remainder

TOKENIZER = "byte_bpe_50k.tiktoken"
# White space that is part of a word here; fixed values.
WIDE_SPACE = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SAMPLE_DOCS = 2000
FREQUENT_WORDS = 200_000
PARTS = 64
# Bytes of text, or of token ids, that one step turns into arrays.
SCAN_BYTES, SCORE_BYTES = 3 << 20, 2 << 20
# Words whose ids a worker remembers.
REMEMBERED = 250_000
# Cells that are sorted at once to be counted.
COUNT_CELLS = 1 << 20
# What the end of a text is counted as; no word is empty.
END_WORD = ""
SMALL = 0.1

SCAN = (
    "kind int, doc_id long, text_key long, held_out boolean, n_words long, ids binary, "
    "word string, n long"
)
DOCUMENT, WORD, TOKEN = 0, 1, 2
CELLS = "part int, cells binary, counts binary"
_SCHEMA = pa.schema([
    ("kind", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("held_out", pa.bool_()),
    ("n_words", pa.int64()), ("ids", pa.binary()), ("word", pa.string()), ("n", pa.int64()),
])


def _batch(kind: int, rows: int, **columns: pa.Array) -> pa.RecordBatch:
    arrays = [
        pa.array(np.full(rows, kind, np.int32)) if f.name == "kind" else columns.get(f.name, pa.nulls(rows, f.type))
        for f in _SCHEMA
    ]
    return pa.record_batch(arrays, schema=_SCHEMA)


class Subwords:
    """Ids of words, each with a space before it, by a byte-level tokenizer of ranked pieces.

    Many words are encoded as one text; a piece that begins with a space begins a word.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoder = tiktoken.Encoding(
            "ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pieces, special_tokens={}
        )
        self.size = max(pieces.values()) + 1
        self.spaced = np.zeros(self.size, dtype=bool)
        self.spaced[[v for k, v in pieces.items() if k[:1] == b" "]] = True
        self.words, self.ends, self.ids = pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (words + 1) and the ids of all words. No word is empty or holds a space."""
        if not len(words):
            return np.zeros(1, np.int64), np.zeros(0, np.uint32)
        whole = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), " ")
        ids = self.encoder.encode_to_numpy(" " + whole[0].as_py(), disallowed_special=())
        starts = np.flatnonzero(self.spaced[ids])
        wide = pc.any(pc.match_substring_regex(whole, WIDE_SPACE)).as_py()
        if wide or len(starts) != len(words):
            each = [self.encoder.encode_to_numpy(" " + w, disallowed_special=()) for w in words.to_pylist()]
            return np.concatenate(([0], np.cumsum([len(x) for x in each]))), np.concatenate(each)
        return np.append(starts, len(ids)), ids

    def remembered(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """What ``of`` gives; words of earlier steps are not encoded again. No word occurs twice."""
        words = words.cast(pa.string())
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        ends, ids = self.of(new)
        all_ends, all_ids = np.append(self.ends, self.ends[-1] + ends[1:]), np.concatenate((self.ids, ids))
        place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[at.is_null().to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
        upto, entries = gathered(all_ends, place)
        found = upto, all_ids[entries]
        if len(self.words) + len(new) <= REMEMBERED:
            self.words, self.ends, self.ids = pa.concat_arrays([self.words, new]), all_ends, all_ids
        elif len(words) <= REMEMBERED:  # full: only this step's words are kept
            self.words, (self.ends, self.ids) = words, found
        return found


def gathered(ends: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (taken + 1) of the lists that are taken, and the place of each of their entries."""
    first, size = ends[take], ends[take + 1] - ends[take]
    upto = np.concatenate(([0], np.cumsum(size)))
    return upto, np.arange(upto[-1]) + np.repeat(first - upto[:-1], size)


_loaded: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    if path not in _loaded:
        _loaded[path] = Subwords(path)
    return _loaded[path]


class Cut:
    """Words and token ids of a step; each distinct word is encoded once."""

    def __init__(self, texts: pa.Array, path: str):
        lower = W.lower_ascii(pc.fill_null(texts, ""))
        self.offsets, self.codes, self.words = W.coded_words(lower)
        self.ends_of, self.ids_of = subwords(path).remembered(self.words)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (rows + 1) and the ids of all rows."""
        upto, place = gathered(self.ends_of, self.codes)
        return upto[self.offsets], self.ids_of[place]


def id_type(size: int) -> np.dtype:
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def _scan(path: str, size: int):
    """Documents with their ids, then word and token counts of the whole task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[pa.Table] = []
        tokens = np.zeros(size, dtype=np.int64)
        for whole in batches:
            for step in W.steps(whole, limit=SCAN_BYTES):
                cut = Cut(step.column("text"), path)
                held = step.column("held_out")
                train = ~held.to_numpy(zero_copy_only=False)
                ends, ids = cut.ids()
                raw = ids.astype(id_type(size))
                n_words = np.diff(cut.offsets)
                yield _batch(
                    DOCUMENT, step.num_rows, doc_id=step.column("doc_id"), text_key=step.column("text_key"),
                    held_out=held, n_words=pa.array(n_words), ids=_binaries(ends * raw.itemsize, raw),
                )
                learn = np.repeat(train, n_words)
                tokens += np.bincount(raw[np.repeat(train, np.diff(ends))], minlength=size)
                tokens[-1] += train.sum()  # the end of each text
                often = np.bincount(cut.codes[learn], minlength=len(cut.words))
                seen = pa.array(often > 0)
                words.append(pa.table({"word": cut.words.filter(seen), "n": pa.array(often).filter(seen)}))
                words.append(pa.table({"word": pa.array([END_WORD]), "n": pa.array([int(train.sum())])}))
                if len(words) > 8:
                    words = [_summed(words)]
                    pa.default_memory_pool().release_unused()
        if words:
            for part in _summed(words).to_batches(max_chunksize=100_000):
                yield _batch(WORD, part.num_rows, word=part.column("word"), n=part.column("n").cast(pa.int64()))
            width = size // PARTS + 1
            parts = [tokens[a : a + width] for a in range(0, size, width)]
            yield _batch(
                TOKEN, len(parts), n=pa.array(range(len(parts)), pa.int64()),
                ids=pa.array([p.tobytes() for p in parts], pa.binary()),
            )

    return run


def _binaries(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """One binary value a row, sharing the buffer of all values."""
    offsets = pa.py_buffer(ends.astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(values)])


def _summed(tables: list[pa.Table]) -> pa.Table:
    both = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
    return both.rename_columns({"n_sum": "n"}).combine_chunks()


def _merge_cells(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum one part of the transition counts over all tasks; one task's is held at a time."""
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for a, b in zip(batch.column("cells"), batch.column("counts")):
            cells = np.cumsum(np.frombuffer(a.as_py(), "<u4"), dtype=np.int64)
            if len(cells) and cells[-1] >= len(total):
                total = np.concatenate((total, np.zeros(cells[-1] + 1 - len(total), np.int64)))
            total[cells] += np.frombuffer(b.as_py(), "<i4")
    cells = np.flatnonzero(total)
    columns = [
        pa.array([key[0].as_py()], pa.int32()),
        pa.array([np.diff(cells, prepend=0).astype("<u4").tobytes()], pa.binary()),
        pa.array([total[cells].astype("<f4").tobytes()], pa.binary()),
    ]
    yield pa.record_batch(columns, names=["part", "cells", "counts"])


def _texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Steps of rows with their offsets (rows + 1) and ids."""
    kind = id_type(size)
    for whole in batches:
        for step in W.steps(whole, "ids", SCORE_BYTES):
            column = step.column("ids")
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
            ends = at.astype(np.int64) // kind.itemsize
            data = column.buffers()[2]
            ids = np.frombuffer(data, kind)[ends[0] : ends[-1]] if data else np.zeros(0, kind)
            yield step, ends - ends[0], ids


def add_cells(table: np.ndarray, cells: np.ndarray) -> None:
    """Add to ``table`` how often each cell occurs; sorted ones are met in order, each once."""
    for a in range(0, len(cells), COUNT_CELLS):
        some = np.sort(cells[a : a + COUNT_CELLS].astype(np.int32))
        last = np.flatnonzero(np.diff(some, append=-1))
        table[some[last]] += np.diff(last, prepend=-1).astype(table.dtype)


def _count(cells_of, shared, length: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(length, dtype=np.int32)
        for _, ends, ids in _texts(batches, size):
            before, after = attention.neighbours(ends, ids, size - 1, size)
            add_cells(table, cells_of(before, after, shared.value, size))
        width = length // PARTS + 1
        for p in range(PARTS):
            own = table[p * width : (p + 1) * width]
            cells = np.flatnonzero(own)
            if len(cells):
                steps = np.diff(cells, prepend=0).astype("<u4")
                yield pa.record_batch(
                    [pa.array([p], pa.int32()), pa.array([steps.tobytes()], pa.binary()),
                     pa.array([own[cells].astype("<i4").tobytes()], pa.binary())],
                    names=["part", "cells", "counts"],
                )

    return run


def counted(texts: DataFrame, cells_of, value, length: int, size: int) -> np.ndarray:
    """How often each cell occurs in all texts; the length does not depend on the data."""
    shared = texts.sparkSession.sparkContext.broadcast(value)
    width = length // PARTS + 1
    out = np.zeros(length, dtype=np.float32)
    parts = texts.mapInArrow(_count(cells_of, shared, length, size), CELLS)
    for row in parts.groupBy("part").applyInArrow(_merge_cells, CELLS).toLocalIterator():
        cells = row["part"] * width + np.cumsum(np.frombuffer(row["cells"], "<u4"), dtype=np.int64)
        out[cells] = np.frombuffer(row["counts"], "<f4")
    return out


def _merge_tokens(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum one part of the token counts over all tasks."""
    total = 0
    for batch in batches:
        for x in batch.column("ids"):
            total = total + np.frombuffer(x.as_py(), np.int64)
    yield pa.record_batch(
        [pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "ids"]
    )


def token_counts(scan: DataFrame, size: int) -> np.ndarray:
    """How often each token occurs in the training texts; the last one is the end of a text."""
    rows = scan.where(F.col("kind") == TOKEN).select("n", "ids")
    merged = rows.groupBy("n").applyInArrow(_merge_tokens, "n long, ids binary").collect()
    parts = [np.frombuffer(r["ids"], np.int64) for r in sorted(merged, key=lambda r: r["n"])]
    return np.concatenate(parts) if parts else np.zeros(size, np.int64)


def _beside(before, after, columns, size):
    """Cells of the tokens after, then of those before, each token: the most frequent are counted."""
    follows, precedes = columns
    known, other = follows[after] >= 0, precedes[before] >= 0
    behind = (size + 1 + after[other]) * attention.FEATURES + precedes[before[other]]
    return np.concatenate((before[known] * attention.FEATURES + follows[after[known]], behind))


def _transition(before, after, contexts, size):
    return contexts[before] * size + after


def learn_vocabulary(texts: DataFrame, tokens: np.ndarray, size: int) -> attention.Vocabulary:
    """Token vectors and classes from all of ``texts``, whose tokens occur ``tokens`` times."""
    # As many texts begin as end: the start comes before, the end after.
    often = np.concatenate((tokens[:-1], [0, tokens[-1]])).astype(np.float64)
    seen = np.concatenate((tokens, [0])).astype(np.float64)
    columns = attention.most_met(seen), attention.most_met(often)
    half = (size + 1) * attention.FEATURES
    both = counted(texts, _beside, columns, 2 * half, size)
    forward, backward = both[:half].reshape(size + 1, -1), both[half:].reshape(size + 1, -1)
    return attention.learn_vocabulary(forward, often, backward, seen, size)


# Sums of weights are whole numbers of this part, so that the order of tasks is no matter. A task
# adds its mean weights in proportion to its windows, in thousands.
GRAIN = 1 << 24


def _train(shared):
    """Weights after all texts of the task, times the thousands of windows; that number is at -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, classes, weights = shared.value
        vocabulary = attention.Vocabulary(*vocabulary)
        trainer = attention.Trainer(vocabulary, classes, attention.Weights(*(p.copy() for p in weights)))
        n = sum(attention.train_on(trainer, ends, ids) for _, ends, ids in _texts(batches, vocabulary.size))
        if n:
            flat = np.concatenate([p.ravel() for p in trainer.weights.all()]).astype(np.float64)
            share = -(-n // 1000)
            # Python's numbers have no end; the sums are decimals.
            value = [Decimal(v * share) for v in np.rint(flat * GRAIN).astype(np.int64).tolist()]
            place = np.append(np.arange(len(flat)), -1)
            yield pa.record_batch(
                [pa.array(place, pa.int32()), pa.array([*value, Decimal(share)], pa.decimal128(38, 0))],
                names=["place", "value"],
            )

    return run


def train(texts: DataFrame, vocabulary: attention.Vocabulary, prior: attention.Prior, weights: attention.Weights) -> attention.Weights:
    """``weights`` trained on all of ``texts``."""
    sent = (vocabulary.arrays(), prior.classes, tuple(weights.all()))
    shared = texts.sparkSession.sparkContext.broadcast(sent)
    sums = texts.mapInArrow(_train(shared), "place int, value decimal(38, 0)").groupBy("place").agg(
        F.sum("value").alias("value")
    )
    value = {r["place"]: r["value"] for r in sums.collect()}
    n = int(value.pop(-1, 0))
    if not n:
        return weights
    flat = np.array([float(value[i] / n) / GRAIN for i in range(len(value))], dtype=np.float32)
    ends = np.cumsum([p.size for p in weights.all()])[:-1]
    return attention.Weights(*(a.reshape(p.shape) for a, p in zip(np.split(flat, ends), weights.all())))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = attention.Model.of(shared.value)
        for step, ends, ids in _texts(batches, model.vocabulary.size):
            yield pa.record_batch(
                [step.column("_row"), pa.array(model.log10(ends, ids)), pa.array(np.diff(ends))],
                names=["_row", "score", "n_subwords"],
            )

    return run


def _look_up(shared):
    """Sums over frequent words of each row, and the other words one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, logs = shared.value
        for whole in batches:
            for step in W.steps(whole):
                offsets, codes, distinct = W.coded_words(W.lower_ascii(pc.fill_null(step.column("text"), "")))
                at = pc.index_in(distinct.cast(pa.string()), value_set=listed)
                known = at.is_valid().to_numpy(zero_copy_only=False)
                value = logs[pc.fill_null(at, len(listed)).to_numpy(zero_copy_only=False)]
                sums = np.concatenate(([0.0], np.cumsum(value[codes])))
                hits = np.concatenate(([0], np.cumsum(known[codes])))
                row = np.repeat(np.arange(step.num_rows), np.diff(offsets))
                rare = ~known[codes]
                pair, n = np.unique((row[rare].astype(np.int64) << 32) | codes[rare], return_counts=True)
                doc, word = pair >> 32, pair & 0xFFFFFFFF
                ids, text = step.column("doc_id"), step.column("text_key")
                own = pa.array(np.arange(step.num_rows))
                for take, words, n_known, base, count in (
                    (own, pa.nulls(step.num_rows, pa.string()), hits[offsets[1:]] - hits[offsets[:-1]],
                     sums[offsets[1:]] - sums[offsets[:-1]], np.zeros(step.num_rows, np.int64)),
                    (pa.array(doc), distinct.take(pa.array(word)), np.zeros(len(doc), np.int64),
                     np.zeros(len(doc)), n),
                ):
                    yield pa.record_batch(
                        [ids.take(take), text.take(take), words, pa.array(n_known), pa.array(base), pa.array(count)],
                        names=["doc_id", "text_key", "word", "n_known", "base", "n"],
                    )

    return run


def word_scores(docs: DataFrame, words: DataFrame, frequent: int) -> DataFrame:
    """``doc_id, text_key, n_known, base``: words of each text that training knows, and the sum
    of log10(count + 0.1) over its words. Equal rows give one row.
    """
    spark = docs.sparkSession
    top = W.most_frequent(words.where(F.col("word") != END_WORD), "c", frequent).toPandas()
    logs = np.append(np.log10(top["c"].to_numpy(dtype=np.float64) + SMALL), 0.0)
    shared = spark.sparkContext.broadcast((pa.array(top["word"], pa.string()), logs))
    found = W.bounded_rows(
        docs.mapInArrow(
            _look_up(shared), "doc_id long, text_key long, word string, n_known long, base double, n long"
        ),
        "word-scores",
    )
    known = F.col("c").isNotNull()
    rare = (
        found.where("word is not null").select("doc_id", "text_key", "word", "n")
        .join(words, "word", "left")
        .groupBy("doc_id", "text_key")
        .agg(
            F.sum(F.when(known, F.col("n")).otherwise(0)).alias("_n"),
            F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMALL))).alias("_base"),
        )
        .withColumnsRenamed({"doc_id": "_doc", "text_key": "_text"})
    )
    same = found.where("word is null").groupBy("doc_id", "text_key").agg(
        F.count(F.lit(1)).alias("_rows"), F.first("n_known").alias("n_known"), F.first("base").alias("base")
    )
    both = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_text"))
    # Equal rows have sent their rare words each.
    return same.join(rare, both, "left").select(
        "doc_id", "text_key",
        (F.col("n_known") + F.coalesce(F.col("_n") / F.col("_rows"), F.lit(0))).cast("long").alias("n_known"),
        (F.col("base") + F.coalesce(F.col("_base") / F.col("_rows"), F.lit(0.0))).alias("base"),
    )


def score_texts(
    docs: DataFrame,
    *,
    path: str | None = None,
    sample_docs: int = SAMPLE_DOCS,
    frequent: int = FREQUENT_WORDS,
    steps: int = 2000,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords``."""
    spark, path = docs.sparkSession, path or tokenizer_path(TOKENIZER)
    rows = docs.select("doc_id", "text", W.text_key().alias("text_key"), (remainder(10) == 0).alias("held_out"))
    size = subwords(path).size + 1
    scan = W.bounded_rows(rows.mapInArrow(_scan(path, size), SCAN), "lm-scan")
    words = scan.where(F.col("kind") == WORD).groupBy("word").agg(F.sum("n").alias("c")).where("c > 0")
    words = W.bounded_rows(words, "lm-words")
    total = words.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.when(F.col("word") == END_WORD, F.col("c")))).first()
    n, v, end = total[0] or 0, total[1] or 0, total[2] or 0

    learn = scan.where((F.col("kind") == DOCUMENT) & ~F.col("held_out"))
    texts = learn.select("ids")
    vocabulary = learn_vocabulary(texts, token_counts(scan, size), size)
    transitions = counted(texts, _transition, vocabulary.contexts, attention.CONTEXTS * size, size)
    prior = attention.Prior.of(transitions.reshape(attention.CONTEXTS, size), vocabulary)
    some = W.hashed_sample(learn.select("doc_id", "ids"), F.xxhash64("doc_id"), sample_docs).collect()
    ids = [np.frombuffer(r["ids"], id_type(size)) for r in some]
    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
    ids = np.concatenate([np.zeros(0, id_type(size)), *ids])
    weights = train(texts, vocabulary, prior, attention.first_weights(vocabulary, prior, ends, ids, steps=steps))
    shared = spark.sparkContext.broadcast(attention.Model(vocabulary, prior, weights).arrays())
    documents = scan.where(F.col("kind") == DOCUMENT).select(
        "doc_id", "text_key", "held_out", "n_words", "ids"
    )
    scored = documents.withColumn("_row", F.struct("doc_id", "text_key", "held_out", "n_words")).mapInArrow(
        _score(shared),
        "_row struct<doc_id: long, text_key: long, held_out: boolean, n_words: long>, score double, n_subwords long",
    ).select("_row.*", "score", "n_subwords")
    base = word_scores(rows.select("doc_id", "text", "text_key"), words, frequent)
    base = base.withColumnsRenamed({"doc_id": "_doc", "text_key": "_text"})
    norm = float(np.log10(n + SMALL * (v + 1)))
    both = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_text"))
    tokens = F.col("n_words") + 1
    return scored.join(base, both).select(
        "doc_id", "held_out", tokens.alias("n_tokens"),
        (F.col("n_known") + F.lit(int(end > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(float(np.log10(end + SMALL))) - tokens * F.lit(norm)).alias("base_score"),
        "score", "n_subwords",
    )
