"""Best-two-fit packing of whole documents into sequences of a fixed number of tokens.

Texts are tokenised once, where they are scanned; only lengths and checksums of the pieces go
on. Pieces are dealt to blocks of some thousand sequences by a hash, whatever their source is,
and each block is packed on its own: bins are filled greedily, largest fitting piece first;
then the smallest piece of the bin is taken out again if two unpacked pieces fill the wider
gap more tightly. A block leaves one sequence partly filled, so the loss by blocks is under one
sequence in ``BLOCK_SEQUENCES``.

Nulls and odd cases: a null text is an empty one and gives the end id alone. Rows that repeat a
doc_id or a whole row are packed each on their own. A null doc_id is kept. An empty table gives
no rows. Further columns are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from grainmill.llm import words as W

CAPACITY = 4096
END_ID = 1
BLOCK_SEQUENCES = 4096
# Words a worker remembers with their ids; when they are full, those of the step at hand stay.
REMEMBERED_WORDS = 250_000
# Words that are encoded as one text, with a special token after each.
JOINED_WORDS = 64
# Letters and the marks after them are pieces apart in any case; a space between them lets
# "end" and "end." share what is remembered. Left out are letters that the tokenizer's
# normaliser turns into a letter and a combining mark (U+0130 among these ranges has one), as such
# a mark and those after it are one piece.
LETTERS_MARKS = (
    r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{391}-\x{3A1}\x{3A3}-\x{3F5}"
    r"\x{400}-\x{481}\x{48A}-\x{52F}])([.,!?*$%&#:;()-])"
)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"

def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """The ids of distinct words, each encoded once while a worker lives.

    For tokenizers that lower-case, drop white space, and end a piece between letters and
    marks: then the ids of a text are those of its words, and of their parts, in turn.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A special token that is found in the text as it is written, and its id.
        self.border = next(
            (
                (token.content, number)
                for number, token in self.tokenizer.get_added_tokens_decoder().items()
                if token.special and not (token.normalized or token.single_word or token.lstrip or token.rstrip)
            ),
            None,
        )
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def _encode(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words end to end, and how many each has.

        Many words are one text with a special token after each, which costs less than a text each;
        the pieces between special tokens are encoded on their own.
        """
        texts = names
        if joined := self.border is not None and not any("<|" in w for w in names):
            mark, border = self.border
            groups = [names[a : a + JOINED_WORDS] for a in range(0, len(names), JOINED_WORDS)]
            texts = [mark.join(g) + mark for g in groups]
        # Offsets into the words are not needed; without them the ids come faster.
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum()))
        if not joined:
            return ids, sizes
        own = ids != border
        return ids[own], np.diff(np.flatnonzero(~own), prepend=-1) - 1

    def _store(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        if len(names) != len(sizes):
            raise ValueError(f"{len(sizes)} words came back for {len(names)}")
        self.slots.update(zip(names, range(len(self.slots), len(self.slots) + len(names))))
        self.ids.frombytes(ids.astype(np.uint32).tobytes())
        self.ends.frombytes((self.ends[-1] + np.cumsum(sizes, dtype=np.int64)).tobytes())

    def _gathered(self, slot: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``slot[codes]`` end to end, and how many each has."""
        ends, flat = np.frombuffer(self.ends, np.int64), np.frombuffer(self.ids, np.uint32)
        first, size = ends[slot], (ends[slot + 1] - ends[slot]).astype(np.int32)
        size = size[codes]
        upto = np.cumsum(size, dtype=np.int64)
        # Place of each id: the start of its word's ids, plus the place inside the word.
        place = np.repeat(first[codes] - (upto - size), size)
        place += np.arange(len(place))
        return flat.take(place), size

    def learn(self, names: list[str]) -> None:
        fresh = [w for w in names if w not in self.slots]
        if len(self.slots) + len(fresh) > REMEMBERED_WORDS:
            kept = [w for w in names if w in self.slots]
            slot = np.fromiter(map(self.slots.__getitem__, kept), np.int64, len(kept))
            held = self._gathered(slot, np.arange(len(kept)))
            self.forget()
            self._store(kept, *held)
        # Words that look like special tokens are encoded apart from the others.
        odd = [w for w in fresh if "<|" in w]
        plain = [w for w in fresh if "<|" not in w] if odd else fresh
        for group in (plain, odd):
            for a in range(0, len(group), 4096):
                part = group[a : a + 4096]
                self._store(part, *self._encode(part))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (rows + 1) and the ids of all rows."""
        # Special tokens are found in the text as it is written, so such texts stay unchanged.
        special = pc.match_substring(texts, "<|")
        texts = pc.if_else(special, texts, W.lower_ascii(texts))
        texts = pc.replace_substring_regex(texts, pattern=LETTERS_MARKS, replacement=r"\1 \2")
        offsets, codes, distinct = W.coded_words(texts)
        names = distinct.to_pylist()
        self.learn(names)
        slot = np.fromiter(map(self.slots.__getitem__, names), dtype=np.int64, count=len(names))
        ids, size = self._gathered(slot, codes)
        return np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[offsets], ids


_memory: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _memory:
        _memory[path] = WordIds(path)
    return _memory[path]


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        for whole in batches:
            for batch in W.steps(whole):
                ends, ids = known.of(batch.column("text"))
                rows: list[tuple[int | None, int, int, int, int]] = []
                for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                    own = np.append(ids[ends[k] : ends[k + 1]], np.uint32(end_id)).astype("<u4")
                    for i, a in enumerate(range(0, len(own), capacity)):
                        part = own[a : a + capacity]
                        rows.append((doc, i, a, len(part), zlib.crc32(part.tobytes())))
                columns = list(zip(*rows)) or [[]] * 5
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(columns, types)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def token_pieces(
    docs: DataFrame, path: str, *, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every text, cut after each ``capacity`` ids."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, end_id), PIECES)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A bin number and the offset in the bin of each length (1 to capacity)."""
    order = np.argsort(-lengths, kind="stable")
    by_length: dict[int, list[int]] = {}
    for i in order[::-1]:
        by_length.setdefault(int(lengths[i]), []).append(int(i))
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, items in by_length.items():
        left[size] = len(items)
    # floor_of[g]: the largest length at hand that is not above g; 0 if there is none.
    floor_of = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))

    def take(size: int) -> int:
        left[size] -= 1
        if not left[size]:
            end = size
            below = int(floor_of[size - 1])
            while end <= capacity and floor_of[end] == size:
                end += 1
            floor_of[size:end] = below
        return by_length[size].pop()

    def put_back(item: int, size: int) -> None:
        by_length[size].append(item)
        left[size] += 1
        if left[size] == 1:
            np.maximum(floor_of[size:], size, out=floor_of[size:])

    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    number = 0
    while (size := int(floor_of[capacity])) > 0:
        members, gap = [], capacity
        while size:
            members.append((take(size), size))
            gap -= size
            size = int(floor_of[gap])
        if gap and len(members) > 1:
            item, smallest = members[-1]
            room = gap + smallest
            firsts = np.flatnonzero(left[: room // 2 + 1])
            if len(firsts):
                seconds = floor_of[room - firsts]
                # A pair of two equal lengths needs two of them.
                seconds = np.where(
                    (seconds == firsts) & (left[firsts] < 2), floor_of[firsts - 1], seconds
                )
                sums = np.where(seconds > 0, firsts + seconds, 0)
                best = int(np.argmax(sums))
                if sums[best] > smallest:
                    members.pop()
                    for one in (int(firsts[best]), int(seconds[best])):
                        members.append((take(one), one))
                    put_back(item, smallest)
        at = 0
        for i, length in members:
            bins[i], offsets[i] = number, at
            at += length
        number += 1
    return bins, offsets


def _pack(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("_order", "doc_id", "piece", "ids_crc32")])
        bins, offsets = best_two_fit(table.column("length").to_numpy(), capacity)
        numbers = bins + (key[0].as_py() << 32)
        out = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return out.append_column("sequence_id", pa.array(numbers)).append_column(
            "offset", pa.array(offsets)
        )

    return run


def pack_pieces(
    pieces: DataFrame, *, capacity: int = CAPACITY, block_sequences: int = BLOCK_SEQUENCES
) -> DataFrame:
    """Add ``sequence_id`` and ``offset``. ``pieces`` is read twice, so it has to be a table.

    Rows are dealt by their place in the table, so equal rows go to different blocks.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, -(-total // (capacity * block_sequences)))
    order = F.xxhash64(F.monotonically_increasing_id())
    dealt = pieces.withColumn("_order", order).withColumn("_block", F.pmod("_order", F.lit(blocks)))
    return dealt.groupBy("_block").applyInArrow(_pack(capacity), PACKED)


def pack_documents(
    docs: DataFrame,
    *,
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    block_sequences: int = BLOCK_SEQUENCES,
) -> DataFrame:
    """Pieces of all documents with the sequence and the offset each one is packed at."""
    pieces = token_pieces(docs, path or tokenizer_path(), capacity=capacity, end_id=end_id)
    return pack_pieces(
        W.bounded_rows(pieces, "pieces"), capacity=capacity, block_sequences=block_sequences
    )
