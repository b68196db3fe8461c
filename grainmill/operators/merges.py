"""Pair merges of all distinct words of a batch at once.

Words of one length class are the rows of an array of symbols. Each round finds the best pair of
every word (leftmost on ties) and merges it, so a round costs a few array steps for all words.
Pairs are looked up in an open-addressed table of numpy arrays. Words of more than LONG
characters are merged one by one with a heap, which takes n log n steps however long they are.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa

NO_PIECE = float("inf")
LONG = 48
# Cells of the array of symbols that one step holds.
CELLS = 1 << 18
# Words and tokens that a task remembers; beyond that it starts anew.
REMEMBERED_WORDS = 1 << 18
REMEMBERED_TOKENS = 1 << 21

_NONE = np.iinfo(np.int32).max
_UNKNOWN, _GONE = -1, -2
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def merge_pairs(word: str, priority: dict[str, float]) -> list[str]:
    """Merge the best adjacent pair, leftmost on ties, until no pair is a piece.

    The pairs are in a heap, so a text without blanks, which is one long word, takes n log n
    steps.
    """
    parts = list(word)
    after = [*range(1, len(parts)), -1]
    before = list(range(-1, len(parts) - 1))

    def pair(left: int) -> tuple[float, int, str, str]:
        a, b = parts[left], parts[after[left]]
        return priority.get(a + b, NO_PIECE), left, a, b

    heap = [pair(i) for i in range(len(parts) - 1)]
    heapq.heapify(heap)
    while heap:
        best, left, a, b = heapq.heappop(heap)
        right = after[left]
        if best == NO_PIECE or right < 0 or parts[left] != a or parts[right] != b:
            continue  # not a piece, or one of the two has been merged meanwhile
        parts[left], parts[right] = a + b, ""
        after[left] = after[right]
        if after[left] >= 0:
            before[after[left]] = left
            heapq.heappush(heap, pair(left))
        if before[left] >= 0:
            heapq.heappush(heap, pair(before[left]))
    return [p for p in parts if p]


class PairTable:
    """(left symbol, right symbol) -> (rank, merged symbol), for arrays of pairs."""

    def __init__(self, entries: dict[tuple[int, int], tuple[int, int]], n_symbols: int):
        self.n = np.uint64(n_symbols)
        bits = max(4, int(len(entries) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY)
        self.rank = np.full(1 << bits, _NONE, dtype=np.int32)
        self.merged = np.zeros(1 << bits, dtype=np.int32)
        if not entries:
            return
        pairs = np.array(list(entries), dtype=np.uint64)
        values = np.array(list(entries.values()), dtype=np.int32)
        keys = pairs[:, 0] * self.n + pairs[:, 1]
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot[todo]] == _EMPTY
            first = np.unique(slot[todo][free], return_index=True)[1]
            placed = todo[free][first]
            self.keys[slot[placed]] = keys[placed]
            self.rank[slot[placed]], self.merged[slot[placed]] = values[placed].T
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (_NONE if the pair is no piece) and merged symbol of each pair."""
        rank = np.full(len(left), _NONE, dtype=np.int32)
        merged = np.zeros(len(left), dtype=np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[todo].astype(np.uint64) * self.n + right[todo].astype(np.uint64)
        slot = self._slot(key)
        while len(todo):
            held = self.keys[slot]
            hit = held == key
            rank[todo[hit]], merged[todo[hit]] = self.rank[slot[hit]], self.merged[slot[hit]]
            on = ~hit & (held != _EMPTY)
            todo, key, slot = todo[on], key[on], (slot[on] + 1) & self.mask
        return rank, merged


class Merges:
    """Token ids of words, by pieces with a priority (low first; equal ones leftmost first).

    A character without a piece becomes the ids of its UTF-8 bytes, from ``first_byte_id`` on.
    """

    def __init__(self, priority: dict[str, float], ids: dict[str, int], first_byte_id: int):
        self.priority, self.ids, self.first_byte_id = priority, ids, first_byte_id
        symbols = list(ids)
        number = {p: i for i, p in enumerate(symbols)}
        for char in sorted({c for p in symbols for c in p if c not in number}):
            number[char] = len(symbols)
            symbols.append(char)
        place = {s: i for i, s in enumerate(sorted({priority[p] for p in ids}))}
        entries = {}
        for piece in ids:
            value = (place[priority[piece]], number[piece])
            for k in range(1, len(piece)):
                left, right = number.get(piece[:k]), number.get(piece[k:])
                if left is not None and right is not None:
                    entries[left, right] = value
        self.pairs = PairTable(entries, len(symbols))
        self.char = np.full(0x110000, _UNKNOWN, dtype=np.int32)
        for symbol, i in number.items():
            if len(symbol) == 1:
                self.char[ord(symbol)] = i
        self.id_of = np.array([ids.get(s, -1) for s in symbols], dtype=np.int32)
        self.bytes_of = np.array([len(s.encode("utf-8", "surrogatepass")) for s in symbols], dtype=np.int32)

    def _merged(self, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols (words x longest word) after all merges; _GONE where nothing is left."""
        rows, width = len(sizes), int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        cells = np.full((rows, width + 1), _GONE, dtype=np.int32)
        cells[:, :-1][inside] = self.char[chars]
        after = np.broadcast_to(np.arange(1, width + 2, dtype=np.int16), cells.shape).copy()
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int16), cells.shape).copy()
        ranks = self.pairs.find(cells[:, :-1].ravel(), cells[:, 1:].ravel())[0]
        ranks = np.concatenate([ranks.reshape(rows, width), np.full((rows, 1), _NONE, np.int32)], axis=1)
        act = np.arange(rows)
        while len(act):
            at = ranks.argmin(axis=1)
            live = ranks[np.arange(len(act)), at] < _NONE
            if not live.all():
                act, ranks, at = act[live], ranks[live], at[live]
                if not len(act):
                    break
            here = np.arange(len(act))
            right = after[act, at]
            merged = self.pairs.find(cells[act, at], cells[act, right])[1]
            cells[act, at], cells[act, right] = merged, _GONE
            beyond = np.minimum(after[act, right], width)
            after[act, at] = beyond
            before[act, beyond] = at
            ranks[here, right] = _NONE
            ranks[here, at] = self.pairs.find(merged, cells[act, beyond])[0]
            prior = before[act, at]
            inner = np.flatnonzero(prior >= 0)
            ranks[inner, prior[inner]] = self.pairs.find(cells[act[inner], prior[inner]], merged[inner])[0]
        return cells[:, :-1]

    def _tokens(
        self, symbols: np.ndarray, chars: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of tokens of each symbol, and the ids and byte lengths of all tokens.

        Of the bytes of a character without a piece the last one stands for the character; the
        others have the length 0.
        """
        ids = np.where(symbols >= 0, self.id_of[symbols], -1)
        lengths = np.where(symbols >= 0, self.bytes_of[symbols], 0)
        lost = np.flatnonzero(ids < 0)
        counts = np.ones(len(symbols), dtype=np.int64)
        if not len(lost):
            return counts, ids, lengths
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in chars[lost].tolist()]
        counts[lost] = [len(r) for r in raw]
        ids, lengths = np.repeat(ids, counts), np.repeat(lengths, counts)
        spread = np.repeat(np.isin(np.arange(len(counts)), lost), counts)
        ids[spread] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32) + self.first_byte_id
        ends = np.cumsum(counts)[lost] - 1
        lengths[spread] = 0
        lengths[ends] = counts[lost]
        return counts, ids.astype(np.int32), lengths.astype(np.int32)

    def _one(self, word: str) -> tuple[list[int], list[int]]:
        ids, lengths = [], []
        for part in merge_pairs(word, self.priority):
            found = self.ids.get(part)
            raw = part.encode("utf-8", "surrogatepass")
            if found is None:
                ids += [self.first_byte_id + b for b in raw]
                lengths += [0] * (len(raw) - 1) + [len(raw)]
            else:
                ids.append(found)
                lengths.append(len(raw))
        return ids, lengths

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first token, number of tokens) of each word; id and byte length of each token."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        first, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        ids, lengths, at = [np.empty(0, np.int32)], [np.empty(0, np.int32)], 0
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        short = order[sizes[order] <= LONG]
        a = 0
        while a < len(short):
            # Words of nearly one length share an array.
            width = min(LONG, int(sizes[short[a]]) + 2)
            b = a + min(
                max(1, CELLS // width), int(np.searchsorted(sizes[short[a:]], width, side="right"))
            )
            part, a = short[a:b], b
            joined = "".join([words[i] for i in part.tolist()])
            chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            cells = self._merged(chars, sizes[part])
            left = cells != _GONE
            row = np.repeat(np.arange(len(part)), left.sum(axis=1))
            column = np.nonzero(left)[1]
            starts = np.cumsum(sizes[part]) - sizes[part]
            n, one_ids, one_lengths = self._tokens(cells[left], chars[starts[row] + column])
            count[part] = np.bincount(row, weights=n, minlength=len(part)).astype(np.int64)
            first[part] = at + np.cumsum(count[part]) - count[part]
            ids.append(one_ids)
            lengths.append(one_lengths)
            at += len(one_ids)
        for i in order[len(short) :].tolist():
            word_ids, word_lengths = self._one(words[i])
            first[i], count[i] = at, len(word_ids)
            ids.append(np.array(word_ids, np.int32))
            lengths.append(np.array(word_lengths, np.int32))
            at += len(word_ids)
        return first, count, np.concatenate(ids), np.concatenate(lengths)


class WordTokens:
    """Tokens of words, each encoded once while it is remembered."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.used = 0
        self.ids, self.lengths = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)
        self.first, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _room(self, names: tuple[str, ...], needed: int) -> None:
        for name in names:
            held = getattr(self, name)
            if len(held) < needed:
                grown = np.empty(max(needed, 2 * len(held)), held.dtype)
                grown[: len(held)] = held
                setattr(self, name, grown)

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(first token, number of tokens) of each word; they lie in ``ids`` and ``lengths``."""
        fresh = list(dict.fromkeys(w for w in words if w not in self.slots))
        if len(self.slots) + len(fresh) > REMEMBERED_WORDS or self.used > REMEMBERED_TOKENS:
            self.forget()
            fresh = list(dict.fromkeys(words))
        if fresh:
            first, count, ids, lengths = self.merges.encode(fresh)
            n, used = len(self.slots), self.used
            self._room(("ids", "lengths"), used + len(ids))
            self._room(("first", "count"), n + len(fresh))
            self.ids[used : used + len(ids)], self.lengths[used : used + len(ids)] = ids, lengths
            self.first[n : n + len(fresh)], self.count[n : n + len(fresh)] = first + used, count
            self.slots.update(zip(fresh, range(n, n + len(fresh))))
            self.used += len(ids)
        slot = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        return self.first[slot], self.count[slot]


def split_marked(flat: np.ndarray, ends: np.ndarray, mark: str) -> tuple[np.ndarray, pa.Array]:
    """Words of marked texts that lie end to end in ``flat``: runs of the mark and what follows.

    Gives the offsets (rows + 1) of each text into its words, and the words.
    """
    a, b, c = mark.encode()
    starts = np.zeros(len(flat) + 1, dtype=bool)
    if len(flat) >= 3:
        marks = np.flatnonzero((flat[:-2] == a) & (flat[1:-1] == b) & (flat[2:] == c))
        starts[marks] = True
        starts[marks[1:][np.diff(marks) == 3]] = False
    full = np.diff(ends) > 0
    starts[ends[:-1][full]] = True
    starts[len(flat)] = False
    places = np.flatnonzero(starts)
    offsets = np.append(places, len(flat)).astype(np.int32)
    words = pa.Array.from_buffers(
        pa.string(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]
    )
    return np.searchsorted(places, ends), words


def gather(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of the tokens of one word after another."""
    upto = np.cumsum(count)
    total = int(upto[-1]) if len(upto) else 0
    return np.arange(total) + np.repeat(first - (upto - count), count)


def marked_tokens(
    known: WordTokens, flat: np.ndarray, ends: np.ndarray, mark: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets (rows + 1) into the tokens of marked texts, and their ids and byte lengths."""
    word_ends, words = split_marked(flat, ends, mark)
    coded = words.dictionary_encode()
    first, count = known.find(coded.dictionary.to_pylist())
    codes = coded.indices.to_numpy(zero_copy_only=False)
    places = gather(first[codes], count[codes])
    upto = np.concatenate(([0], np.cumsum(count[codes])))
    return upto[word_ends], known.ids[places], known.lengths[places]
