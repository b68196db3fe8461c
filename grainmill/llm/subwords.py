"""Subword encoding by a compiled model, with the byte span of each piece, and decoding.

A text is normalised by longest-prefix matches in the model's compiled character map (a double
array of 32-bit units, walked for all byte positions of a batch at once); the origin of every
normalised byte is kept. Pieces of all distinct words of the batch are merged at once
(``operators/merges.py``), and the origins at their borders are their spans in the text.

Ids, spans and decoded texts are those of the sentencepiece library without begin or end ids and
without sampling. Models of merged pairs with byte fallback are read; others are refused.

Nulls and odd cases: a null text is an empty one, and an empty text has no ids and decodes to the
empty text. Each row is encoded on its own, so repeated rows and null ids stay as they are. A
text longer than a step is a step of its own; memory is some 60 bytes for each of its bytes. An
empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from grainmill.llm import words as W
from grainmill.operators.merges import Merges, WordTokens, marked_tokens

MARK = "▁"
STEP_BYTES = 1 << 20
# Ids that one step decodes; a longer row is a step of its own.
STEP_IDS = 1 << 18
ENCODED = "doc_id long, ids array<int>, begins array<int>, ends array<int>"
UNKNOWN_TEXT = " ⁇ "

# Kinds of pieces, as numbered in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGED_PAIRS = 2


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one message; numbers as ints, all else as bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
            yield tag >> 3, value
            continue
        if tag & 7 == 2:
            size, at = number(at)
        else:
            size = 8 if tag & 7 == 1 else 4
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    charsmap: bytes = b""
    dummy_prefix: bool = True
    fewer_spaces: bool = True
    mark_spaces: bool = True


def read_model(data: bytes) -> Model:
    """The parts of a model file that encoding and decoding need."""
    model, kind, fallback, suffix = Model([], [], []), 1, False, False
    for number, value in _fields(data):
        if number == 1:  # a piece
            one = dict(_fields(value))
            model.pieces.append(one.get(1, b"").decode())
            model.scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
            model.kinds.append(one.get(3, NORMAL))
        elif number == 2:  # how it was trained
            one = dict(_fields(value))
            kind, fallback = one.get(3, 1), bool(one.get(35, 0))
            suffix = bool(one.get(24, 0))
        elif number == 3:  # the normaliser
            one = dict(_fields(value))
            model.charsmap = one.get(2, b"")
            model.dummy_prefix = bool(one.get(3, 1))
            model.fewer_spaces = bool(one.get(4, 1))
            model.mark_spaces = bool(one.get(5, 1))
    if model.pieces and (kind != MERGED_PAIRS or not fallback or suffix):
        raise ValueError("only models of merged pairs with byte fallback and marks in front are read")
    if set(model.kinds) & {USER_DEFINED, UNUSED}:
        raise ValueError("models with unused or user-defined pieces are not read")
    return model


class CharMap:
    """The compiled character map: longest prefixes at every place of a text, and what they become."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
        self.values = np.frombuffer(blob, np.uint8, offset=4 + size)
        ends = np.flatnonzero(self.values == 0)
        self.ends = np.append(ends, len(self.values))

    def _jump(self, unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, flat: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest key at each place (0: none), before ``stops``, and its value."""
        found, value = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        # Places that start no character start no key.
        places = np.flatnonzero((flat & 0xC0) != 0x80)
        node = np.full(len(places), self._jump(self.units[:1])[0])
        depth = 0
        while len(places):
            inside = places + depth < stops[places]
            places, node = places[inside], node[inside]
            byte = flat[places + depth].astype(np.int64)
            node = node ^ byte
            unit = self.units[np.minimum(node, len(self.units) - 1)]
            on = (node < len(self.units)) & ((unit & 0x800000FF) == byte)
            places, node, unit = places[on], node[on], unit[on]
            node = node ^ self._jump(unit)
            depth += 1
            leaf = ((unit >> 8) & 1).astype(bool)
            found[places[leaf]] = depth
            value[places[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        return found, value

    def sizes(self, value: np.ndarray) -> np.ndarray:
        return self.ends[np.searchsorted(self.ends, value)] - value


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    upto = np.cumsum(count)
    total = int(upto[-1]) if len(upto) else 0
    return np.arange(total) + np.repeat(first - (upto - count), count)


@dataclass
class Normalised:
    flat: np.ndarray  # bytes of all texts, end to end
    ends: np.ndarray  # offsets (rows + 1)
    origin: np.ndarray  # place in its text of each byte, and one more place after each text
    origin_at: np.ndarray  # where the origins of each row begin


class Normaliser:
    def __init__(self, model: Model):
        self.model = model
        self.map = CharMap(model.charsmap) if model.charsmap else None

    def _mapped(
        self, flat: np.ndarray, ends: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes after the character map, the origin of each, where units begin, and row ends.

        The last array tells which bytes of the texts became a single space.
        """
        origin = np.arange(len(flat))
        if self.map is None:
            return flat, origin, np.ones(len(flat), bool), ends, flat == 0x20
        found, value = self.map.longest(flat, np.repeat(ends[1:], np.diff(ends)))
        covered = np.zeros(len(flat), bool)
        heads = np.flatnonzero(found)
        wide = heads[found[heads] > 1]
        starts_char = (flat & 0xC0) != 0x80
        for p in wide.tolist():  # a key inside an earlier key is no match
            if not covered[p]:
                covered[p + 1 : p + found[p]] = True
        heads = heads[~covered[heads]]
        sizes, first = np.ones(len(flat), np.int64), origin.copy()
        sizes[covered] = 0
        sizes[heads] = self.map.sizes(value[heads])
        first[heads] = len(flat) + value[heads]
        blank = flat == 0x20
        blank[heads] = (sizes[heads] == 1) & (self.map.values[value[heads]] == 0x20)
        blank[_spread(heads, found[heads])] = np.repeat(blank[heads], found[heads])
        places = _spread(first, sizes)
        source = np.repeat(origin, sizes)
        # Bytes after the first of a character that is no key belong to its unit.
        upto = np.cumsum(sizes)
        begins = np.zeros(len(places), bool)
        units = np.flatnonzero((sizes > 0) & starts_char)
        begins[(upto - sizes)[units]] = True
        row_ends = np.concatenate(([0], upto))[ends]
        return np.concatenate([flat, self.map.values])[places], source, begins, row_ends, blank

    def _fewer_spaces(
        self, raw: np.ndarray, begins: np.ndarray, row: np.ndarray
    ) -> np.ndarray:
        """Which bytes stay when spaces that follow a space, or begin a text, go."""
        if not len(raw):
            return np.ones(0, bool)
        space = raw == 0x20
        unit = np.cumsum(begins) - 1
        starts = np.flatnonzero(begins)
        last = np.append(starts[1:], len(raw)) - 1
        follows = np.ones(len(starts), bool)
        follows[1:] = space[last[:-1]] | (row[starts[1:]] != row[last[:-1]])
        inner = np.cumsum(~space)
        before = (inner - ~space)[starts]
        leading = space & (inner == before[unit])
        return ~(leading & follows[unit])

    def normalise(self, flat: np.ndarray, ends: np.ndarray) -> Normalised:
        """All texts, which lie end to end in ``flat``; ``ends`` are their offsets (rows + 1)."""
        rows, model = len(ends) - 1, self.model
        raw, origin, begins, raw_ends, blank = self._mapped(flat, ends)
        row = np.repeat(np.arange(rows), np.diff(raw_ends))
        begin, stop = ends[:-1].copy(), ends[1:].copy()
        live = stop > begin
        if model.fewer_spaces:
            keep = self._fewer_spaces(raw, begins, row)
            # The mark in front stands after the leading units that are a space.
            text = np.append(np.flatnonzero(~blank), len(flat))
            begin = np.minimum(text[np.searchsorted(text, begin)], stop)
            raw, origin, row = raw[keep], origin[keep], row[keep]
            live = begin < stop
        gone = ~live[row]
        raw, origin, row = raw[~gone], origin[~gone], row[~gone]
        if model.dummy_prefix:
            at = np.searchsorted(row, np.flatnonzero(live))
            raw = np.insert(raw, at, 0x20)
            origin = np.insert(origin, at, begin[live])
            row = np.insert(row, at, np.flatnonzero(live))
        if model.mark_spaces:
            space = raw == 0x20
            size = np.where(space, 3, 1)
            out = np.repeat(raw, size)
            at = (np.cumsum(size) - size)[space]
            out[at], out[at + 1], out[at + 2] = MARK.encode()
            raw, origin, row = out, np.repeat(origin, size), np.repeat(row, size)
        upto = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows))))
        if model.fewer_spaces:
            mark = MARK.encode() if model.mark_spaces else b" "
            keep, whole = np.ones(len(raw), bool), raw.tobytes()
            for k in np.flatnonzero(np.diff(upto) > 0).tolist():
                a, b = int(upto[k]), int(upto[k + 1])
                while b - len(mark) >= a and whole.endswith(mark, a, b):
                    b -= len(mark)
                if b < upto[k + 1]:
                    stop[k] = origin[b]
                    keep[b : upto[k + 1]] = False
            raw, origin, row = raw[keep], origin[keep], row[keep]
            upto = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows))))
        places = np.insert(origin, upto[1:], np.where(live, stop, ends[:-1]))
        starts = upto[:-1] + np.arange(rows)
        places -= np.repeat(ends[:-1], np.diff(upto) + 1)
        return Normalised(np.ascontiguousarray(raw), upto, places.astype(np.int32), starts)


def flat_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, end to end, and their offsets (rows + 1); null is empty."""
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    ends = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    flat = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return flat[ends[0] : ends[-1]], ends - ends[0]


class Codec:
    """Encodes and decodes batches of texts by one model."""

    def __init__(self, model: Model):
        self.model, self.normaliser = model, Normaliser(model)
        ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL}
        crossing = [p for p in ids if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces reach over a word border: {crossing[:3]}")
        bytes_of = [i for i, k in enumerate(model.kinds) if k == BYTE]
        if [model.pieces[i] for i in bytes_of] != [f"<0x{b:02X}>" for b in range(256)] or (
            bytes_of != list(range(bytes_of[0], bytes_of[0] + 256))
        ):
            raise ValueError("the 256 byte pieces must be in order")
        self.first_byte = bytes_of[0]
        self.ids = ids
        # What each id decodes to, end to end; a mark in front may be left out.
        raw = []
        for piece, kind in zip(model.pieces, model.kinds):
            text = piece.replace(MARK, " ")
            text = {CONTROL: "", UNKNOWN: UNKNOWN_TEXT, BYTE: "?"}.get(kind, text)
            raw.append(text.encode())
        for b in range(256):
            raw[self.first_byte + b] = bytes([b])
        self.out = np.frombuffer(b"".join(raw), np.uint8)
        self.out_size = np.array([len(r) for r in raw], np.int64)
        self.out_at = np.cumsum(self.out_size) - self.out_size
        self.marked = np.array(
            [k == NORMAL and p.startswith(MARK) for p, k in zip(model.pieces, model.kinds)]
        )
        self.is_byte = np.array([k == BYTE for k in model.kinds])
        self.is_control = np.array([k == CONTROL for k in model.kinds])

    @cached_property
    def known(self) -> WordTokens:
        priority = {p: -self.model.scores[i] for p, i in self.ids.items()}
        return WordTokens(Merges(priority, self.ids, self.first_byte))

    def encode(
        self, texts: pa.Array
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Offsets (rows + 1), ids, and first byte and end in its text of each piece."""
        flat, ends = flat_texts(texts)
        normal = self.normaliser.normalise(flat, ends)
        upto, ids, sizes = marked_tokens(self.known, normal.flat, normal.ends, MARK)
        counts = np.diff(upto)
        # The end of each piece in the normalised bytes of all rows, then in the origins.
        after = np.cumsum(sizes, dtype=np.int64)
        shift = np.repeat(normal.origin_at - normal.ends[:-1], counts)
        return upto, ids, normal.origin[after - sizes + shift], normal.origin[after + shift]

    def decode(self, upto: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The text of each row of ids; ids outside the vocabulary stand for the unknown piece."""
        unknown = self.model.kinds.index(UNKNOWN)
        ids = np.where((ids >= 0) & (ids < len(self.out_size)), ids, unknown)
        first, size = self.out_at[ids], self.out_size[ids]
        if self.model.dummy_prefix or self.model.fewer_spaces:
            self._leave_marks_out(upto, ids, first, size)
        data = self.out[_spread(first, size)]
        after = np.concatenate(([0], np.cumsum(size)))[upto]
        offsets = pa.py_buffer(after)
        texts = pa.Array.from_buffers(
            pa.large_string(), len(upto) - 1, [None, offsets, pa.py_buffer(data)]
        )
        if self.is_byte[ids].any():
            # Control pieces put out nothing, but no character reaches over them.
            breaks = np.concatenate(([0], np.cumsum(size)))[np.flatnonzero(self.is_control[ids])]
            try:
                texts.validate(full=True)
            except pa.ArrowInvalid:
                breaks = np.append(breaks, -1)
            if len(breaks):
                whole, cuts = data.tobytes(), np.unique(np.concatenate([after, breaks[breaks >= 0]]))
                parts = [_lenient(whole[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
                at = np.searchsorted(cuts, after).tolist()
                return pa.array(["".join(parts[a:b]) for a, b in zip(at, at[1:])], pa.string())
        return texts.cast(pa.string())

    def _leave_marks_out(
        self, upto: np.ndarray, ids: np.ndarray, first: np.ndarray, size: np.ndarray
    ) -> None:
        """Take the mark off the first piece of each row that puts out text.

        Control pieces in front put out nothing. If spaces are fewer, marks go as long as there
        is no text.
        """
        at, ends = upto[:-1].copy(), upto[1:]
        todo = np.flatnonzero(at < ends)
        while len(todo):
            here = at[todo]
            marked = self.marked[ids[here]]
            first[here[marked]] += 1
            size[here[marked]] -= 1
            on = size[here] == 0
            if not self.model.fewer_spaces:
                on &= ~marked
            at[todo] += 1
            todo = todo[on]
            todo = todo[at[todo] < ends[todo]]


def _lenient(data: bytes) -> str:
    """UTF-8 where each byte that is no part of a character becomes one replacement character."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a model file, built once while a worker lives."""
    if path not in _codecs:
        with open(path, "rb") as file:
            _codecs[path] = Codec(read_model(file.read()))
    return _codecs[path]


def _int_lists(upto: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(values, pa.int32()))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for whole in batches:
            for batch in W.steps(whole, limit=STEP_BYTES):
                upto, *values = known.encode(batch.column("text"))
                lists = [_int_lists(upto, v) for v in values]
                yield pa.record_batch(
                    [batch.column("doc_id"), *lists], names=["doc_id", "ids", "begins", "ends"]
                )

    return run


def encode_documents(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every text, and the span in its UTF-8 bytes that each piece stands for.

    Of the byte pieces of one character the last one has its span; the others are empty.
    """
    W.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_encode(path or model_path()), ENCODED)


def decoder(path: str | None = None) -> Callable[[Column], Column]:
    """Ids column -> text column; null ids give null."""
    place = path or model_path()

    def part(rows: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        upto = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        texts = codec(place).decode(upto, rows.flatten().to_numpy(zero_copy_only=False))
        return pc.if_else(rows.is_null(), None, texts)

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        step = np.cumsum(sizes, dtype=np.int64) // STEP_IDS
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(rows)]
        texts = [part(rows[a:b]) for a, b in zip(cuts, cuts[1:])]
        return pa.concat_arrays([pa.array([], pa.string()), *texts])

    return decode


def round_trip(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """Digests of the ids of every text and of what they decode to.

    ``n_spanned`` counts the bytes of the text that the spans of its pieces stand for.
    """
    spanned = F.aggregate(
        F.zip_with("begins", "ends", lambda a, b: (b - a).cast("long")),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    return encode_documents(docs, path=path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decoder(path)(F.col("ids")).cast("binary"), 256).alias("decoded_sha256"),
        spanned.alias("n_spanned"),
    )
