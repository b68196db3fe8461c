"""Exact Jaccard join on word n-grams: size-banded tiles with bitmap signatures.

1. Each text becomes the set of its distinct n-gram hashes. Two sets that link must share a
   member among the first ``n - ceil(share * n) + 1`` of each in any common order. The order puts
   the lower half of all hashes first, and of these the members that the fewest sets hold. Members
   of one set alone meet nobody; a text that is edited beyond the threshold has no others among its
   first ones and drops out. How many sets hold a member is counted exactly: each task sends the
   lower half of its members, as sorted gaps, to parts of the hash range; a part sends back those
   that it got twice. Parts and tasks grow in number with the data, not in size.
2. Sets that share a first member meet in tiles of one size band (a set also visits the next
   band). Each set has a bitmap of hashed members; members that one bitmap has and the other
   lacks cannot be shared, so bit counts bound the overlap from above. What passes is decided by
   intersecting the sorted members, taken anew from the texts.
3. Links are needed up to reachability. So sets first meet the plainest set of their tiles, that
   with the fewest members of its own; then, of any two components, the pairs that the bitmaps
   favour most. Sets that this connects need no comparison with one another, however large a
   group of near copies is. At last every pair of a tile that may link, is not connected and has
   not been tried is decided. Tiles with the same sets are one tile, and large ones are cut in
   blocks.

Documents with equal sets are one set throughout, so groups of exact copies of any size cost one
row. A set is known by a 64-bit hash of its members, a member by a 64-bit hash of its words.

Nulls and odd cases: a null text, or one without words, has no set, links with nothing and is
its own component. Fewer than n words are one member. A null doc_id takes part; a component's id
is the smallest doc_id that is not null. Repeated rows have equal sets and are linked. An empty
table gives no rows. Further columns are kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.llm import sketch, words as W
from grainmill.llm.components import components

N = 4
PERCENT = 85
LEAST_BITS, MOST_BITS = 64, 1 << 15
TILE_SETS = 2048
STARS, FAVOURED = 2, 3
# Bits by which a part tells members apart; with fewer, more sets meet and none are lost.
MEMBER_BITS = 32
# Members that a task sends at once, and members of a part, about.
SENT_MEMBERS, PART_MEMBERS = 1 << 20, 1 << 20

PROFILE = "doc_id long, text_key long, n_shingles long, set_id long"
SENT = "part int, step long, data binary"


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1), and the sorted distinct n-gram hashes of each row."""
    offsets, codes, distinct = W.coded_words(W.lower_ascii(pc.fill_null(texts, "")))
    hashes = W.word_hashes(distinct)[0][codes]
    grams = W.ngram_hashes(hashes, n)
    sets = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= n:
            sets.append(np.unique(grams[a : b - n + 1]))
        else:
            sets.append(W.ngram_hashes(hashes[a:b], b - a) if b > a else grams[:0])
    ends = np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))
    return ends, np.concatenate(sets) if sets else np.empty(0, np.uint64)


def bitmap(members: np.ndarray) -> bytes:
    """Hashed members; a larger map folds onto a smaller one by halves."""
    width = min(MOST_BITS, max(LEAST_BITS, 1 << int(4 * len(members) - 1).bit_length()))
    bits = np.zeros(width, dtype=bool)
    bits[(W.mixed(members) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _set_ids(ends: np.ndarray, grams: np.ndarray) -> list[int | None]:
    """A 64-bit hash of each row's members; None without members."""
    import xxhash

    return [
        xxhash.xxh3_64_intdigest(grams[a:b].tobytes()) - (1 << 63) if b > a else None
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())
    ]


def _profiles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for step in W.steps(whole):
                ends, grams = gram_sets(step.column("text"), n)
                yield pa.record_batch(
                    [
                        step.column("doc_id"), step.column("text_key"), pa.array(np.diff(ends)),
                        pa.array(_set_ids(ends, grams), pa.int64()),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "set_id"],
                )

    return run


def profiles(docs: DataFrame, *, n: int = N) -> DataFrame:
    """Size and set id of each document's set."""
    W.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", W.text_key().alias("text_key")).mapInArrow(_profiles(n), PROFILE)


def _packed(*columns: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 32, by planes of bytes; the upper planes are compressed."""
    codec, out = pa.Codec("zstd", 1), []
    for values in columns:
        planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        upper = codec.compress(planes[1:].tobytes(), asbytes=True)
        out += [np.array([len(values), len(upper)], "<u4").tobytes(), planes[0].tobytes(), upper]
    return b"".join(out)


def _unpacked(data: bytes) -> list[np.ndarray]:
    codec, at, out = pa.Codec("zstd", 1), 0, []
    while at < len(data):
        size, upper = np.frombuffer(data, "<u4", 2, at).tolist()
        planes = np.empty((4, size), np.uint8)
        planes[0] = np.frombuffer(data, np.uint8, size, at + 8)
        at += 8 + size
        rest = codec.decompress(data[at : at + upper], 3 * size, asbytes=True)
        planes[1:] = np.frombuffer(rest, np.uint8).reshape(3, size)
        at += upper
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
    return out


def _gaps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def _halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (values >> 32) & 0xFFFFFFFF, values & 0xFFFFFFFF


def first_members(sizes: np.ndarray, percent: int) -> np.ndarray:
    """So many of the first members of a set are needed to meet all sets that it may link with."""
    return sizes - -(-percent * sizes // 100) + 1


def _sent(n: int, percent: int, part_bits: int, bits: int):
    """The members of all sets by parts of the hash range, and for each step its sets (part < 0).

    Of a set these are its members in the lower half of all hashes and, if they are too few, those
    that come next.
    """
    low, high = np.uint64(1 << 63), np.uint64(64 - 1 - part_bits - bits)

    def rows(step: int, ids: list[int], found: list[tuple]) -> pa.RecordBatch:
        sizes = np.concatenate([f[0] for f in found])
        sent = np.concatenate([f[1] for f in found])
        members = np.concatenate([f[2] for f in found])
        owner = np.repeat(np.arange(len(sent)), sent)
        order = np.argsort(members, kind="stable")
        members, owner = members[order], owner[order]
        new = np.flatnonzero(np.diff(members, prepend=~members[:1]))
        counts = np.diff(np.append(new, len(members)))
        members = members[new]
        part = (members >> np.uint64(bits)).astype(np.int64)
        inner = members & np.uint64((1 << bits) - 1)
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        entry = np.append(new, len(owner))
        parts, data = [-1 - (step >> 32)], [_packed(sizes, sent, *_halves(np.array(ids, np.int64)))]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            parts.append(int(part[a]))
            data.append(_packed(_gaps(inner[a:b]), counts[a:b], owner[entry[a] : entry[b]]))
        return pa.record_batch(
            [pa.array(parts, pa.int32()), pa.array([step] * len(parts), pa.int64()), pa.array(data, pa.binary())],
            names=["part", "step", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = TaskContext.get().partitionId() << 32
        ids, found, seen, held = [], [], set(), 0
        for whole in batches:
            for batch in W.steps(whole):
                ends, grams = gram_sets(batch.column("text"), n)
                sizes = np.diff(ends)
                below = np.concatenate(([0], np.cumsum(grams < low)))
                take = np.maximum(np.diff(below[ends]), np.minimum(sizes, first_members(sizes, percent)))
                # Equal sets of a step are sent once.
                for i, set_id in enumerate(_set_ids(ends, grams)):
                    if set_id is None or set_id in seen:
                        take[i] = 0
                    else:
                        seen.add(set_id)
                        ids.append(set_id)
                row = np.repeat(np.arange(len(sizes)), sizes)
                sent = np.arange(len(grams)) - ends[row] < take[row]
                row, members = row[sent], grams[sent] >> high
                new = np.ones(len(row), dtype=bool)
                new[1:] = (np.diff(row) != 0) | (np.diff(members) != 0)
                sent = np.bincount(row[new], minlength=len(sizes))
                found.append((sizes[take > 0], sent[take > 0], members[new]))
                held += int(new.sum())
                if held >= SENT_MEMBERS:
                    yield rows(step, ids, found)
                    step, ids, found, seen, held = step + 1, [], [], set(), 0
        if held:
            yield rows(step, ids, found)

    return run


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """Members that a part of the hash range got twice or more, how often, and of which sets."""
    part, steps = key[0].as_py(), table.column("step")
    if part < 0:
        return table.select(["part", "step", "data"])
    inner, counts = [], []
    for data in table.column("data"):
        gaps, count, _ = _unpacked(data.as_py())
        inner.append(np.cumsum(gaps, dtype=np.uint32))
        counts.append(count)
    _, which = np.unique(np.concatenate(inner), return_inverse=True)
    held = np.bincount(which, weights=np.concatenate(counts))[which].astype(np.int64)
    kept, out, at = [], [], 0
    for i, data in enumerate(table.column("data")):
        own = np.minimum(held[at : at + len(inner[i])], (1 << 32) - 1)
        at += len(own)
        often = own > 1
        if often.any():
            owner = _unpacked(data.as_py())[2][np.repeat(often, counts[i])]
            out.append(_packed(_gaps(inner[i][often]), counts[i][often], own[often], owner))
            kept.append(i)
    return pa.table(
        [pa.array([part] * len(kept), pa.int32()), steps.take(pa.array(kept, pa.int64())), pa.array(out, pa.binary())],
        names=["part", "step", "data"],
    )


def _first(percent: int, bits: int):
    """The first members of a step's sets that other sets hold, rarest first."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        members, held, owner = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for part, data in zip(table.column("part").to_pylist(), table.column("data")):
            data = data.as_py()
            if part < 0:
                head = data
                continue
            gaps, count, often, sets = _unpacked(data)
            inner = np.cumsum(gaps, dtype=np.uint32).astype(np.int64)
            members.append(np.repeat((part << bits) | inner, count))
            held.append(np.repeat(often, count))
            owner.append(sets)
        members, held, owner = (np.concatenate(x).astype(np.int64) for x in (members, held, owner))
        sizes, sent, upper, lower = (x.astype(np.int64) for x in _unpacked(head))
        ids = (upper << 32) | lower
        order = np.lexsort((members, held, owner))
        members, owner = members[order], owner[order]
        of = np.bincount(owner, minlength=len(ids))
        alone = sent - of
        nth = np.arange(len(owner)) - (np.cumsum(of) - of)[owner]
        first = nth < (first_members(sizes, percent) - alone)[owner]
        members, owner = members[first], owner[first]
        lone = (1000 * alone // np.maximum(sent, 1)).astype(np.int32)
        return pa.table(
            [pa.array(members), pa.array(ids[owner]), pa.array(lone[owner]), pa.array(sizes[owner])],
            names=["gram", "set_id", "lone", "n"],
        )

    return run


def first_rows(docs: DataFrame, members: int, *, n: int = N, percent: int = PERCENT, bits: int = MEMBER_BITS) -> DataFrame:
    """``gram, set_id, lone, n``: first members of each set that others hold too.

    ``members`` is the number of members of all sets, about; it sets the number of parts.
    """
    part_bits = max(0, (members // 2 // PART_MEMBERS).bit_length())
    sent = docs.select("text").mapInArrow(_sent(n, percent, part_bits, bits), SENT)
    shared = sent.groupBy("part").applyInArrow(_shared, SENT)
    return shared.groupBy("step").applyInArrow(_first(percent, bits), "gram long, set_id long, lone int, n long")


def meetings(first: DataFrame) -> DataFrame:
    """``tile, set_id, n, plainest``: sets that share a first member with another set.

    A tile stands for all members that the very same sets share.
    """
    # Equal sets of several steps become one where their members meet.
    rows = first.repartition("gram").distinct()
    gram = Window.partitionBy("gram")
    rows = rows.select(
        "gram", "set_id", "n",
        F.min(F.struct("lone", "set_id")).over(gram)["set_id"].alias("plainest"),
        F.count(F.lit(1)).over(gram).alias("_sets"),
        F.sum(F.xxhash64("set_id").cast("decimal(20,0)")).over(gram).alias("_sum"),
    ).where("_sets > 1")
    tile = F.xxhash64("_sets", "_sum").alias("tile")
    return rows.select(tile, "set_id", "n", "plainest").distinct()


def may_link(na, nb, percent: int) -> Column:
    return F.least(na, nb) * 100 >= percent * F.greatest(na, nb)


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def most_shared(a: bytes, na: int, b: bytes, nb: int) -> int:
    """No more members than this are shared, by the bits that one side lacks."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    x, y = _folded(x, size), _folded(y, size)
    return min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))


def enough(shared, total, percent: int):
    """shared / (total - shared) >= percent / 100, in whole numbers."""
    return 100 * shared >= percent * (total - shared)


def _bounded(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [batch.column(x).to_pylist() for x in ("na", "bits_a", "nb", "bits_b")]
            most = [most_shared(x, m, y, n) for m, x, n, y in zip(*c)]
            ok = [enough(s, m + n, percent) for s, m, n in zip(most, c[0], c[2])]
            part = pa.record_batch(
                [batch.column("a"), batch.column("b"), pa.array(most, pa.int64())], names=["a", "b", "most"]
            )
            yield part.filter(pa.array(ok, pa.bool_()))

    return run


def _verified(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.steps(whole, "text_a"):
                ends_a, members_a = gram_sets(batch.column("text_a"), n)
                ends_b, members_b = gram_sets(batch.column("text_b"), n)
                ok = []
                for i in range(batch.num_rows):
                    x = members_a[ends_a[i] : ends_a[i + 1]]
                    y = members_b[ends_b[i] : ends_b[i + 1]]
                    at = np.searchsorted(x, y)
                    shared = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
                    ok.append(enough(shared, len(x) + len(y), percent))
                part = pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"])
                yield part.filter(pa.array(ok, pa.bool_()))

    return run


def verify(pairs: DataFrame, texts: DataFrame, *, n: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose exact sets link. Texts of pairs meet them by two joins."""
    needed = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    texts = texts.join(needed, "set_id", "left_semi")
    of_a = texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a"))
    of_b = texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "text_a", "text_b").mapInArrow(
        _verified(n, percent), "a long, b long"
    )


def _twice(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield np.repeat(batch.column("text_key").to_numpy().view(np.uint64), 2)


def _met_texts(n: int, shared):
    """Set id, size, text and bitmap of the texts whose key the sketch may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = sketch.Repeated(shared.value, sketch.BITS)
        for whole in batches:
            for step in W.steps(whole):
                step = step.filter(pa.array(met(step.column("text_key").to_numpy().view(np.uint64))))
                ends, grams = gram_sets(step.column("text"), n)
                ids = pa.array(_set_ids(ends, grams), pa.int64())
                maps = [bitmap(grams[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                part = pa.record_batch(
                    [ids, pa.array(np.diff(ends)), step.column("text"), pa.array(maps, pa.binary())],
                    names=["set_id", "n_shingles", "text", "bits"],
                )
                yield part.filter(ids.is_valid())

    return run


def set_texts(docs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """``set_id, n_shingles, text, bits``: a text of each set that has one of the ``text_key`` in ``keys``.

    A sketch of the keys tells which texts are sent. A fuller one lets texts of other sets through
    and loses none.
    """
    shared = sketch.repeated(keys.select("text_key"), _twice)
    texts = docs.select("text", W.text_key().alias("text_key")).mapInArrow(
        _met_texts(n, shared), "set_id long, n_shingles long, text string, bits binary"
    )
    return texts.groupBy("set_id").agg(*[F.min(c).alias(c) for c in ("n_shingles", "text", "bits")])


def _tile(percent: int, favoured: int):
    """Pairs of a tile that the bitmaps let pass: a block against itself or another one.

    With ``favoured``, only so many of any two components, those with the largest bounds.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("set_id", "ascending")])
        n, ids = table.column("n").to_numpy(), table.column("set_id").to_numpy()
        comp, block = table.column("comp").to_numpy(), table.column("_block").to_numpy()
        guest = table.column("_guest").to_numpy(zero_copy_only=False).astype(bool)
        raw = table.column("bits").to_pylist()
        size = min(len(x) for x in raw) // 8
        bits = np.stack([_folded(np.frombuffer(x, np.uint64), size) for x in raw])
        one, two = key[2].as_py(), key[3].as_py()
        left, right, bound = [], [], []
        for i in range(len(n)):
            end = int(np.searchsorted(n, 100 * n[i] // percent, side="right"))
            others = np.arange(i + 1, end)
            others = others[(comp[others] != comp[i]) & ~(guest[i] & guest[others])]
            if one != two:
                others = others[block[others] != block[i]]
            if not len(others):
                continue
            more = np.bitwise_count(bits[i] & ~bits[others]).sum(axis=1, dtype=np.int64)
            less = np.bitwise_count(bits[others] & ~bits[i]).sum(axis=1, dtype=np.int64)
            most = np.minimum(n[i] - more, n[others] - less)
            ok = enough(most, n[i] + n[others], percent)
            left.append(np.full(int(ok.sum()), i))
            right.append(others[ok])
            # Shared at most, as parts per million of the union.
            bound.append((1_000_000 * most // (n[i] + n[others] - most))[ok])
        i, j, most = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right, bound))
        if favoured and len(i):
            low, high = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
            order = np.lexsort((-most, high, low))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
            start = np.flatnonzero(new)[np.cumsum(new) - 1]
            order = order[np.arange(len(order)) - start < favoured]
            i, j = i[order], j[order]
        return pa.table(
            [pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["a", "b"]
        )

    return run


def tile_pairs(
    rows: DataFrame, *, percent: int, tile_sets: int = TILE_SETS, favoured: int = 0
) -> DataFrame:
    """Pairs that may link, from ``tile, set_id, n, comp, bits``; of different components only."""
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent))).cast("long")
    placed = rows.withColumn("_band", band).withColumn(
        "_place", F.explode(F.array(F.struct(F.col("_band").alias("band"), F.lit(False).alias("guest")),
                                    F.struct((F.col("_band") + 1).alias("band"), F.lit(True).alias("guest"))))
    )
    placed = placed.select("tile", "set_id", "n", "comp", "bits", F.col("_place.band").alias("band"),
                           F.col("_place.guest").alias("_guest"))
    counts = placed.groupBy("tile", "band").agg(
        F.count(F.lit(1)).alias("_n"), F.min("comp").alias("_low"), F.max("comp").alias("_high"),
        F.min("_guest").alias("_no_host"),
    ).where("_low < _high and not _no_host")
    blocks = F.ceil(F.col("_n") / tile_sets).cast("int")
    placed = placed.join(counts.select("tile", "band", blocks.alias("_blocks")), ["tile", "band"])
    placed = placed.withColumn("_block", F.pmod(F.xxhash64("set_id"), F.col("_blocks")).cast("int"))
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    tiles = placed.withColumn("_one", F.least("_block", "_other")).withColumn(
        "_two", F.greatest("_block", "_other")
    )
    return tiles.groupBy("tile", "band", "_one", "_two").applyInArrow(_tile(percent, favoured), "a long, b long").distinct()


def linked_sets(
    docs: DataFrame, profile: DataFrame, *, n: int = N, percent: int = PERCENT, bits: int = MEMBER_BITS,
    tile_sets: int = TILE_SETS,
) -> DataFrame:
    """``node, comp`` of the sets that link with another set. ``profile`` should be a table."""
    members = profile.agg(F.sum("n_shingles")).first()[0] or 0
    met = W.bounded_rows(meetings(first_rows(docs, members, n=n, percent=percent, bits=bits)), "meetings")
    keys = profile.join(met.select("set_id").distinct(), "set_id", "left_semi")
    keys = keys.groupBy("set_id").agg(F.min("text_key").alias("text_key"))
    texts = W.bounded_rows(set_texts(docs, W.bounded_rows(keys, "sets"), n), "set-texts")
    own = texts.select("set_id", "n_shingles", "bits")

    # Every set meets the plainest sets of its tiles; the best of these are tried.
    side_a = own.select(F.col("set_id").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("bits_a"))
    side_b = own.select(F.col("set_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("bits_b"))
    stars = met.where("set_id <> plainest").select(F.col("set_id").alias("a"), F.col("plainest").alias("b"))
    stars = stars.distinct().join(side_a, "a").join(side_b, "b").where(may_link(F.col("na"), F.col("nb"), percent))
    stars = stars.mapInArrow(_bounded(percent), "a long, b long, most long")
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("most"), "b"))
    stars = stars.withColumn("_nth", best).where(F.col("_nth") <= STARS)
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = W.bounded_rows(tried, "stars")
    links = W.bounded_rows(verify(tried, texts, n=n, percent=percent), "star-links")

    # Then the favoured pairs of components, and at last all pairs that are still open.
    for favoured in (FAVOURED, 0):
        comp = components(links).withColumnRenamed("node", "set_id")
        rest = met.select("tile", "set_id", "n").join(comp, "set_id", "left")
        rest = rest.withColumn("comp", F.coalesce("comp", "set_id"))
        tile = Window.partitionBy("tile")
        rest = rest.withColumn("_low", F.min("comp").over(tile)).withColumn("_high", F.max("comp").over(tile))
        rest = rest.where("_low < _high").drop("_low", "_high").join(own.select("set_id", "bits"), "set_id")
        pairs = tile_pairs(rest, percent=percent, tile_sets=tile_sets, favoured=favoured)
        pairs = W.bounded_rows(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        more = W.bounded_rows(verify(pairs, texts, n=n, percent=percent), "pair-links")
        tried, links = tried.union(pairs), links.union(more)
    return components(links)


def near_copies(
    docs: DataFrame, *, n: int = N, percent: int = PERCENT, bits: int = MEMBER_BITS,
    tile_sets: int = TILE_SETS,
) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, group`` of each row.

    ``group`` is one number for all rows of a component. Rows without a set have no group, and
    their own doc_id as component.
    """
    profile = W.bounded_rows(profiles(docs, n=n), "profiles")
    comp = linked_sets(docs, profile, n=n, percent=percent, bits=bits, tile_sets=tile_sets)
    comp = comp.withColumnRenamed("node", "set_id")
    sets = profile.groupBy("set_id").agg(F.min("doc_id").alias("_least")).where("set_id is not null")
    sets = sets.join(comp, "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
    least = sets.groupBy("comp").agg(F.min("_least").alias("component_id"))
    named = sets.join(least, "comp").select("set_id", "component_id", F.col("comp").alias("group"))
    return (
        profile.select("doc_id", "text_key", "n_shingles", "set_id")
        .join(named, "set_id", "left")
        .select(
            "doc_id", "text_key", "n_shingles",
            F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
            "group",
        )
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, that with the smallest doc_id, and all rows without a set.

    All columns are kept. A null doc_id stays only where no row of the component has one. Equal
    rows are told apart by a running number.
    """
    near = W.bounded_rows(near_copies(docs, **options), "near")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_no_id"), "doc_id", "text_key"))
    stays = near.where("group is not null").groupBy("group").agg(first.alias("_first"))
    stays = stays.select(F.col("_first.doc_id").alias("_doc"), F.col("_first.text_key").alias("_text"))
    many = W.many_copies(near.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), ["_id", "_key"])
    both = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_text"))
    # A text without a word has no set; such rows meet no group and stay.
    empty = F.length(F.regexp_replace(F.coalesce("_row.text", F.lit("")), W.SPACE, "")) == 0
    return (
        W.copy_numbers(W.keyed_rows(docs), ["_id", "_key"], many, "_nth")
        .join(stays, both, "left")
        .where(empty | (F.col("_text").isNotNull() & (F.col("_nth") == 1)))
        .select("_row.*")
    )
