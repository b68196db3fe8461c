"""A trie of the shared beginnings of conversations, by vertical bitmaps.

A node of depth d is a distinct sequence of first d turns; its members are the conversations that
start with it. Conversations are dealt to shards by ranges of (slab, prefix, first turn, id); a
shard is a block of some thousand of them. It indexes each (position, turn) as a bitset of local
conversations. From a root down, depth first, the bitset of a node is intersected with the posting
of the next turn of its smallest member not dealt with yet: this is a child, its popcount is the
number of its members, and the bitset of those that stop there gives its end list.

Nodes of all shards meet by a 128-bit hash of their turns. Sums over subtrees need neither rounds
nor all pairs of ancestors: a node belongs to its smallest member, so a conversation owns an
unbroken chain of nodes from some depth down to its end. Each owner adds the totals of its chain
where its path leaves the chain of another owner, and sums then run up along each chain.

Hot groups: turns are numbered over ranges of the sorted rows, so one conversation may fill many
tasks. Long conversations are cut into slabs of positions, each with the hash of all before, and
no list is longer than a slab. Equal conversations and equal first turns fall into many shards.
Only the end list of one node is read in one task, in order and as a stream, as its hash asks.

Nulls and odd cases: turns are ordered by turn (null first), role and text; a null role or text is
an empty one; rows without a conv_id belong to no conversation. Repeated rows are turns of their
own. Texts count in code points. A conversation without turns is a member of the root alone. An
empty table has no nodes. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.llm import words as W

SLAB = 256
SHARD_CONVERSATIONS = 4096
# Nodes of a chain that one window sums; sums of these stretches are summed once more.
STRETCH = 1024
KEY = ["depth", "ha", "hb"]
NODES = (
    "depth long, ha long, hb long, pa long, pb long, conv_id long, n_convs long, n_chars long,"
    " ends array<long>, owners array<long>"
)


def _hash_pair(*columns: Column | str) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, idx, a, b, n_chars``: turns in order, written by parts of the order.

    ``idx`` counts on within a part; ``a, b`` stand for role and text. The salt only lets equal
    rows fall into different parts.
    """
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        (F.monotonically_increasing_id() % 1024).alias("_salt"),
    )
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("_salt")]
    a, b = _hash_pair("role", "text")
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = ordered.select(
        "conv_id",
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("idx"),
        a.alias("a"),
        b.alias("b"),
        F.length("text").cast("long").alias("n_chars"),
    )
    return W.bounded_rows(rows, "turns")


def part_borders(turns: DataFrame) -> DataFrame:
    """``conv_id, part, first, n, before``: where each conversation begins in each part.

    A conversation has one row for each part that it reaches into.
    """
    parts = turns.groupBy("conv_id", "part").agg(
        F.min("idx").alias("first"), F.count(F.lit(1)).alias("n")
    )
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long"))


def numbered_turns(turns: DataFrame, borders: DataFrame) -> DataFrame:
    """Each turn with its ``position`` from 0, and all further columns of ``borders``."""
    rows = turns.join(borders, ["conv_id", "part"])
    return rows.withColumn("position", F.col("before") + F.col("idx") - F.col("first"))


def plain_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, position, a, b, n_chars`` of all turns, and the ids without any turn: none."""
    turns = sorted_turns(conversations)
    rows = numbered_turns(turns, part_borders(turns))
    return rows.select("conv_id", "position", "a", "b", "n_chars"), turns.select("conv_id").limit(0)


def with_shared_heads(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another one; see ``plain_conversations``.

    With h = CRC-32 of the decimal conv_id c modulo 6, the first h turns of conversation
    c - c % 100 come first (all if it has fewer, none if there is none), then the own turns
    after the first h.
    """
    turns = sorted_turns(conversations)
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    borders = part_borders(turns).withColumn("head", head).withColumn(
        "base", F.col("conv_id") - F.col("conv_id") % 100
    )
    base_turns = numbered_turns(
        turns.where("conv_id % 100 = 0"), borders.where("conv_id % 100 = 0 and before < 5")
    ).where("position < 5")
    base_turns = base_turns.select(F.col("conv_id").alias("base"), "position", "a", "b", "n_chars")
    # Five turns at most of each base conversation.
    heads = base_turns.groupBy("base").agg(
        F.array_sort(F.collect_list(F.struct("position", "a", "b", "n_chars"))).alias("turns")
    )
    ids = borders.groupBy("conv_id", "base", "head").agg(F.sum("n").alias("n"))
    ids = ids.join(heads, "base", "left").withColumn(
        "turns", F.slice(F.coalesce("turns", F.array()), F.lit(1), F.col("head").cast("int"))
    )
    first = ids.select("conv_id", F.inline("turns"))
    sizes = heads.select("base", F.size("turns").cast("long").alias("n_base"))
    given = F.least("head", F.coalesce("n_base", F.lit(0)))
    own = numbered_turns(turns, borders.join(sizes, "base", "left").withColumn("given", given))
    own = own.where("position >= head").withColumn("position", F.expr("position - head + given"))
    bare = ids.where("n <= head and size(turns) = 0").select("conv_id")
    columns = ["conv_id", "position", "a", "b", "n_chars"]
    return first.select(columns).unionByName(own.select(columns)), bare


def _cells(turns: DataFrame, bare: DataFrame) -> DataFrame:
    """A row for each slab of each conversation, with the hash of all turns before it."""
    xa, xb = _hash_pair("position", "a", "b")
    turn = F.struct("position", "xa", "xb", "n_chars")
    slabs = (
        turns.withColumn("xa", xa)
        .withColumn("xb", xb)
        .withColumn("slab", F.floor(F.col("position") / SLAB).cast("long"))
        .groupBy("conv_id", "slab")
        .agg(
            F.array_sort(F.collect_list(turn)).alias("turns"),
            F.bit_xor("xa").alias("ta"),
            F.bit_xor("xb").alias("tb"),
        )
    )
    empty = bare.select(
        "conv_id",
        F.lit(0).cast("long").alias("slab"),
        F.array().cast(slabs.schema["turns"].dataType).alias("turns"),
        F.lit(0).cast("long").alias("ta"),
        F.lit(0).cast("long").alias("tb"),
    )
    order = Window.partitionBy("conv_id").orderBy("slab")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return slabs.unionByName(empty).select(
        "conv_id",
        "slab",
        F.coalesce(F.bit_xor("ta").over(earlier), zero).alias("sa"),
        F.coalesce(F.bit_xor("tb").over(earlier), zero).alias("sb"),
        F.lead("slab").over(order).isNull().alias("last"),
        F.col("turns.xa").alias("xa"),
        F.col("turns.xb").alias("xb"),
        F.col("turns.n_chars").alias("n_chars"),
    )


def _members(bitset: int) -> list[int]:
    """Places of the set bits, lowest first."""
    raw = bitset.to_bytes((bitset.bit_length() + 7) // 8, "little")
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")).tolist()


class Shard:
    """The vertical index of one block of slabs, and the nodes found in it."""

    def __init__(self, block: pa.RecordBatch):
        columns = {name: block.column(name).to_pylist() for name in block.schema.names}
        # Local numbers follow the ids, so the lowest bit of a set is its smallest member.
        order = sorted(range(block.num_rows), key=columns["conv_id"].__getitem__)
        self.ids = [columns["conv_id"][k] for k in order]
        self.turns: list[list[tuple[int, int]]] = []
        self.postings: list[dict[tuple[int, int], int]] = [defaultdict(int) for _ in range(SLAB)]
        self.roots: dict[tuple[int, int, int], int] = defaultdict(int)
        self.chars: dict[tuple[int, int], int] = {}
        self.full = [0] * (SLAB + 1)  # slabs with this number of turns
        self.stops = [0] * (SLAB + 1)  # conversations that stop after them
        self.going_on = 0
        for i, k in enumerate(order):
            bit = 1 << i
            turns = list(zip(columns["xa"][k], columns["xb"][k]))
            self.turns.append(turns)
            self.roots[columns["slab"][k], columns["sa"][k], columns["sb"][k]] |= bit
            for at, turn in enumerate(turns):
                self.postings[at][turn] |= bit
            self.chars.update(zip(turns, columns["n_chars"][k]))
            self.full[len(turns)] |= bit
            if columns["last"][k]:
                self.stops[len(turns)] |= bit
            else:
                self.going_on |= bit

    def nodes(self) -> Iterator[tuple]:
        """(depth, hash, hash of the parent, members, those that stop, code points)."""
        for (slab, sa, sb), bits in self.roots.items():
            if slab == 0:
                yield 0, (0, 0), (None, None), bits, bits & self.stops[0], 0
            stack = [(bits, 0, sa, sb)]
            while stack:
                bits, at, a, b = stack.pop()
                rest = bits & ~self.full[at]
                while rest:
                    smallest = (rest & -rest).bit_length() - 1
                    turn = self.turns[smallest][at]
                    child = rest & self.postings[at][turn]
                    rest ^= child
                    ca, cb = a ^ turn[0], b ^ turn[1]
                    stops = child & self.stops[at + 1]
                    yield slab * SLAB + at + 1, (ca, cb), (a, b), child, stops, self.chars[turn]
                    if at + 1 < SLAB:
                        stack.append((child, at + 1, ca, cb))

    def table(self) -> pa.RecordBatch:
        found = list(self.nodes())
        owners = self.going_on
        for node in found:
            owners |= node[3] & -node[3]
        rows = [
            (
                depth, *own, *parent, self.ids[(bits & -bits).bit_length() - 1], bits.bit_count(), chars,
                [self.ids[i] for i in _members(stops)],
                [self.ids[i] for i in _members(bits & owners)],
            )
            for depth, own, parent, bits, stops, chars in found
        ]
        names = [field.split()[0] for field in NODES.split(", ")]
        types = [pa.int64()] * 8 + [pa.list_(pa.int64())] * 2
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _search(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                yield Shard(batch.slice(a, size)).table()

    return run


def _stop_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ids of each node; rows come sorted by node and id."""
    key, digest = None, hashlib.sha256()

    def out(keys: list[tuple], hashes: list[str]) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in (list(zip(*keys)) or [[]] * 3)]
        return pa.record_batch([*columns, pa.array(hashes, pa.string())], names=[*KEY, "ends_sha256"])

    for batch in batches:
        keys, hashes = [], []
        columns = [batch.column(c).to_pylist() for c in [*KEY, "stop"]]
        for depth, ha, hb, stop in zip(*columns):
            if (depth, ha, hb) != key:
                if key is not None:
                    keys.append(key)
                    hashes.append(digest.hexdigest())
                key, digest = (depth, ha, hb), hashlib.sha256(str(stop).encode())
            else:
                digest.update(b",%d" % stop)
        yield out(keys, hashes)
    if key is not None:
        yield out([key], [digest.hexdigest()])


def prefix_trie(
    turns: DataFrame, bare: DataFrame, *, shard_conversations: int = SHARD_CONVERSATIONS
) -> DataFrame:
    """All nodes of the trie, one row each.

    ``turns`` has ``conv_id, position, a, b, n_chars``: positions from 0 without gaps, and a pair
    of hashes for role and text. ``bare`` has the ids of conversations without turns. A node is
    named by ``conv_id``, its smallest member, and ``depth``; its turns are the first ``depth``
    turns of that conversation.
    """
    spark = turns.sparkSession
    order = ["slab", "sa", F.get("xa", F.lit(0)), "conv_id"]
    cells = _cells(turns, bare).repartitionByRange(*order).sortWithinPartitions(*order)
    found = W.bounded_rows(cells.mapInArrow(_search(shard_conversations), NODES), "shard-nodes")

    nodes = found.groupBy(KEY).agg(
        F.min("conv_id").alias("owner"),
        F.sum("n_convs").alias("n_convs"),
        F.max("n_chars").alias("n_chars"),
        F.max("pa").alias("pa"),
        F.max("pb").alias("pb"),
    )
    children = (
        nodes.where("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ha"), F.col("pb").alias("hb"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    stops = (
        found.select(*KEY, F.explode("ends").alias("stop"))
        .repartition(*KEY)
        .sortWithinPartitions(*KEY, "stop")
        .mapInArrow(_stop_hashes, "depth long, ha long, hb long, ends_sha256 string")
    )
    nodes = (
        nodes.join(children, KEY, "left")
        .join(stops, KEY, "left")
        .select(
            *KEY,
            "owner",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
            ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"),
        )
        .withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    )
    nodes = W.bounded_rows(nodes, "nodes")

    # Where the path of each conversation that may own nodes leaves the chains of others.
    paths = (
        found.select(*KEY, "owners")
        .join(nodes.select(*KEY, "owner"), KEY)
        .select("depth", "owner", F.explode("owners").alias("conv_id"))
        .where("conv_id <> owner")
        .groupBy("conv_id", "owner")
        .agg(F.max("depth").alias("hang"))
    )
    chains = nodes.groupBy(F.col("owner").alias("conv_id")).agg(
        F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.min("depth").alias("top")
    )
    hung = paths.join(chains, "conv_id")
    # One row for each place of a chain where others hang, and one for the top of each chain.
    places = hung.groupBy("owner", F.col("hang").alias("depth")).agg(
        F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"),
        F.lit(None).cast("long").alias("parent"),
    )
    tops = hung.where("hang = top - 1").select(
        F.col("conv_id").alias("owner"), F.col("top").alias("depth"),
        F.lit(0).cast("long").alias("more_leaf"), F.lit(0).cast("long").alias("more_saved"),
        F.col("owner").alias("parent"),
    )
    extra = places.unionByName(tops).groupBy("owner", "depth").agg(
        F.sum("more_leaf").alias("more_leaf"), F.sum("more_saved").alias("more_saved"),
        F.max("parent").alias("parent"),
    )
    zero = F.lit(0).cast("long")
    valued = (
        nodes.join(extra, ["owner", "depth"], "left")
        .withColumn("leaf", F.col("leaf") + F.coalesce("more_leaf", zero))
        .withColumn("saved", F.col("saved") + F.coalesce("more_saved", zero))
        .withColumn("stretch", F.floor(F.col("depth") / STRETCH).cast("long"))
    )
    below = Window.partitionBy("owner").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    deeper = (
        valued.groupBy("owner", "stretch")
        .agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
        .select(
            "owner", "stretch", F.sum("leaf").over(below).alias("later_leaf"),
            F.sum("saved").over(below).alias("later_saved"),
        )
        .where("later_leaf is not null")
    )
    inner = (
        Window.partitionBy("owner", "stretch").orderBy(F.desc("depth"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        valued.withColumn("sum_leaf", F.sum("leaf").over(inner))
        .withColumn("sum_saved", F.sum("saved").over(inner))
        .join(deeper, ["owner", "stretch"], "left")
        .select(
            F.col("owner").alias("conv_id"),
            "depth",
            F.when(F.col("depth") > 0, F.coalesce("parent", "owner")).alias("parent_conv_id"),
            "n_convs",
            "n_children",
            (F.col("sum_leaf") + F.coalesce("later_leaf", zero)).alias("n_leaves"),
            (F.col("sum_saved") + F.coalesce("later_saved", zero)).alias("saved_tokens"),
            "ends_sha256",
        )
    )
