"""The trie of conversations against plain dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from grainmill.llm import prefix_trie as P

SCHEMA = "conv_id long, turn int, role string, text string, depth int, owner long, ha long, part int"


def nodes_of(conversations: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members, stops, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(conversations):
        turns = tuple(conversations[c])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
        stops[turns].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[x] for x in children[node])
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
    return sorted(
        (
            m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(children[n]), leaves[n], saved[n],
            hashlib.sha256(",".join(map(str, stops[n])).encode()).hexdigest(),
        )
        for n, m in members.items()
    )


def plain(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in out.items()}


def with_heads(conversations):
    out = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 100
        out[c] = conversations.get(c - base, [])[:h] + turns[h:]
    return out


def some_rows():
    r = random.Random(6)
    rows = []

    def add(conv, turn, text, role="user"):
        rows.append((conv, turn, role, text, 7, 8, 9, 10))

    for c in [*range(0, 260), -100, -7, 1000, 5005]:
        for t in range(r.randint(1, 7)):
            add(c, t, r.choice(["yes", "no", "é𝄞 long", ""]), r.choice(["user", "assistant", None]))
    for c in range(300, 330):  # copies, with ids that are no base
        for t in range(4):
            add(c, t, f"same {t}")
    for c in (400, 401, 402, 403):  # long ones that part at different depths
        for t in range(700):
            add(c, t, "t%d" % (t % 5) if t < 130 * (c - 399) else f"{c} {t}")
    add(500, None, "null first")
    add(500, 3, None, None)
    add(500, 3, "tie b")
    add(500, 3, "tie a")
    for _ in range(300):  # one row many times over
        add(501, 1, "again")
    add(None, 1, "of no conversation")
    r.shuffle(rows)
    return rows


def collected(nodes):
    return sorted((tuple(r) for r in nodes.collect()), key=lambda r: (r[0], r[1]))


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(some_rows(), SCHEMA).repartition(7).cache()


@pytest.mark.parametrize("size", [5, 4096])
def test_plain_conversations(spark, turns, size):
    got = collected(P.prefix_trie(*P.plain_conversations(turns), shard_conversations=size))
    assert got == nodes_of(plain(some_rows()))


def test_shared_heads(spark, turns):
    got = collected(P.prefix_trie(*P.with_shared_heads(turns)))
    assert got == nodes_of(with_heads(plain(some_rows())))


def test_no_conversations(spark, turns):
    assert P.prefix_trie(*P.with_shared_heads(turns.limit(0))).collect() == []


def test_conversations_without_turns(spark):
    rows = [(c, 0, "user", "only") for c in (1, 2, 3, 4, 6, 7)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = collected(P.prefix_trie(*P.with_shared_heads(table)))
    assert got == nodes_of(with_heads(plain(rows)))
    assert got[0][3] == 6
