"""Small tables with every odd case, and plain versions of the operators to compare with."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Extra columns have names that operators use inside.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _row int, _key string,"
    " text_key long, size int, n int, part int, score double"
)


def documents() -> list[tuple]:
    """Copies, near copies, shared passages, odd characters, nulls, ties and a very long text."""
    r = random.Random(4)
    vocabulary = ["w%d" % i for i in range(400)] + ["Über", "naïve", "x\x1cy", "<|endoftext|>", "end."]

    def text(n: int) -> str:
        return " ".join(r.choice(vocabulary) for _ in range(n))

    passage, base = text(60), text(120)
    rows: list[tuple] = []

    def add(doc, body, lang="en", source="a"):
        n = None if body is None else len(body)
        rows.append((doc, body, lang, source, n, 1, "k", 2, 3, 4, 5, 0.5))

    for i in range(40):
        add(i, text(r.randint(1, 150)), r.choice(["en", "de", None]), r.choice(["a", "b", None]))
    add(40, None)
    add(41, "")
    add(42, " \t\n\x0b ")
    add(None, text(30), None, None)
    add(43, base, "en", "hot")
    for i in range(44, 60):
        words = base.split()
        words[r.randrange(len(words))] = "edit%d" % (i % 5)
        add(i, " ".join(words), "en", "hot")
    for i in range(60, 70):
        add(i, base, "en", "hot")
    add(70, text(20) + " " + passage + "\n" + passage)
    add(71, passage + " " + text(25))
    add(72, text(6000), "de", "b")
    add(73, "a " * 300, "en", "b")
    add(74, "one two", "en", "b")
    add(75, "ONE two", "en", "b")
    rows.append(rows[3])
    rows.append(rows[3])
    add(5, text(80), "en", "a")  # one doc_id, two texts
    add(76, "\n".join(["same line here"] * 6 + ["", "other"]), "fr", "c")
    add(77, "***% #tag <b> & |x| $5 " * 20, "fr", "c")
    return rows


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def crc(doc) -> int:
    return zlib.crc32(("" if doc is None else str(doc)).encode())


def removed(rows: list[tuple[int | None, str | None]], window: int) -> dict:
    """(doc, text) -> n_words, n_removed, sha of kept words; doc None comes first."""
    order = lambda d: -(2**63) if d is None else d
    places = defaultdict(set)
    for doc, text in rows:
        w = words(text)
        for s in range(len(w) - window + 1):
            places[tuple(w[s : s + window])].add((order(doc), text, s))
    out = {}
    for doc, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            here = (order(doc), s)
            # Different texts under one doc_id are ordered by a hash; see the callers.
            if any((d, t) < here for d, _, t in places[tuple(w[s : s + window])]):
                gone[s : s + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[(doc, text)] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def sets(text: str | None) -> set[tuple]:
    w = words(text, lower=True)
    if len(w) >= 4:
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    return {tuple(w)} if w else set()


def components(rows: list[tuple[int | None, str | None]], percent: int = 85) -> list:
    """The smallest doc_id that each row reaches by links; its own without a set."""
    own = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(own[i] & own[j])
            if own[i] and own[j] and 100 * shared >= percent * (len(own[i]) + len(own[j]) - shared):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) if own[i] else rows[i][0] for i in range(len(rows))]


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    w = words(text)
    often = Counter(zip(w, w[1:], w[2:]))
    covered = [False] * len(w)
    for i in range(len(w) - 2):
        if often[tuple(w[i : i + 3])] > 1:
            covered[i : i + 3] = [True] * 3
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, dup, sum(covered)
