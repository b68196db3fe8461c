"""Main text of web pages: gradient-boosted trees over features of DOM nodes.

A page becomes a tree of block elements and blocks of text. A forest gives each node the
chance that it holds main text, from subtree density, attribute tokens, depth, siblings and
ancestors. Decoding picks the best choice for the whole tree in which a kept node has only kept
ancestors, so a dropped comment section cannot keep a paragraph, nor a kept article lose its
container.

The forest is fitted on a bounded sample, the ``train_pages`` pages with the smallest hash of
their id. Their main text is marked by what their authors wrote (article and main elements, and
telling class names); each is also set anew into several made-up layouts with menus, side bars,
notices, adverts, forms, comments and footers, where the main text is known for certain. All
pages are extracted, whole.

Nulls and odd cases: a null or empty page gives an empty text. Broken markup, missing end tags and
cut-off pages are read as far as they go. Repeated rows are extracted each. An empty table gives
no rows. Further columns are not read.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from grainmill.llm import dom, words as W
from grainmill.llm.boost import Forest, fit

TRAIN_PAGES = 240
LAYOUTS = 3
SEED = 11

TEXTS = "page_id long, url string, text string, n_chars long"

_WRAPPERS = (
    "article", "main", 'div class="post-content"', 'div id="content"', 'section class="entry"',
    'div class="story-body"', 'article class="post"', "div", "section",
)
_ADVERTS = ('div class="ad"', 'div class="ads"', 'div class="sponsored"', 'div id="promo-banner"', 'aside class="advert"')
_NOTICES = ('div class="cookie-notice"', 'div class="alert"', 'div role="dialog" class="consent"', 'div class="notice"')
_SIDES = ('aside class="sidebar"', 'div class="sidebar"', 'div id="side-widget"', 'div class="related"', "aside")
_TALKS = ('section id="comments"', 'div class="comments"', 'div class="discussion"', 'ol class="comment-list"')


def marked(nodes: list[dom.Node]) -> list[bool] | None:
    """Main or not for each node, as the author marked it; None for a page without marks."""
    n = len(nodes)
    inside, outside = [False] * n, [False] * n
    for i, x in enumerate(nodes):
        up = x.parent
        good = x.tag in dom.GOOD_TAGS or any(t in dom.GOOD_WORDS for t in x.tokens)
        bad = x.tag in dom.BAD_TAGS or any(t in dom.BAD_WORDS | dom.TALK_WORDS for t in x.tokens)
        inside[i] = i > 0 and (inside[up] or (good and not bad))
        outside[i] = i > 0 and (outside[up] or bad)
    main = [x.tag == "#text" and inside[i] and not outside[i] for i, x in enumerate(nodes)]
    return contains(nodes, main) if any(main) else None


def contains(nodes: list[dom.Node], main: list[bool]) -> list[bool]:
    """An element is main if a block below it is."""
    main = list(main)
    for i in range(len(nodes) - 1, 0, -1):
        if main[i]:
            main[nodes[i].parent] = True
    return main


def _wrap(opening: str, inner: str) -> str:
    return f"<{opening}>{inner}</{opening.split()[0]}>"


def layout(blocks: list[str], filler: list[str], rng: random.Random) -> str:
    """A made-up page around given main blocks; main blocks start with a private mark."""

    def words(low: int, high: int) -> str:
        return " ".join(html.escape(rng.choice(filler)) for _ in range(rng.randint(low, high)))

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(n)) + "</ul>"

    def paragraphs(n: int, low: int, high: int) -> str:
        return "".join(f"<p>{words(low, high)}.</p>" for _ in range(n))

    body = []
    for k, block in enumerate(blocks):
        tag = "h1" if k == 0 and rng.random() < 0.7 else rng.choice(("p", "p", "p", "p", "h2", "blockquote", "li", "pre", "td"))
        text = MARK + html.escape(block)
        if tag == "li":
            text = f"<ul><li>{text}</li></ul>"
        elif tag == "td":
            text = f"<table><tr><td>{text}</td></tr></table>"
        else:
            text = f"<{tag}>{text}" + (f"</{tag}>" if rng.random() < 0.9 else "")
        body.append(text)
        if rng.random() < 0.08:
            body.append(_wrap(rng.choice(_ADVERTS), words(3, 12)))
    if rng.random() < 0.2:
        body.append(_wrap('div class="share-buttons"', links(3)))
    main = _wrap(rng.choice(_WRAPPERS), "".join(body))
    before, after = [], []
    if rng.random() < 0.7:
        before.append(_wrap(rng.choice(("header", 'div class="header"', 'div id="masthead"')), f"<h1>{words(1, 4)}</h1>" + links(rng.randint(0, 5))))
    if rng.random() < 0.8:
        before.append(_wrap(rng.choice(("nav", 'div class="menu"', "div", 'ul class="breadcrumbs"')), links(rng.randint(3, 9))))
    if rng.random() < 0.5:
        before.append(_wrap(rng.choice(_NOTICES), f"<p>{words(5, 25)}.</p><button>OK</button>"))
    for place in (before, after):
        if rng.random() < 0.5:
            place.append(_wrap(rng.choice(_ADVERTS), words(3, 25)))
        if rng.random() < 0.4:
            place.append(_wrap(rng.choice(_SIDES), f"<h3>{words(1, 3)}</h3>" + rng.choice((links(4), paragraphs(2, 5, 20)))))
    if rng.random() < 0.5:
        talk = "".join(_wrap(rng.choice(('div class="comment"', "li", 'article class="comment"')), paragraphs(1, 5, 60)) for _ in range(rng.randint(1, 5)))
        after.append(_wrap(rng.choice(_TALKS), f"<h3>{words(1, 2)}</h3>" + talk))
    if rng.random() < 0.4:
        after.append(f'<form action="/s"><label>{words(1, 4)}</label><input><p>{words(4, 12)}</p></form>')
    rng.shuffle(after)
    if rng.random() < 0.85:
        after.append(_wrap(rng.choice(("footer", 'div class="footer"', 'div id="copyright"')), f"&copy; {words(4, 20)}"))
    inner = "".join(before) + main + "".join(after)
    if rng.random() < 0.4:
        inner = _wrap(rng.choice(("div", 'div class="page"', 'div id="wrapper"')), inner)
    return f"<html><head><title>{words(2, 5)}</title></head><body>{inner}</body></html>"


# Begins main blocks of made-up pages; a private-use character, taken out again after parsing.
MARK = "\ue000"


def training_rows(pages: list[str], seed: int = SEED, layouts: int = LAYOUTS) -> tuple[np.ndarray, np.ndarray]:
    """Node features and 0/1 labels from the pages as they are and in made-up layouts."""
    rng = random.Random(seed)
    x, y = [np.zeros((0, dom.N_FEATURES))], [np.zeros(0)]
    parsed = [(nodes, label) for p in pages if (label := marked(nodes := dom.parse(p)))]
    filler = [w for nodes, _ in parsed for k in nodes if k.text for w in k.text.split()[:20]]
    for nodes, label in parsed:
        x.append(dom.features(nodes))
        y.append(np.array(label, dtype=np.float64))
        blocks = [n.text.replace(MARK, "") for n, m in zip(nodes, label) if m and n.text]
        for _ in range(layouts):
            some = blocks[: rng.randint(1, len(blocks))]
            made = dom.parse(layout(some, filler, rng))
            main = [k.text.startswith(MARK) for k in made]
            for k in made:
                k.text = k.text.replace(MARK, "")
            x.append(dom.features(made))
            y.append(np.array(contains(made, main), dtype=np.float64))
    return np.concatenate(x), np.concatenate(y)


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Forest:
    full = pages.where("length(html) > 0").select("page_id", "html")
    sample = W.hashed_sample(full, F.xxhash64("page_id"), train_pages)
    x, y = training_rows([r["html"] for r in sample.collect()])
    return fit(x, y, trees=40, depth=5, rate=0.25, bins=32)


def main_text(page: str, forest: Forest) -> str:
    return main_texts([page], forest)[0]


def main_texts(pages: list[str], forest: Forest) -> list[str]:
    """The kept blocks of each page, joined by an empty line."""
    parsed = [dom.parse(p) for p in pages]
    if not parsed:
        return []
    logits = forest.raw(np.concatenate([dom.features(n) for n in parsed]))
    out, at = [], 0
    for nodes in parsed:
        kept = dom.decode(nodes, logits[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n\n".join(x.text for x, k in zip(nodes, kept) if k and x.text))
    return out


def _extract(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.steps(whole, "html"):
                texts = main_texts([p or "" for p in batch.column("html").to_pylist()], forest)
                yield pa.record_batch(
                    [
                        batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return run


def extract_pages(pages: DataFrame, *, forest: Forest | None = None, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    forest = forest or train(pages, train_pages)
    return pages.select("page_id", "url", "html").mapInArrow(_extract(forest), TEXTS)
