"""Top-k search, page texts and archives, with their odd cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, In

from grainmill.llm import boost, dom, html_text, topk, warc


def brute(rows, queries, k):
    def codes(v):
        ok = v is not None and all(x is not None and math.isfinite(x) for x in v)
        return [math.floor(256 * x) for x in v] if ok else None

    good = [(i, c) for i, v in rows if i is not None and (c := codes(v)) is not None]
    out = set()
    for q in queries:
        for own, c in [(i, c) for i, c in good if i == q]:
            scores = sorted((-sum(a * b for a, b in zip(c, d)), i) for i, d in good if i != own)
            out |= {(own, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_top_k(spark, block):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(12)]) for i in range(120)]
    rows[7] = (7, rows[3][1])  # a tie
    rows += [
        (200, None), (201, []), (202, [0.5, None]), (203, [float("nan")] * 12), (204, [float("inf")] * 12),
        (None, [0.1] * 12), (205, [0.25, -0.25]), (250, [1.0] * 12),
    ]
    table = spark.createDataFrame(
        [(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, rank string, score int"
    )
    asked = [i for i, _ in rows if i is not None and i % 50 == 0]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = topk.top_k(table, table.where("vec_id % 50 = 0"), block_vectors=block, block_queries=2)
    assert {(x.query_id, x["rank"], x.vec_id, x.score) for x in got.collect()} == brute(rows, asked, 5)
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_early_stop_is_exact():
    r = np.random.default_rng(5)
    import pyarrow as pa

    base = np.concatenate((r.normal(0, 1, (40, 16)), r.normal(0, 1, (2000, 16)) * 0.05))
    codes = np.floor(64 * base).astype(np.int32)
    table = pa.table({"vec_id": pa.array(np.arange(len(codes))), "codes": pa.array(codes.tolist(), pa.list_(pa.int32()))})
    row = topk._index_block(8)((pa.scalar(0),), table).to_pylist()[0]
    order = np.frombuffer(row["order"], np.uint16).reshape(16, -1)
    starts = np.frombuffer(row["starts"], np.int32).reshape(16, -1)
    exact = codes.astype(float)
    stopped = 0
    for q in range(40):
        at, scores, met = topk.best_of_block(exact[q], q, np.arange(len(codes)), exact, order, starts, 5)
        want = exact @ exact[q]
        want[q] = -np.inf
        assert at.tolist() == np.lexsort((np.arange(len(codes)), -want))[:5].tolist()
        stopped += met < codes.size
    assert stopped  # some queries end before all postings are met


PAGE = """<html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies.</p></div>
<div class="post-content"><h1>Head &amp; line</h1><p>First  paragraph
 of text, <b>bold</b> and <a href=x>a link</a>.<p>Second &lt;one&gt;.<div class="ad">Buy now</div>
<blockquote>A quote of some words, at last.</blockquote></div>
<aside class="sidebar"><p>Also read this.</p></aside>
<section id="comments"><div class="comment"><p>I like it, says a reader.</p></div></section>
<form><p>Sign up</p><input></form><footer>&copy; 2024 Site</footer><script>var a="<p>no</p>";</script>"""


@pytest.fixture(scope="module")
def forest(spark, sf_dir):
    return html_text.train(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def test_main_text(forest):
    want = "Head & line\n\nFirst paragraph of text, bold and a link.\n\nSecond <one>.\n\nA quote of some words, at last."
    assert html_text.main_text(PAGE, forest) == want


def test_made_up_layouts(forest):
    rng = random.Random(99)
    filler = ["alpha", "beta", "gamma,", "delta", "of", "the", "river."]
    right = 0
    for _ in range(60):
        blocks = [" ".join(rng.choice(filler) for _ in range(rng.randint(6, 60))) for _ in range(rng.randint(2, 9))]
        page = html_text.layout(blocks, filler, rng)
        want = [n.text[1:] for n in dom.parse(page) if n.text.startswith(html_text.MARK)]
        right += html_text.main_text(page.replace(html_text.MARK, ""), forest) == "\n\n".join(want)
    assert right >= 57


def test_decoding_keeps_ancestors(forest):
    nodes = dom.parse(PAGE)
    rng = np.random.default_rng(0)
    for _ in range(50):
        kept = dom.decode(nodes, rng.normal(0, 2, len(nodes)))
        assert all(kept[n.parent] for n, k in zip(nodes, kept) if k and n.parent >= 0)


def test_pages_of_the_table(spark, forest):
    pages = [
        (1, "u", None, 1), (2, None, "", 2), (3, "u", "just text & more", 3), (4, "u", "<p>a<p", 4),
        (5, "u", "<" * 5000, 5), (6, "u", PAGE * 3, 6), (6, "u", PAGE * 3, 6), (None, "u", PAGE, 7),
        (7, "u", "<article>" + "<div>" * 3000 + "deep", 8),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, text int")
    got = html_text.extract_pages(table, forest=forest).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert html_text.extract_pages(table.limit(0)).count() == 0


def test_forest_learns_and_is_flat():
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = boost.fit(x[:2000], y[:2000])
    assert ((forest.chance(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.95
    assert forest.leaves.shape == (60, 16) and forest.features.shape == (60, 15)


def archive_rows():
    long, other = "<p>" + "é" * 700 + "</p>", "x" * 1000
    return [
        (1, "http://a/", long), (2, "http://a/\r\nX: y", long), (9, None, long), (3, "u", "short"), (4, "u", "short"),
        (5, "u", None), (6, "u", ""), (7, "u", other), (7, "u", other), (8, "u", other[:-1]), (-1, "u", other),
        (None, "u", other), (10, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 200),
    ]


def test_archive_round_trip(spark):
    rows = archive_rows()
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, payload int, refers_to string")
    got = sorted(map(str, warc.archive_round_trip(spark, pages).collect()))
    want, largest = [], {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if i is not None and len(raw) >= 1000:
            largest[raw] = max(largest.get(raw, i), i)
    for i, _, h in rows:
        raw = (h or "").encode()
        again = raw in largest and (i is None or i < largest[raw])
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", largest[raw] if again else None))
    from pyspark.sql import Row

    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == sorted(str(Row(**dict(zip(names, w)))) for w in want)
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_archive_predicates(spark, tmp_path):
    path = str(tmp_path / "w")
    pages = spark.createDataFrame(archive_rows(), "page_id long, url string, html string")
    warc.write_pages(pages, path)
    heads = warc.read_archives(spark, path, payload=False)
    assert heads.where("warc_type = 'revisit'").count() == 4
    assert heads.where("target_uri in ('u', 'v') and payload_length > 999").count() == 5
    plan = heads.where("warc_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    # The comparison is left to the source; only what it gave back is a filter.
    assert not [line for line in plan.splitlines() if "Filter" in line and "revisit" in line]
    assert heads.where("payload is not null").count() == 0
    one = warc.read_archives(spark, path).where("record_id = '<urn:page:10>'").collect()
    assert [bytes(r.payload).decode() for r in one] == [archive_rows()[-1][2]]


def test_what_is_pushed_down(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "w")
    big = [(i, "u", "".join(chr(33 + (i * k) % 90) for k in range(60_000))) for i in range(1, 6)]
    warc.write_pages(spark.createDataFrame(big, "page_id long, url string, html string").coalesce(1), path)
    inflated, own = [], warc.zlib.decompressobj

    class Counted:
        def __init__(self, *args):
            self.inner = own(*args)

        def decompress(self, *args):
            out = self.inner.decompress(*args)
            inflated.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.inner, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counted)

    def read(payload, *filters):
        inflated.clear()
        reader = warc.WarcReader({"path": path, "payload": payload})
        left = list(reader.pushFilters(list(filters)))
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        return left, rows, sum(inflated)

    left, rows, size = read("false", EqualTo(("warc_type",), "response"))
    assert left == [] and len(rows) == 5 and size <= 5 * 8192  # headers alone
    left, rows, size = read("true", In(("record_id",), ("<urn:page:3>", "x")))
    assert left == [] and [len(r["payload"]) for r in rows] == [60_000] and size < 60_000 + 5 * 8192
    length = EqualTo(("payload_length",), 5)
    assert read("false", length)[0] == [length]
    assert read("true", EqualTo(("warc_type",), "revisit"))[1] == []


def test_a_second_write_adds_to_the_first(spark, tmp_path):
    path = str(tmp_path / "w")
    for i in (1, 2):
        warc.write_pages(spark.createDataFrame([(i, "u", f"text {i}")], "page_id long, url string, html string"), path)
    (tmp_path / "w" / "pages-lost.warc.gz").write_bytes(b"left by an attempt that failed")
    got = [bytes(r.payload).decode() for r in warc.read_archives(spark, path).collect()]
    assert sorted(got) == ["text 1", "text 2"]


def test_a_folder_that_others_made(spark, tmp_path):
    block = warc.record({"WARC-Type": "resource", "WARC-Record-ID": "1"}, b"payload")
    (tmp_path / "a.warc").write_bytes(block)
    (tmp_path / "b.txt").write_bytes(b"no archive")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert [(r.record_id, bytes(r.payload)) for r in got] == [("1", b"payload")]


def test_plain_and_foreign_members(tmp_path):
    import gzip

    blocks = [b"one", b"", b"three\r\n\r\n" * 5000]
    records = [warc.record({"WARC-Type": "resource", "WARC-Record-ID": str(i)}, b) for i, b in enumerate(blocks)]
    plain, zipped = tmp_path / "a.warc", tmp_path / "a.warc.gz"
    plain.write_bytes(b"".join(records))
    zipped.write_bytes(b"".join(map(gzip.compress, records)))
    for path in (plain, zipped):
        got = [(h["warc-record-id"], b) for h, b in warc.read_records(str(path), lambda h: True, True)]
        assert got == [(str(i), b) for i, b in enumerate(blocks)]
        some = list(warc.read_records(str(path), lambda h: h["warc-record-id"] == "2", False))
        assert len(some) == 1 and some[0][1] is None
