"""The page parser: what it keeps for the trees to judge, and how long it takes."""

import time

import pytest

from grainmill.llm import dom


def texts(page):
    return [x.text for x in dom.parse(page) if x.text and not x.dropped]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", ["so x=2 holds"]),
        ("<p>see <svg><title>icon</title><text>drawn</text></svg> here</p>", ["see drawn here"]),
        ("<p>a <svg><path d='m'><p>b", ["a", "b"]),
        ("<p>a <svg/> b</p>", ["a b"]),
        ("<object><p>shown instead</p></object><p>b</p>", ["shown instead", "b"]),
        ("<canvas>drawn otherwise</canvas><p>b</p>", ["drawn otherwise", "b"]),
        ("<head><title>t</title></head><article><title>stray</title><p>a</p></article>", ["stray", "a"]),
        ("<iframe><p>framed</p></iframe><p>b</p>", ["b"]),
        ("<template>a<template>b</template>c</template><p>d</p>", ["d"]),
        ("<noscript>on</noscript><p>b</p>", ["b"]),
        ("<select><option>a<option>b</select><textarea><p>x</textarea><p>c", ["c"]),
        ("<script>if (a < b) '</p>'</script><p>b</p><script>open", ["b"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<ul><li><p>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<!-- <p>no</p> --><p title='a > b'>yes</p><!-- never closed <p>no", ["yes"]),
        ("a < b and <3 <p", ["a < b and <3 <p"]),
        ("<img alt=\"" + "x" * 9000 + "\"><p>b", ["b"]),
        ("", []),
    ],
)
def test_what_is_text(page, want):
    assert texts(page) == want


def test_rows_of_a_table_lie_side_by_side():
    nodes = dom.parse("<table>" + "<tr><td>x<td>y" * 50)
    assert max(x.depth for x in nodes) == 4


@pytest.mark.parametrize(
    "part",
    ["<div>", "<div></p>", "<form>", "<blockquote></i></b>", "<object>", "<template>", "<svg>", "<ul><li>",
     "<tr><td>x", "<a ", "<", "<a x=\"", "<!x", "</div>", "<p>", "<dd><dt>", "&amp", "<title>", "<math><p>"],
)
def test_a_megabyte_of_unclosed_markup(part):
    page = part * ((1 << 20) // len(part))
    begin = time.process_time()
    dom.parse(page[: 1 << 16])
    assert time.process_time() - begin < 1  # so that a slow one ends before the large page
    dom.parse(page)
    assert time.process_time() - begin < 12
