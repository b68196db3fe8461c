"""Pages whose main text lies below an unclosed head, or in one form around the page."""

import pytest

from grainmill.llm import dom, html_text

STORY = (
    "<h1>A head line of the story</h1><p>The first paragraph of the text, which is long enough to be read as one, is here.</p>"
    "<p>The second one, with more to say about the same, follows it. It ends here, at last.</p>"
)
WANT = (
    "A head line of the story\n\nThe first paragraph of the text, which is long enough to be read as one, is here.\n\n"
    "The second one, with more to say about the same, follows it. It ends here, at last."
)
MENU = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>'


@pytest.fixture(scope="module")
def forest(spark, sf_dir):
    return html_text.train(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def test_head_ends_where_its_contents_end(forest):
    page = f"<!DOCTYPE html><html><head><title>T</title><meta charset=utf-8><script>x</script>{MENU}<article>{STORY}</article>"
    assert html_text.main_text(page, forest) == WANT
    for body in ("plain words", "<b>plain</b> words", "<p>plain words"):
        nodes = dom.parse(f"<head>\n<title>T</title>\n{body}")
        assert [x.text for x in nodes if x.tag == "#text"] == ["plain words"]
    nodes = dom.parse("<head><title>T</title><noscript>no</noscript><style>p{}</style></head><body>yes")
    assert [x.text for x in nodes if x.tag == "#text"] == ["yes"]


@pytest.mark.parametrize("form", ['form method="post" action="./" id="aspnetForm"', 'form id="form1"'])
@pytest.mark.parametrize("main", ["article", 'div class="post-content"', "main"])
def test_form_around_the_page(forest, form, main):
    inner = f'<input type="hidden" name="__VIEWSTATE">{MENU}<{main}>{STORY}</{main.split()[0]}><footer>&copy; 2024 Site</footer>'
    assert html_text.main_text(f"<html><head><title>T</title></head><body><{form}>{inner}</form></body></html>", forest) == WANT


def test_small_form_is_dropped(forest):
    page = f"<body>{MENU}<article>{STORY}</article><form><p>Sign up for our letter, now</p><input></form><footer>&copy; Site</footer>"
    assert html_text.main_text(page, forest) == WANT
