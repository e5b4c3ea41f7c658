"""Faults of real pages must not cost main text."""

import time

import pytest

from claimweave.llm.htmlblocks import blocks


def texts(page):
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p><a href=/o'brien>x</a><p>y", ["x", "y"]),
        ("<p class=\"x\"\">a</p><p>b", ["a", "b"]),
        ("<p><a href=/o'brien>x</a><p>y<p>it's<p>z", ["x", "y", "it's", "z"]),
        ("<p title = 'a>b' id=c>y</p>", ["y"]),
        ("<p title=\"a'>b\" 'c>y</p>", ["y"]),
        ("<p title=\"never closed>a</p><p>b</p>", ["a", "b"]),
        ("<p title=a=\"b>c</p><p>d\"</p>", ["c", 'd"']),
        ("<a =\">\"<p>x</p>", ['"', "x"]),
        ("<script>1</script 'a><p>x", ["x"]),
        ("<p>a</p><b x='>' y='>'", ["a", "' y='>'"]),
    ],
)
def test_quotes_open_values_only_after_an_equals_sign(page, want):
    assert texts(page) == want


def test_faulty_tags_take_linear_time():
    start = time.monotonic()
    for page in ("<a b=\">\"" * 50_000, "<a b='" * 50_000, "<a b=\"'>" * 50_000, "<a " + " " * 200_000 + "<p", "<a " + "b " * 100_000):
        blocks(page)
    assert time.monotonic() - start < 20


def test_raw_elements_end_where_they_do_in_the_page_itself():
    for raw in ("script", "style", "title", "svg"):
        page = "<p>" + "İ" * 40 + f"</p><{raw}>x</{raw.upper()}><p>Bir paragraf.</p><{raw}>y</{raw}><p>Son."
        assert texts(page) == ["İ" * 40, "Bir paragraf.", "Son."]
    assert texts("<script>a</ſcript>b</script><p>c") == ["c"]
