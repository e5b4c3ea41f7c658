"""Deeply nested blocks and long class lists keep every token that says what they are."""

import random
import time

import numpy as np
import pytest

from claimweave.llm import htmltext
from claimweave.llm.htmlblocks import blocks


@pytest.fixture(scope="module")
def labeller():
    return htmltext.fit()


def test_paths_hold_all_ancestors_and_all_words():
    page = '<nav class="a b c d e f g h i j sidebar">' + "<div>" * 40 + "x"
    assert blocks(page)[0].path == ("nav", *("." + w for w in "abcdefghij"), ".sidebar", *["div"] * 40)


def test_deep_pages_take_linear_time(labeller):
    start = time.monotonic()
    assert htmltext.Encoded(blocks("<div>a" * 20_000)).n == 20_000
    htmltext.extract(["<div>" * 20_000 + "a", "<div>a" * 2_000], labeller)
    assert time.monotonic() - start < 20


def wrapped(rng, body):
    n = rng.randint(13, 24)
    words = [" ".join(rng.choices(htmltext._UTILITY, k=rng.randint(1, 10))) for _ in range(n)]
    return "".join(f'<div class="{w}">' for w in words) + body + "</div>" * n


def test_boilerplate_and_articles_are_told_apart_deep_down(labeller):
    rng = random.Random(11)
    right = total = 0
    for _ in range(40):
        words = [htmltext._prose(rng, 14, ["ba", "lo", "ne", "ti"]) for _ in range(6)]
        page = (
            "<body><nav>" + wrapped(rng, f"<ul><li><a href=/>{words[0]}</a></li></ul>") + "</nav><article>" + wrapped(rng, f"<p>{words[1]}</p><p>{words[2]}</p>")
            + '</article><section class="comments">' + wrapped(rng, f"<p>{words[3]}</p>") + f'</section><div class="{" ".join(htmltext._UTILITY[:12])} sidebar">'
            + wrapped(rng, f"<p>{words[4]}</p>") + "</div><footer>" + wrapped(rng, f"<p>{words[5]}</p>") + "</footer>"
        )
        found = blocks(page)
        (keep,) = labeller.label([htmltext.Encoded(found)])
        right += int((keep == np.array([False, True, True, False, False, False])).sum())
        total += len(found)
    assert right / total > 0.95, right / total
