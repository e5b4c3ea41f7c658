import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import htmltext
from claimweave.llm.htmlblocks import blocks

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def labeller():
    return htmltext.fit()


def texts(page):
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize(
    "page,want",
    [
        (None, []),
        ("", []),
        ("just text", ["just text"]),
        ("<p>a<p>b</p>c", ["a", "b", "c"]),
        ("<p><b>a<br>b\n\t c<p>d", ["a b c", "d"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<script>var t='</p><p>no';</script><style>p{}</style><p>x", ["x"]),
        ("<script>never closed <p>x", []),
        ("<title>t</title><!-- a <p>b</p> --><p>c</p><!doctype x><?pi?>", ["c"]),
        ("<p>1 < 2 &amp; 3 &gt; 2 &#233;&nbsp;&eacute;</p>", ["1 < 2 & 3 > 2 é é"]),
        ("<p title='a>b' class=\"x\">y</p>", ["y"]),
        ("<p>a <em>b</em>, <a href=x>c</a>.</p></div></p>", ["a b, c."]),
        ("text <unfinished", ["text"]),
        ("<svg/><p>a</p>", ["a"]),
        ("<DIV>a<BR>b</DIV>", ["a b"]),
    ],
)
def test_leaf_blocks(page, want):
    assert texts(page) == want


def test_paths_and_links():
    b = blocks('<nav class="Main-Menu" id=top><ul><li><a href="/">Home</a></li></ul></nav><p>x <a>y</a></p>')
    assert b[0].path == ("nav", ".main", ".menu", ".top", "ul", "li") and b[0].linked == 1
    assert b[1].path == ("p",) and 0 < b[1].linked < 1


def test_reading_is_linear_in_hostile_pages():
    for page in ("<div>" * 50_000 + "x", "<p>a" * 50_000, "<" * 200_000, "<a '" * 50_000, "<script>" * 20_000, "</p>" * 50_000):
        blocks(page)


def test_gradients_match_finite_differences():
    rng = random.Random(3)
    group = []
    while len(group) < 3:
        text, labels = htmltext.page(rng)
        if 3 < len(labels) < 12:
            group.append((htmltext.Encoded(blocks(text)), np.array(labels, np.float32)))
    model = htmltext.Labeller(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        p = model._probabilities([g[0] for g in group])
        n = sum(g[0].n for g in group)
        return -sum(np.log(np.where(y > 0.5, q, 1 - q)).sum() for q, (_, y) in zip(p, group)) / n

    grads = model._gradients(group)
    pick = np.random.default_rng(0)
    for key, g in grads.items():
        flat = g.reshape(-1)
        for i in [int(np.argmax(np.abs(flat))), *pick.integers(0, flat.size, 3).tolist()]:
            value = model.p[key].reshape(-1)
            keep = value[i]
            value[i] = keep + 1e-3
            up = loss()
            value[i] = keep - 1e-3
            down = loss()
            value[i] = keep
            assert abs((up - down) / 2e-3 - flat[i]) < 2e-3 + 0.02 * abs(flat[i]), key


def test_held_out_pages(labeller):
    held = htmltext.training_set(150, seed=77)
    found = labeller.label([e for e, _ in held])
    right = sum(int((f == (y > 0.5)).sum()) for f, (_, y) in zip(found, held))
    assert right / sum(e.n for e, _ in held) > 0.99


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>x</script></head><body><header><a href="/">Site</a></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Contact</a></li></ul></nav>
<div class="ad">Buy this thing now.</div>%s
<aside><h3>Related</h3><p>More of it</p></aside>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I think you are right about this.</p></div></section>
<footer>&copy; site &middot; all rights.</footer></body></html>"""


def test_articles_are_found_with_and_without_an_article_tag(labeller):
    body = "<h1>Of stones</h1><p>First they came in the rain of the year.<p>It was said that the tide would turn.<p>And."
    want = "Of stones\n\nFirst they came in the rain of the year.\n\nIt was said that the tide would turn.\n\nAnd."
    for o, c in (("<article>", "</article>"), ('<div class="post-body">', "</div>"), ("<main>", "</main>")):
        assert htmltext.extract([PAGE % (o + body + c)], labeller) == [want]


def test_batching_does_not_change_labels(labeller):
    pages = [htmltext.page(random.Random(i))[0] for i in range(40)]
    one = [htmltext.extract([p], labeller)[0] for p in pages]
    assert htmltext.extract(pages, labeller) == one


def test_query_rows(spark, labeller):
    body = PAGE % "<article><h1>A b</h1><p>C d e.</p></article>"
    rows = [(1, "http://a", body), (1, "http://a", body), (2, None, None), (3, "u", ""), (None, "v", "<nav><a>x</a></nav>"), (4, "w", PAGE % ("<article><p>" + "the words run on. " * 20000 + "</p></article>"))]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit("clash")).withColumn("path", F.lit(1))
    out = sorted((tuple(r) for r in htmltext.main_text(df, labeller).collect()), key=repr)
    assert len(out) == 6
    assert out.count((1, "http://a", "A b\n\nC d e.", 11)) == 2
    assert (2, None, "", 0) in out and (3, "u", "", 0) in out
    long = next(r for r in out if r[0] == 4)
    assert long[3] == len(long[2]) > 300_000
    assert htmltext.main_text(df.limit(0), labeller).collect() == []
