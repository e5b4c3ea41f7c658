"""Main text of web pages by a recurrent block labeller.

A page is the sequence of its leaf blocks.  Each block is described by a tag-path vector (summed
trainable embeddings of hashed tag, class, id and role words of all its ancestors, however deep), a hashed-word vector
(mean embedding of its words) and a few measures.  A bidirectional LSTM reads the whole sequence, so that
every block is labelled, main text or not, in view of all others; the main blocks are joined in page
order.  Everything is numpy, training included.

Fitting: no page comes with labels, so the labeller is trained on ``TRAIN_PAGES`` generated pages of many
layouts (``page``), from a fixed seed, on the driver in a few seconds.  Weights (0.3 MB) are broadcast.

Scale: a narrow map in Arrow batches, nothing is shuffled; pages of like length are labelled together
within a bound on cells, so a very long page costs its own length only.

Edge cases: a null or empty page, or one without main blocks, has empty text; repeated pages are read
one by one; a block as likely main text as not (a tie) is kept; a very long page is labelled whole, in linear
time, with memory that grows with its number of blocks; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches
from .htmlblocks import Block, Node, blocks

PATH_BUCKETS, PATH_DIM = 2048, 20
WORD_BUCKETS, WORD_DIM = 1024, 8
MEASURES = 6
HIDDEN = 20
INPUT = PATH_DIM + WORD_DIM + MEASURES
TRAIN_PAGES = 500
EPOCHS = 14
SEED = 4
CELLS = 16_384
SCHEMA = "page_id long, url string, text string, n_chars long"

class _Memo(dict):
    """Bucket of each token, or of each path, kept within a bound."""

    def __init__(self, make, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def _bucket(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % buckets


_WORDS = _Memo(lambda word: _bucket(word, WORD_BUCKETS))
_NAMES = _Memo(lambda names: [_bucket("<" + t, PATH_BUCKETS) for t in names], 50_000)


class Encoded:
    """Sparse description of one page's blocks: bucket lists one after the other, and how long each is."""

    def __init__(self, found: list[Block]):
        self.n = len(found)
        place: dict[Node | None, int] = {None: 0}  # the root, and every element that is above a block
        names, self.above, self.level = [_NAMES[("root",)]], [0], [0]
        for b in found:
            chain, node = [], b.node
            while node not in place:
                chain.append(node)
                node = node.above
            for node in reversed(chain):
                above = place[node.above]
                place[node] = len(names)
                names.append(_NAMES[node.names])
                self.above.append(above)
                self.level.append(self.level[above] + 1)
        self.node = [place[b.node] for b in found]
        words = [b.text.lower().split() for b in found]
        self.path = np.array([x for p in names for x in p], np.int32)
        self.path_n = [len(p) for p in names]
        self.word = np.array([x for ws in words for x in map(_WORDS.__getitem__, ws)], np.int32)
        self.word_n = [len(ws) for ws in words]
        last = max(1, self.n - 1)
        self.measure = np.array([
            (math.log1p(n) / 6, b.linked, b.text[-1] in ".!?\"'»”", i / last, n < 4, min(1.0, len(b.text) / n / 20))
            for i, (b, n) in enumerate(zip(found, self.word_n, strict=True))
        ], np.float32).reshape(self.n, MEASURES)


def _flat(pages: list[Encoded], what: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all blocks (of all elements, for paths) of all pages, and the number of each one's."""
    return np.concatenate([getattr(p, what) for p in pages]), np.array([n for p in pages for n in getattr(p, what + "_n")])


class _Trees:
    """The elements of several pages, with those of each depth, and the element of every block."""

    def __init__(self, pages: list[Encoded]):
        base = np.cumsum([0, *(len(p.above) for p in pages)])[:-1]
        self.buckets, self.count = _flat(pages, "path")
        self.above = np.concatenate([np.array(p.above) + b for p, b in zip(pages, base, strict=True)])
        self.node = np.concatenate([np.array(p.node, np.int64) + b for p, b in zip(pages, base, strict=True)])
        level = np.concatenate([np.array(p.level) for p in pages])
        order = np.argsort(level, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(level))[:-1])[1:]

    def sums(self, table: np.ndarray) -> np.ndarray:
        """For each block the embeddings of all its ancestors' tokens, summed."""
        total = np.add.reduceat(table[self.buckets], np.cumsum(self.count) - self.count, axis=0)
        for at in self.levels:
            total[at] += total[self.above[at]]
        return total[self.node]

    def back(self, d: np.ndarray, grad: np.ndarray) -> None:
        total = np.zeros((len(self.above), d.shape[1]), d.dtype)
        np.add.at(total, self.node, d)
        for at in reversed(self.levels):
            np.add.at(total, self.above[at], total[at])
        np.add.at(grad, self.buckets, np.repeat(total, self.count, axis=0))


def _glorot(rng, *shape):
    return (rng.normal(size=shape) * np.sqrt(2 / (shape[0] + shape[-1]))).astype(np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over block vectors with a logistic output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {"path": 0.3 * _glorot(rng, PATH_BUCKETS, PATH_DIM) * 8, "word": 0.1 * _glorot(rng, WORD_BUCKETS, WORD_DIM)}
        for d in "fb":
            self.p[d + "w"] = _glorot(rng, INPUT + HIDDEN, 4 * HIDDEN)
            self.p[d + "b"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)]).astype(np.float32)
        self.p["ow"] = _glorot(rng, 2 * HIDDEN + INPUT, 1)
        self.p["ob"] = np.zeros(1, np.float32)

    def _inputs(self, pages: list[Encoded], steps: int) -> tuple[np.ndarray, np.ndarray]:
        word, word_n = _flat(pages, "word")
        rows = np.concatenate([
            _Trees(pages).sums(self.p["path"]),
            np.add.reduceat(self.p["word"][word], np.cumsum(word_n) - word_n, axis=0) / word_n[:, None].astype(np.float32),
            np.concatenate([p.measure for p in pages]),
        ], 1)
        mask = (np.arange(steps)[None, :] < np.array([p.n for p in pages])[:, None]).astype(np.float32)
        x = np.zeros((len(pages), steps, INPUT), np.float32)
        x[mask > 0] = rows
        return x, mask

    def _run(self, x, mask, way, keep=None):
        """Hidden states of one direction; padded steps pass the state on unchanged."""
        rows, steps, _ = x.shape
        w, b = self.p[way + "w"], self.p[way + "b"]
        h = c = np.zeros((rows, HIDDEN), np.float32)
        out = np.zeros((rows, steps, HIDDEN), np.float32)
        fed = x.reshape(-1, INPUT) @ w[:INPUT] + b
        fed = fed.reshape(rows, steps, -1)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = fed[:, t] + h @ w[INPUT:]
            f, i, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            h_new = o * tc
            if keep is not None:
                keep.append((t, f, i, o, g, c, tc, h, m))
            c = m * c_new + (1 - m) * c
            h = m * h_new + (1 - m) * h
            out[:, t] = h
        return out

    def _back(self, x, d_out, way, kept, grads, dx):
        w = self.p[way + "w"]
        dh = dc = np.zeros((x.shape[0], HIDDEN), np.float32)
        for t, f, i, o, g, c_old, tc, h_old, m in reversed(kept):
            dh = dh + d_out[:, t]
            dhn, dcn = dh * m, dc * m
            do = dhn * tc
            dcn = dcn + dhn * o * (1 - tc * tc)
            dz = np.concatenate([dcn * c_old * f * (1 - f), dcn * g * i * (1 - i), do * o * (1 - o), dcn * i * (1 - g * g)], 1)
            grads[way + "w"][:INPUT] += x[:, t].T @ dz
            grads[way + "w"][INPUT:] += h_old.T @ dz
            grads[way + "b"] += dz.sum(0)
            dx[:, t] += dz @ w[:INPUT].T
            dh = dh * (1 - m) + dz @ w[INPUT:].T
            dc = dc * (1 - m) + dcn * f
        return dx

    def _probabilities(self, pages: list[Encoded]) -> list[np.ndarray]:
        x, mask = self._inputs(pages, max(p.n for p in pages))
        seen = np.concatenate([self._run(x, mask, "f"), self._run(x, mask, "b"), x], 2)
        p = _sigmoid(seen @ self.p["ow"] + self.p["ob"])[:, :, 0]
        return [p[r, : page.n] for r, page in enumerate(pages)]

    def label(self, pages: list[Encoded], cells: int = CELLS) -> list[np.ndarray]:
        """For each page which blocks are main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i].n), key=lambda i: pages[i].n)
        while order:
            longest = pages[order[-1]].n
            take = max(1, min(64, cells // longest))
            some, order = order[-take:], order[:-take]
            for i, p in zip(some, self._probabilities([pages[i] for i in some]), strict=True):
                out[i] = p >= 0.5
        return out

    def train(self, pages: list[tuple[Encoded, np.ndarray]], epochs: int = EPOCHS, batch: int = 25, rate: float = 0.01, seed: int = SEED) -> Labeller:
        """Cross-entropy over all blocks, back-propagated through the sequences, Adam."""
        rng = random.Random(seed)
        pages = [x for x in pages if x[0].n]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for epoch in range(epochs):
            order = sorted(range(len(pages)), key=lambda i: (pages[i][0].n + rng.random() * 12))
            groups = [order[s : s + batch] for s in range(0, len(order), batch)]
            rng.shuffle(groups)
            for group in groups:
                t += 1
                grads = self._gradients([pages[i] for i in group])
                step = rate * min(1.0, 2.0 * (1 - epoch / epochs))
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= (step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-7) + step * 1e-3 * self.p[k]).astype(np.float32)
        return self

    def _gradients(self, group: list[tuple[Encoded, np.ndarray]]) -> dict[str, np.ndarray]:
        pages = [g[0] for g in group]
        x, mask = self._inputs(pages, max(p.n for p in pages))
        gold = np.zeros_like(mask)
        for r, (_, y) in enumerate(group):
            gold[r, : len(y)] = y
        kept_f: list = []
        kept_b: list = []
        seen = np.concatenate([self._run(x, mask, "f", kept_f), self._run(x, mask, "b", kept_b), x], 2)
        p = _sigmoid(seen @ self.p["ow"] + self.p["ob"])
        d = (p[:, :, 0] - gold) * mask / mask.sum()
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["ow"] = np.einsum("rth,rt->h", seen, d)[:, None].astype(np.float32)
        grads["ob"] = d.sum(keepdims=True).reshape(1).astype(np.float32)
        d_seen = d[:, :, None] * self.p["ow"][:, 0]
        dx = d_seen[:, :, 2 * HIDDEN :].copy()
        self._back(x, d_seen[:, :, :HIDDEN], "f", kept_f, grads, dx)
        self._back(x, d_seen[:, :, HIDDEN : 2 * HIDDEN], "b", kept_b, grads, dx)
        d_rows = dx[mask > 0]
        word, word_n = _flat(pages, "word")
        _Trees(pages).back(d_rows[:, :PATH_DIM], grads["path"])
        np.add.at(grads["word"], word, np.repeat(d_rows[:, PATH_DIM : PATH_DIM + WORD_DIM] / word_n[:, None].astype(np.float32), word_n, axis=0))
        return grads


# ---------------------------------------------------------------- generated training pages

_FUNCTION = "the of and to in a is that for it with as was on by la le de et les des un une que el los en der die und den das ein mit für es no".split()
_MENU = "home about contact login news archive search help faq blog shop start accueil inicio impressum kontakt privacy terms sitemap rss more next previous".split()
_NOTICE = "we use cookies to improve your experience accept decline privacy policy consent settings close this site subscribe newsletter sign up email free trial members only".split()
_UTILITY = "col-md-12 col-lg-8 order-lg-1 mt-4 px-3 py-2 flex flex-col items-center justify-between gap-4 w-full max-w-lg mx-auto row container grid relative z-10 text-base bg-white shadow rounded d-none d-md-block js-view is-active inner wrap layout region block".split()
_COMMENT = "reply says posted by anonymous user thanks great i think you lol agree comment likes report flag ago".split()


def _prose(rng: random.Random, words: int, sounds: list[str]) -> str:
    out = [rng.choice(_FUNCTION) if rng.random() < 0.4 else "".join(rng.choices(sounds, k=rng.randint(1, 4))) for _ in range(max(1, words))]
    kind = rng.random()
    if kind < 0.06:
        return " | ".join(out)
    if kind < 0.1:
        return " ".join(w.upper() + "!!" for w in out)
    for i in range(len(out)):
        if rng.random() < 0.12:
            out[i] += rng.choice(",.,;")
    return (" ".join(out)).capitalize() + ("." if rng.random() < 0.85 else "")


def page(rng: random.Random) -> tuple[str, list[bool]]:
    """A generated page and the label of each of its leaf blocks."""
    sounds = ["".join(rng.choices("abcdefghilmnoprstuvéüñçß", k=rng.randint(1, 3))) for _ in range(40)]
    labels: list[bool] = []
    html: list[str] = []

    def say(open_: str, text: str, close: str, main: bool) -> None:
        html.append(f"{open_}{text}{close}")
        labels.append(main)

    def phrase(words: list[str], low: int, high: int) -> str:
        if rng.random() < 0.5:
            return _prose(rng, rng.randint(low, high), sounds)
        return " ".join(rng.choices(words, k=rng.randint(low, high))).capitalize()

    def nest(share: float) -> tuple[str, str]:
        """Sometimes a stack of wrappers without meaning."""
        if rng.random() >= share:
            return "", ""
        depth = rng.randint(1, 24)
        return "".join(f'<div class="{" ".join(rng.choices(_UTILITY, k=rng.randint(1, 10)))}">' if rng.random() < 0.7 else "<div>" for _ in range(depth)), "</div>" * depth

    def named(tag: str, *names: str) -> tuple[str, str]:
        attr = rng.choice(["class", "class", "id", "role"])
        extra = rng.choice(["", "", " data-x='1'", " style=\"margin:0\""])
        name = rng.choice(names)
        if attr == "class" and rng.random() < 0.2:
            name = " ".join([*rng.choices(_UTILITY, k=rng.randint(1, 14)), name])
        o, c = nest(0.1)
        return f'<{tag} {attr}="{name}"{extra}>' + o, c + f"</{tag}>"

    def menu() -> None:
        o, c = rng.choice([("<nav>", "</nav>"), named("div", "menu", "nav", "navbar", "main-menu", "topnav", "breadcrumbs"), named("ul", "menu", "nav-list", "pagination"), named("nav", "site-nav", "breadcrumb")])
        listed = rng.random() < 0.7
        html.append(o + ("<ul>" if listed and not o.startswith("<ul") else ""))
        for _ in range(rng.randint(2, 8)):
            word = phrase(_MENU, 1, 2)
            say('<li><a href="/x">' if listed or o.startswith("<ul") else '<div><a href="/">', word, "</a></li>" if listed or o.startswith("<ul") else "</a></div>", False)
        html.append(("</ul>" if listed and not o.startswith("<ul") else "") + c)

    def box(names: tuple[str, ...], tags: tuple[str, ...], words: list[str], high: int = 25, bare: tuple[str, ...] = ()) -> None:
        o, c = (f"<{t}>", f"</{t}>") if bare and rng.random() < 0.6 and (t := rng.choice(bare)) else named(rng.choice(tags), *names)
        if rng.random() < 0.5:
            say(o, phrase(words, 1, high), c, False)
        else:
            html.append(o)
            for _ in range(rng.randint(1, 4)):
                say(rng.choice(["<p>", "<div>", "<h3>"]), phrase(words, 1, high), rng.choice(["</p>", "</div>", "</h3>"]) if False else "", False)
                html.append("</p>" if html[-1].startswith("<p>") else "</div>" if html[-1].startswith("<div>") else "</h3>")
            html.append(c)

    def advert() -> None:
        box(("ad", "ads", "advert", "ad-slot", "banner", "sponsored", "promo", "advertisement"), ("div", "div", "section", "aside"), _NOTICE)

    def notice() -> None:
        box(("cookie", "cookie-notice", "consent", "notice", "alert", "popup", "modal", "gdpr", "paywall"), ("div", "div", "section", "aside"), _NOTICE, 30)

    def form() -> None:
        o, c = rng.choice([("<form>", "</form>"), named("form", "search", "login", "newsletter", "subscribe")])
        html.append(o)
        for _ in range(rng.randint(1, 3)):
            say(rng.choice(["<p>", "<div>", "<button>", "<fieldset>"]), phrase(_NOTICE, 1, 6), "", False)
            tag = html[-1][1 : html[-1].index(">")]
            html.append(f"</{tag}>")
        html.append('<input type="text">' + c)

    def comments() -> None:
        o, c = rng.choice([named("section", "comments", "responses", "discussion"), named("div", "comments", "comment-list", "respond", "discussion"), named("ol", "comments", "commentlist")])
        html.append(o)
        if rng.random() < 0.6:
            say("<h3>", phrase(_COMMENT, 1, 4), "</h3>", False)
        for _ in range(rng.randint(1, 5)):
            inner = rng.choice(['<div class="comment">', '<div class="comment-body">', '<article class="comment">', '<li class="comment">'])
            html.append(inner)
            say("<p>", _prose(rng, rng.randint(2, 60), sounds) if rng.random() < 0.7 else phrase(_COMMENT, 2, 30), "</p>", False)
            html.append("</" + inner[1 : inner.index(" ")] + ">")
        html.append(c)

    def aside() -> None:
        box(("sidebar", "widget", "related", "recommended", "share", "social", "tags", "toc", "trending"), ("div", "div", "aside", "section"), _MENU, 20, ("aside",))

    def story() -> None:
        kinds = [("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), named("div", "content", "main-content", "post", "post-body", "entry-content", "story", "article", "article-body", "text"), named("section", "content", "article", "story"), named("article", "post", "entry", "article")]
        o, c = rng.choice(kinds)
        inner = nest(0.25)
        o, c = o + inner[0], inner[1] + c
        html.append(o)
        if rng.random() < 0.8:
            say("<h1>", _prose(rng, rng.randint(1, 12), sounds), "</h1>", True)
        loose = rng.random() < 0.4
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12, 20, 30]) if rng.random() < 0.9 else rng.randint(30, 60)):
            r = rng.random()
            size = rng.choice([1, 2, 5, 12, 30, 80, 200])
            words = _prose(rng, rng.randint(1, size), sounds)
            if r < 0.8:
                say("<p><b>" if loose and rng.random() < 0.2 else "<p>", words, "<br>" if loose and rng.random() < 0.3 else "</p>", True)
            elif r < 0.85:
                say(f"<{(h := rng.choice(['h2', 'h3', 'h4']))}>", _prose(rng, rng.randint(1, 8), sounds), f"</{h}>", True)
            elif r < 0.89:
                html.append("<ul>")
                for _ in range(rng.randint(1, 4)):
                    say("<li>", _prose(rng, rng.randint(1, 15), sounds), "</li>", True)
                html.append("</ul>")
            elif r < 0.92:
                say("<blockquote>", words, "</blockquote>", True)
            elif r < 0.94:
                html.append("<table><tr>")
                for _ in range(rng.randint(1, 4)):
                    say("<td>", _prose(rng, rng.randint(1, 5), sounds), "</td>", True)
                html.append("</tr></table>")
            elif r < 0.96:
                say("<pre>", words, "</pre>", True)
            else:
                rng.choice([advert, advert, aside, form, notice])()
        if rng.random() < 0.12:
            rng.choice([comments, aside])()
        html.append(c)

    wrap = rng.choice([("", ""), ("", ""), ('<div class="wrapper">', "</div>"), ('<div id="page"><div class="container">', "</div></div>")])
    outer = nest(0.2)
    wrap = (wrap[0] + outer[0], outer[1] + wrap[1])
    html.append("<!DOCTYPE html><html><head><title>x</title></head><body>" + wrap[0])
    if rng.random() < 0.25:
        notice()
    if rng.random() < 0.45:
        box(("header", "site-header", "masthead", "topbar", "logo"), ("div", "header"), _MENU, 8, ("header",))
    if rng.random() < 0.8:
        menu()
    for _ in range(rng.choice([0, 1, 1, 2])):
        rng.choice([advert, advert, form, aside, notice])()
    if rng.random() < 0.97:
        story()
    if rng.random() < 0.35:
        comments()
    for _ in range(rng.choice([0, 0, 1, 2])):
        rng.choice([advert, form, aside, menu, notice])()
    if rng.random() < 0.8:
        box(("footer", "site-footer", "copyright", "legal", "bottom"), ("div", "footer"), _MENU, 30, ("footer",))
    html.append(wrap[1] + "</body></html>")
    return "\n".join(html) if rng.random() < 0.5 else "".join(html), labels


def training_set(pages: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[Encoded, np.ndarray]]:
    rng = random.Random(seed)
    out = []
    for _ in range(pages):
        text, labels = page(rng)
        found = blocks(text)
        if len(found) != len(labels):
            raise AssertionError("a generated page and its labels disagree")
        out.append((Encoded(found), np.array(labels, np.float32)))
    return out


def fit(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    return Labeller(seed).train(training_set(pages, seed), epochs)


def extract(htmls: list[str | None], labeller: Labeller) -> list[str]:
    found = [blocks(h) for h in htmls]
    return ["\n\n".join(b.text for b, main in zip(bs, keep.tolist(), strict=True) if main) for bs, keep in zip(found, labeller.label([Encoded(bs) for bs in found]), strict=True)]


def main_text(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller or fit())

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(s, 256) for s in range(0, batch.num_rows, 256)):
                texts = extract(piece.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(pages, ["page_id", "url", "html"], body, SCHEMA)
