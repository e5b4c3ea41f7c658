"""Personal data: fixed base patterns, and a skip-chain conditional random field that adds to them.

Base spans (e-mail, IP, card, phone) come from the contract's patterns and always stay.  The field labels
the tokens that hold a digit, ``@`` or ``+`` with a kind or with none.  Its graph has chain edges between
neighbouring tokens and skip edges between distant equal tokens and tokens of equal shape, so that
evidence for one occurrence reaches the others; marginals come from loopy sum-product message passing
until the messages of a document settle, ``ROUNDS`` at most.  Tokens whose marginal for a kind reaches ``SURE`` become spans if they
pass that kind's check and touch no base span: a card swallowed by a longer run of digits, or a phone
number that runs into an address, is found that way.

Fitting: pseudo-likelihood on labels that the base patterns give, on a bounded sample documented by
``SAMPLE_DOCS`` and ``SAMPLE_NODES``.  Executors send features and labels, no texts.

Scale: prediction is a narrow map in Arrow batches, nothing is shuffled, whole texts are read.  Every
pattern takes linear time.  An occurrence is linked to the previous equal one only, so skip edges grow
with the tokens and not with the square of a repeated token's count.

Edge cases: a null or empty text has no spans; a very long text is searched whole; overlapping added
spans: the one with the smaller start stays; of kinds with equal marginals the first listed wins; a token
that repeats more than ``ROUNDS`` times may hear of its farthest occurrence only in part; extra columns are
ignored; offsets are code points; repeated rows are treated one by
one; without training rows only base spans are returned; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

KINDS = ("email", "ip", "card", "phone")
SURE = 0.9
ROUNDS = 300
SETTLED = 1e-4
#: The fit sees about ``SAMPLE_DOCS`` documents, those among them with ``SAMPLE_NODES`` tokens of interest at most:
#: under a million rows of the feature matrix, 150 MB in the driver, whatever the corpus.
SAMPLE_DOCS = 15_000
SAMPLE_NODES = 64
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]")
_RUN = re.compile(r"[0-9](?:-?[0-9])+")
_LOOSE_PHONE = re.compile(r"[+(]?[0-9][ ().0-9-]*[0-9]")
_HEX = re.compile(r"[0-9a-f]{12,}", re.IGNORECASE)

Span = tuple[int, int, int]  # kind, start, end


def luhn(text: str) -> bool:
    digits = [ord(c) - 48 for c in text if "0" <= c <= "9"]
    if not 13 <= len(digits) <= 19:
        return False
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in text.split(".")))


def _phone_digits(text: str) -> bool:
    return 9 <= len(_DIGITS.findall(text)) <= 15


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, one look per ``@``: what stands before it is scanned back once."""
    out, end = [], 0
    at = text.find("@")
    while at != -1:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str | None) -> list[Span]:
    """The contract's spans, by kind as listed, then by start."""
    if not text or not _TRIGGER.search(text):
        return []
    out: list[Span] = [(0, a, b) for a, b in _emails(text)]
    for kind, pattern, passes in ((1, _IP, _octets), (2, _CARD, luhn), (3, _PHONE, _phone_digits)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if passes(m.group())]
    return out


# ---------------------------------------------------------------- features and graph

_BUCKETS = (1, 3, 5, 9, 13, 20)
FEATURES = [
    "bias", "at", "plus", "parenthesis", "hyphen", "quote", "one dot", "three dots", "more dots", "other dots",
    *(f"digits {i}" for i in range(len(_BUCKETS) + 1)), "only digits", "letters", "hex", "mail", "octets", "luhn", "run of 13",
    "short group", "after label", "next has digit", "previous has digit", "previous plus", "next hyphen",
]
_F = {name: i for i, name in enumerate(FEATURES)}


def _shape(token: str) -> str:
    return re.sub(r"[0-9]", "0", token)


def _features(token: str, before: str, after: str) -> list[int]:
    core = token.strip("\"'.,;:!?[]{}<>#$%&*|")
    digits = len(_DIGITS.findall(token))
    dots = core.count(".")
    runs = _RUN.findall(core)
    on = ["bias", f"digits {sum(digits >= b for b in _BUCKETS)}"]
    for name, holds in (
        ("at", "@" in token), ("plus", "+" in token), ("parenthesis", "(" in token or ")" in token), ("hyphen", "-" in core),
        ("quote", '"' in token or "'" in token), ("one dot", dots == 1), ("three dots", dots == 3), ("more dots", dots > 3), ("other dots", dots == 2),
        ("only digits", core.isdigit()), ("letters", any(c.isalpha() for c in core)), ("hex", _HEX.search(core) is not None and any(c.isalpha() for c in core)),
        ("mail", bool(_emails(core))), ("octets", any(_octets(x) for x in _IP.findall(core))), ("luhn", any(luhn(r) for r in runs)),
        ("run of 13", any(13 <= len(_DIGITS.findall(r)) <= 19 for r in runs)), ("short group", 2 <= digits <= 8 and not any(c.isalpha() for c in core)),
        ("after label", before.endswith(("=", ":"))), ("next has digit", _DIGITS.search(after) is not None), ("previous has digit", _DIGITS.search(before) is not None),
        ("previous plus", before.startswith("+")), ("next hyphen", "-" in after),
    ):
        if holds:
            on.append(name)
    return [_F[n] for n in on]


class Graph:
    """Tokens that matter in one text, with their features and edges (kind 0 chain, 1 equal, 2 same shape)."""

    def __init__(self, text: str):
        tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
        self.spans: list[tuple[int, int]] = []
        self.features: list[list[int]] = []
        self.edges: list[tuple[int, int, int]] = []
        equal: dict[str, int] = {}
        shaped: dict[str, int] = {}
        last = -2
        for t, (token, start, end) in enumerate(tokens):
            if not (_TRIGGER.search(token) or "+" in token and len(token) > 1):
                continue
            n = len(self.spans)
            self.spans.append((start, end))
            self.features.append(_features(token, tokens[t - 1][0] if t else "", tokens[t + 1][0] if t + 1 < len(tokens) else ""))
            if last == t - 1:
                self.edges.append((n - 1, n, 0))
            last = t
            core = token.strip("\"'.,;:!?[]{}<>#$%&*|")
            if len(core) >= 3:
                if core in equal and equal[core] != n - 1:
                    self.edges.append((equal[core], n, 1))
                elif (s := _shape(core)) in shaped and len(core) >= 7 and shaped[s] != n - 1:
                    self.edges.append((shaped[s], n, 2))
                equal[core] = n
                shaped[_shape(core)] = n

    def labels(self, base: list[Span]) -> list[int]:
        """1 + kind of the base span that covers most of the token, else 0."""
        out = [0] * len(self.spans)
        for kind, a, b in sorted(base, reverse=True):
            for n, (s, e) in enumerate(self.spans):
                if s < b and a < e:
                    out[n] = kind + 1
        return out


class Field:
    """Weights of the conditional random field: one row of unary weights a feature, three edge tables."""

    SIZE = len(KINDS) + 1

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    @classmethod
    def fit(cls, graphs: list[tuple[list[list[int]], list[tuple[int, int, int]], list[int]]], steps: int = 300, decay: float = 1e-3) -> Field:
        """Maximum pseudo-likelihood: each label given its neighbours' labels, by gradient ascent (Adam)."""
        k = cls.SIZE
        rows = sum(len(g[0]) for g in graphs)
        x = np.zeros((rows, len(FEATURES)), np.float32)
        y = np.concatenate([np.array(g[2], np.int64) for g in graphs])
        links, at = [], 0
        for features, edges, _ in graphs:
            for i, on in enumerate(features):
                x[at + i, on] = 1
            links += [(at + i, at + j, e) for i, j, e in edges]
            at += len(features)
        e = np.array(links, np.int64).reshape(-1, 3)
        unary, pair = np.zeros((x.shape[1], k)), np.zeros((3, k, k))
        params = [unary, pair]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        gold = np.eye(k)[y]
        for t in range(1, steps + 1):
            logit = x @ unary
            np.add.at(logit, e[:, 1], pair[e[:, 2], y[e[:, 0]]])
            np.add.at(logit, e[:, 0], pair[e[:, 2], :, y[e[:, 1]]])
            logit -= logit.max(1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(1, keepdims=True)
            rest = gold - p
            g_pair = np.zeros_like(pair)
            np.add.at(g_pair, (e[:, 2], y[e[:, 0]]), rest[e[:, 1]])
            np.add.at(g_pair.transpose(0, 2, 1), (e[:, 2], y[e[:, 1]]), rest[e[:, 0]])
            g_pair[1:] = (g_pair[1:] + g_pair[1:].transpose(0, 2, 1)) / 2  # skip edges have no direction
            for i, (w, g) in enumerate(zip(params, (x.T @ rest / rows, g_pair / rows), strict=True)):
                g = g - decay * w
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                w += 0.1 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
        return cls(unary, pair)

    def marginals(self, features: list[list[int]], edges: list[tuple[int, int, int]], rounds: int = ROUNDS, cuts: list[int] | None = None) -> np.ndarray:
        """Loopy sum-product, damped, all messages at once.

        ``cuts`` are the first nodes of the graphs, and the end.  Each graph stops on its own once no message
        moves by ``SETTLED``, so a document's result doesn't depend on its neighbours in a batch.
        """
        own = np.stack([self.unary[on].sum(0) for on in features])
        e = np.array(edges, np.int64).reshape(-1, 3)
        belief = own.copy()
        graph = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)) if cuts else np.zeros(len(own), np.int64)
        source, target = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
        table = np.concatenate([self.pair[e[:, 2]], self.pair[e[:, 2]].transpose(0, 2, 1)])
        message = np.zeros((len(source), self.SIZE))
        live = np.arange(len(e))  # edges of graphs that still move
        for _ in range(rounds):
            if not len(live):
                break
            both = np.concatenate([live, live + len(e)])
            back = np.concatenate([live + len(e), live])
            out = (belief[source[both]] - message[back])[:, :, None] + table[both]
            top = out.max(1, keepdims=True)
            new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            step = 0.5 * (new - message[both])
            message[both] += step
            np.add.at(belief, target[both], step)
            moves = np.zeros(graph[-1] + 1, bool)
            moves[graph[source[both[np.abs(step).max(1) > SETTLED]]]] = True
            live = live[moves[graph[source[live]]]]
        belief -= belief.max(1, keepdims=True)
        p = np.exp(belief)
        return p / p.sum(1, keepdims=True)


def added_spans(text: str, graph: Graph, marginals: np.ndarray, base: list[Span], sure: float = SURE) -> list[Span]:
    """Sure tokens as spans: joined where neighbours, trimmed to the kind's form, checked, clear of base spans."""
    kinds = np.where(marginals[:, 1:].max(1) >= sure, marginals[:, 1:].argmax(1), -1)
    taken = bytearray(len(text))
    for _, a, b in base:
        taken[a:b] = b"\1" * (b - a)
    out: list[Span] = []

    def offer(kind: int, start: int, end: int) -> None:
        part = text[start:end]
        found: list[tuple[int, int]] = []
        if kind == 0:
            found = _emails(part)
        elif kind == 1:
            found = [m.span() for m in _IP.finditer(part) if _octets(m.group())]
        elif kind == 2:
            found = [m.span() for m in _RUN.finditer(part) if luhn(m.group())]
        elif kind == 3:
            found = [m.span() for m in _LOOSE_PHONE.finditer(part) if _phone_digits(m.group())]
        for a, b in found:
            a, b = a + start, b + start
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                out.append((kind, a, b))

    n = 0
    chained = {j for i, j, e in graph.edges if e == 0}
    while n < len(kinds):
        stop = n + 1
        if kinds[n] == 3:  # a phone number spreads over several tokens
            while stop < len(kinds) and kinds[stop] == 3 and stop in chained:
                stop += 1
        if kinds[n] >= 0:
            offer(int(kinds[n]), graph.spans[n][0], graph.spans[stop - 1][1])
        n = stop
    return out


def find(texts: list[str | None], field: Field | None) -> list[tuple[list[Span], list[Span]]]:
    """(base, base and added) spans of each text; one message-passing run for all of them."""
    base = [base_spans(t) for t in texts]
    full = [list(b) for b in base]
    if field is None:
        return list(zip(base, full, strict=True))
    rows, graphs = [], []
    for i, t in enumerate(texts):
        if t and _TRIGGER.search(t):
            graph = Graph(t)
            if graph.spans:
                rows.append(i)
                graphs.append(graph)
    if graphs:
        features, edges, cuts = [], [], [0]
        for g in graphs:
            edges += [(i + cuts[-1], j + cuts[-1], e) for i, j, e in g.edges]
            features += g.features
            cuts.append(len(features))
        p = field.marginals(features, edges, cuts=cuts)
        for k, (i, g) in enumerate(zip(rows, graphs, strict=True)):
            full[i] = sorted(full[i] + added_spans(texts[i], g, p[cuts[k] : cuts[k + 1]], base[i]))
    return list(zip(base, full, strict=True))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field | None:
    """Weights from about ``sample_docs`` rows chosen by a hash of their id."""
    n = docs.count()
    share = F.xxhash64(F.lit("private"), "doc_id") / F.lit(2.0**64) + 0.5
    sample = docs.where(F.col("text").isNotNull() & (share < min(1.0, sample_docs / max(1, n))))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if _TRIGGER.search(text):
                    g = Graph(text)
                    if 0 < len(g.spans) <= SAMPLE_NODES:
                        out.append((doc, pickle.dumps((g.features, g.edges, g.labels(base_spans(text))))))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["doc_id", "g"])

    rows = map_batches(sample, ["doc_id", "text"], body, "doc_id long, g binary").collect()
    graphs = [pickle.loads(r.g) for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, bytes(r.g)))]
    return Field.fit(graphs) if graphs else None


def _fields_of(docs: DataFrame, field: Field | None):
    return docs.sparkSession.sparkContext.broadcast(field or fit(docs))  # a few hundred weights


def find_private(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base counts by kind, digest of the base spans, and all spans."""
    shared = _fields_of(docs, field)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(s, 512) for s in range(0, batch.num_rows, 512)):
                found = find(piece.column(1).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([
                    piece.column(0),
                    *(pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)),
                    pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([listed(full) for _, full in found], pa.string()),
                ], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return map_batches(docs, ["doc_id", "text"], body, SCHEMA)


def mask(text: str, spans: list[Span]) -> str:
    """Every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and ``n_chars`` brought up to date."""
    shared = _fields_of(docs, field)
    columns = docs.columns
    at = columns.index("text")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in (batch.slice(s, 512) for s in range(0, batch.num_rows, 512)):
                texts = piece.column(at).to_pylist()
                masked = [mask(t, full) if full else t for t, (_, full) in zip(texts, find(texts, shared.value), strict=True)]
                cols = list(piece.columns)
                cols[at] = pa.array(masked, pa.string())
                if "n_chars" in columns:
                    c = columns.index("n_chars")
                    cols[c] = pa.array([old if new == t else len(new) for old, new, t in zip(piece.column(c).to_pylist(), masked, texts, strict=True)], piece.schema.field(c).type)
                yield pa.RecordBatch.from_arrays(cols, columns)

    return docs.mapInArrow(body, docs.schema)
