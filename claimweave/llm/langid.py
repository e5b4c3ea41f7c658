"""Hierarchical language identification: family first, then one-versus-one linear SVMs inside it.

A text becomes a vector of hashed byte trigrams of its letters (square root of the counts, unit
length); the whole text is used.  A first set of linear support vector machines tells language
families apart; inside the chosen family one machine for each pair of languages votes.

Fitting uses a bounded sample, documented by ``PER_LANGUAGE`` and ``SAMPLE_ROWS``: the rows with the
smallest seeded hash of each language, from rows whose ``crc32(doc_id) mod 4`` is not 2.  Executors
turn them into vectors, so that the driver gets at most ``SAMPLE_ROWS`` vectors of ``DIM`` floats
whatever the texts' lengths.  Prediction is a narrow map over all rows without a shuffle.

Repeated rows are predicted one by one; a very long text is one vector of fixed size; extra columns are ignored.

Edge cases: a null text or one without a letter is ``und`` with score 0; so is everything if no
language can be learned.  A null id counts as held out.  With one learned language, that one is
predicted.  Ties of votes go to the larger summed margin, then to the smaller name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches

DIM = 4096
PER_LANGUAGE = 600
SAMPLE_ROWS = 4800
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"

FAMILIES = {
    "germanic": "en de nl da sv no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "indic": "hi mr ne bn pa gu or as ur",
    "turkic": "tr az kk uz ky tt",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
    "austronesian": "id ms tl jv",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_NOT_LETTERS = bytes(32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


def vector(text: str) -> np.ndarray:
    """Unit vector of hashed byte trigrams of the lower-cased letters."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_NOT_LETTERS) + b" ", np.uint8).astype(np.uint32)
    codes = ((raw[:-2] * np.uint32(65599) + raw[1:-1]) * np.uint32(65599) + raw[2:]) * np.uint32(2654435761) >> np.uint32(20)
    out = np.sqrt(np.bincount(codes, minlength=DIM)).astype(np.float32)
    return out / np.float32(np.sqrt(np.dot(out, out)) or 1)


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter (``½`` and ``²`` are none)."""
    return bool(text) and any(map(str.isalpha, text))


def _svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by accelerated gradient descent; ``y`` is +1 or -1, classes balanced."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    rate = np.float32(1 / (1 + 4 * c))
    for t in range(steps):
        gap = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * weight * y
        grad = v.copy()
        grad[-1] *= 0.01
        grad[:-1] -= 2 * c * (x.T @ gap)
        grad[-1] -= 2 * c * gap.sum()
        new = v - rate * grad
        v, w = new + np.float32(t / (t + 3)) * (new - w), new
    return w[:-1], float(w[-1])


class Pairwise:
    """One machine for each pair of classes; predicts the class with most votes."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.classes = sorted(set(labels.tolist()))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        found = []
        for i, j in self.pairs:
            rows = (labels == self.classes[i]) | (labels == self.classes[j])
            found.append(_svm(x[rows], np.where(labels[rows] == self.classes[i], 1, -1).astype(np.float32)))
        self.w = np.stack([w for w, _ in found], 1) if found else np.zeros((x.shape[1], 0), np.float32)
        self.b = np.array([b for _, b in found], np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the class, and the probability of its weakest duel."""
        n, k = len(x), len(self.classes)
        if k == 1:
            return np.zeros(n, np.int64), np.ones(n)
        margin = x @ self.w + self.b
        votes, total, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
        for p, (i, j) in enumerate(self.pairs):
            m = margin[:, p]
            votes[:, i] += m >= 0
            votes[:, j] += m < 0
            for side, value in ((i, m), (j, -m)):
                total[:, side] += value
                least[:, side] = np.minimum(least[:, side], value)
        best = np.argmax(votes * 1e6 + np.clip(total, -1e5, 1e5), 1)
        return best, 1 / (1 + np.exp(-4 * np.clip(least[np.arange(n), best], -20, 20)))


def families_of(languages: list[str], centroids: np.ndarray) -> dict[str, str]:
    """Known families by code; an unknown code joins the known language with the nearest centroid."""
    known = [i for i, x in enumerate(languages) if x.lower().split("-")[0] in _FAMILY]
    out = {languages[i]: _FAMILY[languages[i].lower().split("-")[0]] for i in known}
    for i, x in enumerate(languages):
        if x not in out:
            out[x] = out[languages[known[int(np.argmax(centroids[known] @ centroids[i]))]]] if known else "other"
    return out


class Model:
    def __init__(self, x: np.ndarray, languages: np.ndarray):
        names = sorted(set(languages.tolist()))
        self.family = families_of(names, np.stack([x[languages == n].mean(0) for n in names]))
        labels = np.array([self.family[n] for n in languages.tolist()], object)
        self.top = Pairwise(x, labels)
        self.inner = [Pairwise(x[labels == f], languages[labels == f]) for f in self.top.classes]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, score = self.top.predict(x)
        out: list[str] = [UNKNOWN] * len(x)
        for f, inner in enumerate(self.inner):
            rows = np.nonzero(family == f)[0]
            if len(rows):
                best, inside = inner.predict(x[rows])
                score[rows] = score[rows] * inside
                for r, b in zip(rows.tolist(), best.tolist(), strict=True):
                    out[r] = inner.classes[b]
        return out, score


def held_out(doc_id):
    """Null-safe: a row without an id is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def training_vectors(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Bounded sample as (vectors, languages)."""
    usable = ~held_out(F.col("doc_id")) & F.col("lang").isNotNull()
    token = F.xxhash64(F.lit("language sample"), "doc_id")
    seen = docs.where(usable).groupBy("lang").count().orderBy("lang").collect()  # one row per label value
    if not seen:
        return np.zeros((0, DIM), np.float32), np.array([], object)
    each = max(2, min(per_language, sample_rows // len(seen)))
    # First a threshold on the hash that lets about twice the wanted rows pass, then the exact cut.
    bars = F.create_map(*[v for r in seen for v in (F.lit(r["lang"]), F.lit(min(1.0, (2 * each + 50) / r["count"])))])
    share = (token / F.lit(2.0**64)) + 0.5
    first = Window.partitionBy("lang").orderBy("token", "doc_id")
    sample = (
        docs.where(usable & F.col("text").isNotNull() & (share < F.element_at(bars, F.col("lang"))))
        .select("doc_id", "lang", "text", token.alias("token"))
        .withColumn("n", F.row_number().over(first)).where(F.col("n") <= each)
    )

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, lang, vector(t).tobytes()) for i, lang, t in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], ["doc_id", "lang", "v"])

    rows = map_batches(sample, ["doc_id", "lang", "text"], body, "doc_id long, lang string, v binary").orderBy("lang", "doc_id").collect()
    x = np.stack([np.frombuffer(r.v, np.float32) for r in rows]) if rows else np.zeros((0, DIM), np.float32)
    return x, np.array([r.lang for r in rows], object)


def fit(docs: DataFrame, **options) -> Model | None:
    x, languages = training_vectors(docs, **options)
    return Model(x, languages) if len(x) else None


def _predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
    for s in range(0, len(rows), 256):
        some = rows[s : s + 256]
        found, score = model.predict(np.stack([vector(texts[i]) for i in some]))
        for i, name, value in zip(some, found, score.tolist(), strict=True):
            names[i], scores[i] = name, float(value)
    return names, scores


def identify(docs: DataFrame, model: Model | None = None, **options) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.  Fits on ``docs`` unless a model is given."""
    model = model or fit(docs, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most a few MB: DIM floats per language pair

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _predict(shared.value, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), ["doc_id", "held_out", "text"], body, SCHEMA)


def keep_identified(docs: DataFrame, min_score: float = 0.0, **options) -> DataFrame:
    """``docs`` without the documents whose language is undetermined (or scored under ``min_score``)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, **options))
    at = docs.columns.index("text")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _predict(shared.value, batch.column(at).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= min_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(body, docs.schema)
