import random
from collections import Counter

from util import DOC_SCHEMA, clashing, corpus, frame, prose

from claimweave.llm import quality

SPACES = "\t\n\x0b\x0c\r "


def slow(text):
    text = text or ""
    flat = "".join(" " if c in SPACES else c for c in text)
    words = [w for w in flat.split(" ") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    hit = {j for i, g in enumerate(grams) if g in often for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    counts = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit))
    return (*counts, len(words) < 50 or 100 * len(hit) > 50 * len(words))


def data():
    rng = random.Random(4)
    rows = corpus(seed=4)
    rows += [(500 + k, "\n".join(rng.choices(["same line here", "other\tline", " ", "", "é|ß"], k=40)), "en", "a", 1) for k in range(5)]
    rows += [(600 + k, " ".join(rng.choices(["#", "*$", "!!", "&&", "<b>"], k=90)), "en", "a", 1) for k in range(6)]
    return rows + [(700 + k, prose(rng, 150), "en", "a", 1) for k in range(30)]


def test_counts_match_brute_force(spark):
    rows = data()
    got = quality.judge(clashing(frame(spark, rows))).collect()
    found = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr)
    assert found == sorted(((r[0], *slow(r[1])) for r in rows), key=repr)
    assert not any(r.kept for r in got if r.base_failed)
    verdicts = {r.doc_id: r.kept for r in got}
    assert all(verdicts[700 + k] for k in range(30)) and not any(verdicts[600 + k] for k in range(6))


def test_no_two_rules_are_one_measure():
    rng = random.Random(9)
    values = [quality.measure(t)[0] for _, t, *_ in data()] + [quality.measure(" ".join(rng.choices(["a#b", "#", "%%", "word"], k=60)))[0] for _ in range(9)]
    names = [r[1] for r in quality.RULES]
    assert len(set(names)) == len(names)
    for i, a in enumerate(names):
        assert all(any(v[a] != v[b] for v in values) for b in names[:i])
    some = quality.measure("a#b # <> word |x| $")[0]
    assert some["symbol_words"] == 3 / 6


def test_posteriors_match_a_row_by_row_version():
    """Expectation maximisation over every row, instead of over pattern counts."""
    rng = random.Random(2)
    rows = ["".join(rng.choices("+-0", weights=[6, 1, 2], k=len(quality.RULES))) for _ in range(150)]
    good = [0.02 if "-" in r else 0.98 for r in rows]
    for _ in range(quality.ROUNDS):
        score = []
        for part in (good, [1 - g for g in good]):
            share = (sum(part) + 0.5) / (len(rows) + 1)
            table = [{v: (sum(p for p, r in zip(part, rows, strict=True) if r[k] == v) + 1 / 3) / (sum(part) + 1) for v in "+-0"} for k in range(len(rows[0]))]
            weights = []
            for r in rows:
                w = share
                for k, v in enumerate(r):
                    w *= table[k][v]
                weights.append(w)
            score.append(weights)
        new = [a / (a + b) for a, b in zip(*score, strict=True)]
        done = max(abs(a - b) for a, b in zip(new, good, strict=True)) < 1e-9
        good = new
        if done:
            break
    found = quality.posteriors(list(Counter(rows).items()))
    assert all(abs(found[r] - g) < 1e-6 for r, g in zip(rows, good, strict=True))


def test_expectation_maximisation_recovers_accuracies():
    rng = random.Random(6)
    counts, truth = Counter(), {}
    for _ in range(4000):
        good = rng.random() < 0.7
        votes = "".join("0" if rng.random() < 0.2 else "+" if (rng.random() < (0.97 if r < 7 else 0.55)) == good else "-" for r in range(10))
        counts[votes] += 1
        truth.setdefault(votes, []).append(good)
    p = quality.posteriors(list(counts.items()))
    right = sum(sum(g == (p[v] >= 0.5) for g in gs) for v, gs in truth.items())
    assert right >= 0.97 * 4000
    assert p == quality.posteriors(list(reversed(list(counts.items()))))


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], DOC_SCHEMA)).collect() == []
    assert quality.posteriors([]) == {}
