import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from util import DOC_SCHEMA, clashing, corpus, frame

from claimweave.llm import automaton, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows, window):
    words = [WORD.findall(r[1] or "") for r in rows]
    least = {}
    for r, w in zip(rows, words):
        key = (1, 0) if r[0] is None else (0, r[0])
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            least[g] = min(key, least.get(g, key))
    out = []
    for r, w in zip(rows, words):
        key = (1, 0) if r[0] is None else (0, r[0])
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < key:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,k", [(50, 12), (20, 5)])
def test_matches_brute_force(spark, window, k):
    rng = random.Random(window)
    rows = corpus(seed=window)
    passages = [r[1].split()[:70] for r in rows[60:64] if r[1] and len(r[1].split()) > 70] or [rows[63][1].split()[:70]]
    for i in range(40):
        body = (rows[i][1] or "").split()
        at = rng.randint(0, len(body))
        p = rng.choice(passages)
        a = rng.randint(0, 10)
        rows.append((200 + i, " ".join(body[:at] + p[a : a + rng.randint(45, 60)] + body[at:]), "en", "a", 1))
    rows.append((300, "a " * 400, "en", "a", 1))
    rows.append((301, "a " * 90, "en", "a", 1))
    rows.append((3, "another text under a known id " * 20, "en", "a", 1))
    found = substring.remove_repeats(clashing(frame(spark, rows)), window, k).collect()
    assert sorted((tuple(r) for r in found), key=repr) == slow(rows, window)


def test_empty_table(spark):
    assert substring.remove_repeats(spark.createDataFrame([], DOC_SCHEMA)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120), st.integers(2, 12), st.integers(1, 6))
def test_every_window_keeps_an_anchor_and_run_hashes_agree(letters, window, k):
    k = min(k, window)
    h = substring.word_hashes([bytes([65 + x]) for x in letters])
    grams = substring.run_hashes(h, k)
    for i in range(len(grams)):
        for j in range(i):
            assert (grams[i] == grams[j]) == (letters[i : i + k] == letters[j : j + k])
    at, _ = substring.anchors_of(h, window, k)
    for s in range(len(letters) - window + 1):
        assert ((at >= s) & (at <= s + window - k)).any()
    places = np.array([p for p in at.tolist()[::2]], np.int64)
    if len(letters) >= window:
        want = [s for s in range(len(letters) - window + 1) if ((places >= s) & (places <= s + window - k)).any()]
        assert substring._starts(places, len(letters), window, k).tolist() == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=30), max_size=4), st.lists(st.integers(0, 2), max_size=40), st.integers(1, 6))
def test_automaton_gives_matching_statistics(reference, text, least):
    as_words = lambda xs: [bytes([65 + x]) for x in xs]
    auto = automaton.SuffixAutomaton()
    for r in reference:
        auto.add(as_words(r))
    runs = {tuple(r[i:j]) for r in reference for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    want = [max((n for n in range(1, e + 2) if tuple(text[e + 1 - n : e + 1]) in runs), default=0) for e in range(len(text))]
    found = auto.matching(as_words(text))
    assert found == want
    hit = bytearray(len(text))
    automaton.covered(found, least, hit)
    gone = {p for s in range(len(text) - least + 1) if tuple(text[s : s + least]) in runs for p in range(s, s + least)}
    assert {i for i, x in enumerate(hit) if x} == gone


def test_reference_spans_are_removed_shard_by_shard(spark):
    rows = corpus(n=12)
    reference = spark.createDataFrame([(r[1],) for r in rows[:6]] + [(None,)], "text string")
    for shard_words in (60, 100_000):
        found = {r.doc_id: r for r in automaton.remove_reference_spans(frame(spark, rows[:14]), reference, 20, shard_words).collect()}
        for r in rows[:6]:
            n = len((r[1] or "").split())
            assert found[r[0]].n_removed == (n if n >= 20 else 0)
        assert found[12].n_words == 0 and found[12].kept_text == ""
    assert {r.n_removed for r in automaton.remove_reference_spans(frame(spark, rows[:5]), reference.limit(0)).collect()} == {0}


def test_rows_without_an_id_meet_only_their_own_text(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(None, f"{i} {passage} {i}", None, None, 1) for i in range(60)] + [(None, f"0 {passage} 0", None, None, 1)] * 3
    found = substring.remove_repeats(frame(spark, rows + [(7, passage, "en", "a", 1)])).collect()
    assert sorted(r.n_removed for r in found) == [0] + [60] * 63
    pairs = substring._windows
    seen = []

    def counting(shared, window, k):
        seen.append(shared.count())
        return pairs(shared, window, k)

    substring._windows = counting
    try:
        substring.remove_repeats(frame(spark, rows)).collect()
    finally:
        substring._windows = pairs
    assert seen == [63]


def test_window_hashes_hold_96_independent_bits():
    words = [b"%d" % i for i in range(3000)]
    one, two = substring.window_hashes(words, 50)
    assert len(set(one.tolist())) == len(one) == 2951 and len(set(two.tolist())) > 2945
    assert abs(np.corrcoef(one.astype(float), two.astype(float))[0, 1]) < 0.1
