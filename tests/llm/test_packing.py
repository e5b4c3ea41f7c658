import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from util import DOC_SCHEMA, clashing, corpus, frame

from claimweave.llm import packing


@pytest.fixture(scope="module")
def hf():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(rows, hf, length):
    out = {}
    for doc, text, *_ in rows:
        ids = hf.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % length or length
        edges = [0, *range(first, len(ids), length), len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            out[doc, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    return out


def test_ids_equal_the_tokenizers_library(hf):
    tokens = packing.Tokens(packing.default_ranks())
    rng = random.Random(3)
    pieces = ["don't", " ", "  ", "\n", "a", "é", "ñandú", "12", "3,4", "\t", "!!", "x y", " ", "\x1c", "日本", "'s", "Ünder", "<|endo", "\r\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(3000)] + [" ".join(rng.choices(pieces, k=30)) for _ in range(1000)]
    for text in texts:
        assert np.frombuffer(tokens.encode(text), "<u4").tolist() == hf.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("group", [16, packing.GROUP])
def test_every_piece_is_placed_once_without_gaps(spark, hf, group):
    rows = corpus()
    found = packing.pack(clashing(frame(spark, rows)), group=group).collect()
    want = expected(rows, hf, packing.LENGTH)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == want
    assert len(found) == len(want) + sum(rows.count(x) - 1 for x in set(rows))
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= packing.LENGTH
    sizes = [r.length for r in found]
    if group == packing.GROUP:
        assert len(bins) <= packing.lower_bound(sizes, packing.LENGTH) + 1


def test_local_search_only_improves():
    rng = random.Random(5)
    for trial in range(30):
        cap = 100
        sizes = sorted((rng.randint(1, 70) for _ in range(rng.randint(0, 120))), reverse=True)
        start = packing.best_fit(sizes, cap)
        rng.shuffle(sizes) if trial % 2 else None
        start = packing.best_fit(sizes, cap)
        better = packing.local_search(start, sizes, cap)
        assert sorted(k for b in better for k in b) == list(range(len(sizes)))
        assert all(sum(sizes[k] for k in b) <= cap for b in better)
        assert packing.lower_bound(sizes, cap) <= len(better) <= len(start)


def plain_step(bins, sizes, cap, b):
    """The most that any move or exchange takes out of sequence ``b``."""
    best = 0
    fills = [sum(sizes[k] for k in x) for x in bins]
    gives = [(k,) for k in bins[b]] + [(k, m) for n, k in enumerate(bins[b]) for m in bins[b][n + 1 :]]
    for a, items in enumerate(bins):
        if a == b or not items or fills[a] < fills[b]:
            continue
        for give in gives:
            total = sum(sizes[k] for k in give)
            for back in [0, *(sizes[k] for k in items)]:
                if total > back and fills[a] + total - back <= cap:
                    best = max(best, total - back)
    return best


def test_the_search_ends_where_no_step_is_left():
    rng = random.Random(11)
    for _ in range(60):
        cap = rng.choice([20, 60, 100])
        sizes = [rng.randint(1, cap * 2 // 3) for _ in range(rng.randint(1, 40))]
        start = packing.best_fit(sizes, cap)
        for b in range(len(start)):
            step = packing._Search(start, sizes, cap).best_step(b)
            taken = 0 if step is None else sum(sizes[k] for k in step[0]) - (0 if step[1] is None else sizes[step[1]])
            assert taken == plain_step(start, sizes, cap, b)
        end = packing.local_search(start, sizes, cap)
        if len(end) > packing.lower_bound(sizes, cap):
            assert not any(plain_step(end, sizes, cap, b) for b in range(len(end)))


def fewest(sizes, cap):
    """The least number of sequences, by trying all."""
    best = [len(sizes)]

    def place(k, free):
        if len(free) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(free)
            return
        for i in range(len(free)):
            if free[i] >= sizes[k] and free[i] not in free[:i]:
                free[i] -= sizes[k]
                place(k + 1, free)
                free[i] += sizes[k]
        place(k + 1, [*free, cap - sizes[k]])

    place(0, [])
    return best[0]


def test_number_of_sequences_against_the_true_minimum():
    rng = random.Random(12)
    more = 0
    for _ in range(150):
        sizes = sorted((rng.randint(2, 14) for _ in range(rng.randint(1, 9))), reverse=True)
        least = fewest(sizes, 20)
        found = len(packing.local_search(packing.best_fit(sizes, 20), sizes, 20))
        assert least <= found <= least + 1
        more += found > least
    assert more <= 3


def test_two_for_one_exchange_empties_a_sequence():
    sizes = [6, 3, 4, 4, 3]
    better = packing.local_search([[0, 1], [2, 3], [4]], sizes, 10)
    assert len(better) == 2


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOC_SCHEMA)).collect() == []
