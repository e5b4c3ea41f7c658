import random
from itertools import combinations

import numpy as np
import xxhash
from util import DOC_SCHEMA, clashing, corpus, frame, prose

from claimweave.llm import simhash
from claimweave.llm.components import connected_components


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def slow_components(nodes):
    """nodes: list of (id, fingerprint) -> smallest id reachable."""
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(nodes)), 2):
        if (nodes[i][1] ^ nodes[j][1]).bit_count() <= 4:
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(nodes):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(nodes))]


def test_fingerprints_and_components_match_brute_force(spark):
    rows = corpus(n=120)
    nodes = [(r[0], slow_fingerprint(r[1])) for r in rows]
    want = sorted(((n[0], f"{n[1]:016x}", c) for n, c in zip(nodes, slow_components(nodes))), key=repr)
    found = simhash.near_duplicates(clashing(frame(spark, rows))).collect()
    assert sorted((tuple(r) for r in found), key=repr) == want


def random_fingerprints(seed, n):
    """Random values, chains of near values, one dense cluster."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for i in range(n // 2):
        x = out[i]
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        out.append(x)
    for _ in range(n):
        x = out[0]
        for b in rng.sample(range(64), rng.randint(1, 9)):
            x ^= 1 << b
        out.append(x)
    return list(dict.fromkeys(out))


def test_links_lose_nothing_even_when_every_key_is_dealt_over_cells(spark):
    fps = random_fingerprints(7, 300)
    want = slow_components(list(enumerate(fps)))
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    for chunk in (4096, 40):
        roots = {r.node: r.root for r in connected_components(simhash.links(nodes, chunk)).collect()}
        groups = [roots.get(x, x) for x in signed]
        first = {g: i for i, g in reversed(list(enumerate(groups)))}
        assert [first[g] for g in groups] == want


def test_pigeonring_keys_cover_every_near_pair():
    rng = random.Random(2)
    for _ in range(20000):
        x = 0
        for b in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << b
        v = np.array([x], np.uint64)
        assert any(x & m == 0 and simhash._near(v, t // 2)[0] for t, m in enumerate(simhash.KEY_MASKS))
    far = np.array([0b11111, 1 | 1 << 20 | 1 << 30 | 1 << 40 | 1 << 60], np.uint64)
    assert not any(simhash._near(far, s).any() for s in range(5))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000)] + [(7, 3)] * 4
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, **{1000 + k: 1000 for k in range(1, 300)}}


def test_one_document_of_each_group_stays(spark):
    rows = corpus()
    nodes = [(r[0], slow_fingerprint(r[1])) for r in rows]
    want = sorted({n[0] for n, c in zip(nodes, slow_components(nodes)) if n[0] == c and n[0] is not None})
    kept = simhash.keep_one_of_each(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want


def test_rows_that_share_an_id_keep_their_own_groups(spark):
    rng = random.Random(9)
    texts = [prose(rng, 80) for _ in range(3)]
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[1]), (7, texts[1]), (None, texts[2]), (9, texts[0])]
    df = frame(spark, [(i, t, None, None, 1) for i, t in rows])
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got == {(i, f"{slow_fingerprint(t):016x}", None if i is None else 5) for i, t in rows}
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one_of_each(df).collect()), key=repr)
    assert kept == sorted([(5, texts[0]), (5, texts[1]), (None, texts[2])], key=repr)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOC_SCHEMA)).collect() == []
