import hashlib
import random
import re

from util import DOC_SCHEMA, clashing, corpus, frame, prose

from claimweave.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(8, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for size in range(1, 9):
            for i in range(len(w) - size + 1):
                if g := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= g
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, len(found) >= 2))
    return sorted(out, key=repr)


def setup():
    rng = random.Random(8)
    rows = corpus(seed=8)  # one text of 6,000 words among them
    source = [r[1] for r in rows if r[1] and len(words(r[1])) > 40]
    items = [(k, " ".join(source[k].split()[3 : 3 + rng.choice([2, 7, 8, 9, 25])])) for k in range(8)]
    items += [(50, None), (51, ""), (52, "... !!"), (3, "Re Re Re Re Re Re Re Re Re"), (54, "ÉLAN é İß one two"), (None, prose(rng, 12)), (0, items[0][1])]
    longest = max(source, key=len).split()
    items += [(60, " ".join(longest[2000:2030])), (61, " ".join(longest[-8:])), (62, " ".join(longest[2000:2030]))]
    joined = " / ".join(i[1] for i in items[:3]).upper()
    rows += [(300, joined, "en", "a", 1), (301, "re " * 30, "en", "a", 1), (302, "x ÉLAN É İß ONE-TWO y", "en", "a", 1), (303, "élan é İß one", "en", "a", 1)]
    rows += [(304 + i, f"{i} " + items[0][1], "en", "a", 1) for i in range(20)]  # one passage in many documents
    return rows, items


def test_matches_brute_force_with_a_sparse_and_a_crowded_filter(spark):
    rows, items = setup()
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS windows", "'x' AS win", "'x' AS size", "'x' AS item")
    want = slow([r[:2] for r in rows], [("" if i is None else i, t) for i, t in items])
    for bits in (decontam.FILTER_BITS, 256):
        got = decontam.judge(clashing(frame(spark, rows)), bench, bits=bits).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
    docs = clashing(frame(spark, rows))
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((w[0] for w in want if not w[3]), key=repr)


def test_every_shared_window_shares_a_fingerprint():
    rng = random.Random(1)
    for _ in range(300):
        window = [rng.randint(1, 4) for _ in range(8)]
        import numpy as np

        left = decontam.kgram_hashes(np.array([rng.randint(1, 4) for _ in range(9)] + window + [9, 9], np.int32), 5)
        right = decontam.kgram_hashes(np.array([7, 8] + window + [rng.randint(1, 4) for _ in range(6)], np.int32), 5)
        assert set(left[decontam.winnow(left, 4)].tolist()) & set(right[decontam.winnow(right, 4)].tolist())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.judge(spark.createDataFrame([], DOC_SCHEMA), none).collect() == []
    assert not any(r.contaminated or r.n_hit for r in decontam.judge(frame(spark, corpus()), none).collect())
    assert decontam.drop_contaminated(spark.createDataFrame([], DOC_SCHEMA), none).collect() == []
    assert decontam.drop_contaminated(frame(spark, corpus()), none).count() == len(corpus())
