"""The pipeline against a plain-Python version of its stages, on a small corpus."""

import zlib

import numpy as np
import pytest
import util

import corpus_pipeline
from claimweave.llm import decontam, langid, packing, pii, simhash


def brute_components(rows):
    prints = [(r[0], simhash.fingerprint(r[1])) for r in rows]
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if (a ^ b).bit_count() <= simhash.DISTANCE:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in prints}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("corpus")
    rows = [r for r in util.corpus(seed=5) if r[0] is not None]
    seen = set()
    rows = [r for r in rows if not (r[0] in seen or seen.add(r[0]))]
    bench = [(k, " ".join(rows[7 + k][1].split()[:12])) for k in range(4)]
    rows.append((900, " and ".join(b[1] for b in bench[:2]) + " more words", "en", "a", 1))
    rows.append((902, "before it " + bench[3][1] + " and after it", "en", "a", 1))  # one item only
    rows.append((901, "mail someone.else@example.org or +1 (555) 010-2234 now please", "en", "b", 1))
    rows = [(r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1])) for r in rows]
    util.frame(spark, rows).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows, bench


def test_stages_against_plain_python(spark, folder):
    out, rows, bench = folder
    docs = spark.read.parquet(f"{out}/documents.parquet")
    kept = rows
    model = langid.fit(docs)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, out)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if n == 0:
            names, _ = langid._predict(model, [r[1] for r in kept])
            kept = [r for r, lang in zip(kept, names, strict=True) if lang != "und"]
        elif n == 1:
            roots = brute_components(kept)
            kept = [r for r in kept if roots[r[0]] == r[0]]
        elif n == 2:
            windows = {b[0]: {tuple(w[i : i + 8]) for w in [decontam.words_of(b[1])] for i in range(len(w) - 7)} for b in bench}
            def held(text, windows=windows):
                w = decontam.words_of(text)
                mine = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
                return sum(bool(mine & x) for x in windows.values())
            kept = [r for r in kept if not held(r[1])]
            assert not {900, 902} & {r[0] for r in kept}
        else:
            got = {r.doc_id: r for r in docs.collect()}
            assert got.keys() == {r[0] for r in kept}
            for r in kept:
                text = got[r[0]].text
                assert got[r[0]].n_chars == len(text)
                assert text == r[1] if not pii.base_spans(r[1]) else all(r[1][a:b] not in text for _, a, b in pii.base_spans(r[1]))
            assert "<EMAIL>" in got[901].text and "<PHONE>" in got[901].text
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in kept), name

    packed = corpus_pipeline.run(spark, out).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    tokens = packing.Tokens(packing.default_ranks())
    assert {r.doc_id for r in packed} == texts.keys()
    for doc, text in texts.items():
        ids = np.frombuffer(tokens.encode(text) + b"\0\0\0\0", np.uint32)
        mine = sorted((r for r in packed if r.doc_id == doc), key=lambda r: r.piece)
        assert sum(r.length for r in mine) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)


def test_repeated_and_missing_ids(spark):
    a, b = util.prose(__import__("random").Random(3), 80), util.prose(__import__("random").Random(4), 80)
    rows = [(1, a, None, None, 1), (1, b, None, None, 1), (1, b, None, None, 1), (None, a, None, None, 1), (None, "alone here", None, None, 1), (2, b, None, None, 1)]
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one_of_each(util.frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (None, "alone here")], key=repr)
