import random
import zlib

import numpy as np
from util import DOC_SCHEMA, clashing

from claimweave.llm import langid

WORDS = {
    "en": "the of and to that with which from this have were their would".split(),
    "de": "der die und nicht das ein zu mit auf für werden sich auch".split(),
    "fr": "le la les des que une pour dans est avec pas plus être".split(),
    "es": "el los las que una para con por está más pero como año".split(),
}


def rows(n=240, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(8, 40))), lang, "a", 1))
    return out


def test_only_letters_are_letters():
    for text in ("", None, "½", "²", "1_2", "Ⅳ", "①", "\U0001f600", "٣", "_-"):
        assert not langid.has_letter(text), text
    for text in ("a", "é", "ª", "日", "½ß"):
        assert langid.has_letter(text), text


EDGE = [(1000, None, "en", "a", 1), (1001, "", "fr", "a", 1), (1002, "123 .. 5", "de", "a", 1), (None, "the of and that", None, None, 1), (1003, "der und die nicht " * 5000, None, "a", 1), (3, "the of and to", "en", "a", 1)]


def frame(spark, data):
    return spark.createDataFrame(data, DOC_SCHEMA).repartition(3)


def test_held_out_accuracy_and_edge_cases(spark):
    data = rows()
    got = {r.doc_id: r for r in langid.identify(clashing(frame(spark, data + EDGE[:-1]))).collect()}
    held = [r for r in data if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in data)
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held) > 20
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "de" and got[None].lang_pred == "en" and got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())


def test_neither_label_nor_id_nor_source_of_a_row_is_an_input(spark):
    data = rows()
    model = langid.fit(frame(spark, data))
    changed = [(i + 7000, t, "xx", "other", 9) for i, t, *_ in data]
    first = [r.lang_pred for r in langid.identify(frame(spark, data), model).orderBy("doc_id").collect()]
    assert first == [r.lang_pred for r in langid.identify(frame(spark, changed), model).orderBy("doc_id").collect()]


def test_held_out_labels_are_never_learned(spark):
    data = rows()
    poisoned = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s, n) for i, t, lang, s, n in data]
    a, b = langid.fit(frame(spark, data)), langid.fit(frame(spark, poisoned))
    assert a.top.classes == b.top.classes and all(np.array_equal(x.w, y.w) for x, y in zip(a.inner, b.inner, strict=True))


def test_stage_keeps_columns_and_drops_what_has_no_language(spark):
    kept = langid.keep_identified(frame(spark, rows() + EDGE))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [r.doc_id for r in kept.collect()]
    assert not {1000, 1001, 1002} & set(ids) and ids.count(3) == 2 and len(ids) == 243


def test_one_language_none_and_an_empty_table(spark):
    one = [(i, "the of and", "en", "a", 1) for i in range(20)]
    assert {r.lang_pred for r in langid.identify(frame(spark, one)).collect()} == {"en"}
    none = [(i, "the of and", None, "a", 1) for i in range(5)]
    assert {(r.lang_pred, r.score) for r in langid.identify(frame(spark, none)).collect()} == {("und", 0.0)}
    assert langid.identify(spark.createDataFrame([], DOC_SCHEMA)).collect() == []
