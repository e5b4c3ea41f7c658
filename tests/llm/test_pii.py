import hashlib
import re
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from util import DOC_SCHEMA, clashing, corpus, frame

from claimweave.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    if not 13 <= len(d) <= 19:
        return False
    total = 0
    for i, x in enumerate(reversed(d)):
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def slow_base(text):
    text = text or ""
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if slow_luhn(m.group())]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


PIECES = ["a.b@c-d.com", "x@y", "@", "a@b.c_d@e.f", "1.2.3.4", "256.1.1.1", "0" * 401 + ".1.1.1", "1.0255.00256.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "+1 (487) 555-7209", "+12", "-", " ", ".", "+", "(", "7", "99999999999999999999", "é", "\n", "zz"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join) | st.text(alphabet="1@.a+- ()_", max_size=40))
def test_base_spans_match_the_contract_patterns(text):
    assert pii.base_spans(text) == slow_base(text)


def test_base_patterns_are_linear_in_hostile_texts():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+1" + "(" * 200_000, "1." * 100_000, "@" * 100_000, "1 " * 100_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def private_rows():
    rows = corpus(n=30)
    at = 100
    for i in range(60):
        rows.append((at + i, f"the mail is u{i}@mail{i % 7}.example.com and call +1 (4{i:02d}) 555-72{i:02d} from 10.2.{i}.7 with {"4111 1111 1111 1111" if i % 3 else "4111111111111111"} or token 12345{i}", "en", "a", 1))
    rows.append((200, "pay with 4111111111111111 5500005555555559 now, later again 4111111111111111", "en", "a", 1))
    rows.append((201, "call +1 (826) 555-4081 190.137.223.204 please", "en", "a", 1))
    return rows


def test_base_columns_and_added_spans(spark, private_rows):
    found = pii.find_private(clashing(frame(spark, private_rows))).collect()
    assert len(found) == len(private_rows)
    texts = {}
    for r in private_rows:
        texts.setdefault(r[0], r[1])
    by_id = {r.doc_id: r for r in found}
    for doc, row in by_id.items():
        base = slow_base(texts[doc])
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert row.base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert set(pii.listed(base).split(",")) <= set(row.spans.split(","))
    assert "card:9:25" in by_id[200].spans and "card:26:42" in by_id[200].spans
    assert "phone:5:22" in by_id[201].spans and "ip:23:38" in by_id[201].spans
    for doc in range(30):  # plain prose stays clean
        assert by_id[doc].spans == ""


def test_message_passing_is_exact_on_trees():
    rng = np.random.default_rng(1)
    field = pii.Field(rng.normal(size=(len(pii.FEATURES), 5)), rng.normal(size=(3, 5, 5)))
    features, edges = [[0, 1], [2], [3, 4], [5]], [(0, 1, 0), (1, 2, 1), (1, 3, 2)]
    own = np.stack([field.unary[f].sum(0) for f in features])
    want = np.zeros((4, 5))
    for labels in product(range(5), repeat=4):
        w = np.exp(sum(own[i, x] for i, x in enumerate(labels)) + sum(field.pair[e, labels[i], labels[j]] for i, j, e in edges))
        for i, x in enumerate(labels):
            want[i, x] += w
    want /= want.sum(1, keepdims=True)
    assert np.allclose(field.marginals(features, edges), want, atol=1e-3)
    apart = field.marginals(features * 2, edges + [(i + 4, j + 4, e) for i, j, e in edges], cuts=[0, 4, 8])
    assert np.array_equal(apart[:4], apart[4:]) and np.array_equal(apart[:4], field.marginals(features, edges))


def test_evidence_reaches_the_far_end_of_a_chain_of_repeats():
    unary, pair = np.zeros((len(pii.FEATURES), 5)), np.zeros((3, 5, 5))
    unary[1, 2], pair[1] = 6, 4 * np.eye(5)
    n = 60
    p = pii.Field(unary, pair).marginals([[1]] + [[0]] * (n - 1), [(i, i + 1, 1) for i in range(n - 1)])
    assert p[12, 2] > 0.4 and (p[:, 2] > 0.2).all() and (np.diff(p[:, 2]) < 0).all()


def test_redaction_masks_and_keeps_the_columns(spark, private_rows):
    docs = frame(spark, private_rows)
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).columns == docs.columns
    assert out[200].text == "pay with <CARD> <CARD> now, later again <CARD>" and out[200].n_chars == len(out[200].text)
    assert out[0].text == next(r[1] for r in private_rows if r[0] == 0)
    assert out[30].text is None
    assert pii.mask("abcdef", [(3, 0, 4), (2, 2, 5)]) == "<PHONE>f"


def test_empty_table(spark):
    assert pii.find_private(spark.createDataFrame([], DOC_SCHEMA)).collect() == []
