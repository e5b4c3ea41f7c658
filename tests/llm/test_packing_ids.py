"""The packing operator returns the token ids themselves, piece by piece and in their sequence."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer
from util import clashing, corpus, frame

from claimweave.llm import packing


def test_documents_can_be_rebuilt_from_the_pieces(spark):
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [r for r in corpus() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    for length in (packing.LENGTH, 64):
        found = packing.pack(clashing(frame(spark, rows)), length=length, group=32).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in found:
            assert len(r.ids) == r.length
            assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
            by_doc[r.doc_id].append((r.start, r.ids))
            by_sequence[r.sequence_id].append((r.offset, r.ids))
        for doc, text, *_ in rows:
            ids = [x for _, part in sorted(by_doc[doc]) for x in part]
            assert ids == [*hf.encode(text or "", add_special_tokens=False).ids, 0]
        for places in by_sequence.values():
            at = 0
            for offset, ids in sorted(places):
                assert offset == at
                at += len(ids)
            assert at <= length


def test_added_tokens_get_the_ids_of_the_tokenizers_library():
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = packing.Tokens(packing.default_ranks())
    assert np.frombuffer(tokens.encode("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]
    rng = random.Random(8)
    parts = ["<|endoftext|>", "<|endo", "<|", "|>", "a", " ", "  ", "\n", "don't", "12", "é", "日本"]
    for _ in range(2000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 20)))
        assert np.frombuffer(tokens.encode(text), "<u4").tolist() == hf.encode(text, add_special_tokens=False).ids, repr(text)
