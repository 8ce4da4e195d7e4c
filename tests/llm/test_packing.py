import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from basalt.llm import packing as op

PATH = public_tokenizers.path("byte_bpe_50k.json")


def reference_ids(text):
    t = Tokenizer.from_file(PATH)
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


TEXTS = [None, "", " ", "a", "<|endoftext|> x", "a  <|endoftext|><|endoftext|>\n b<|endoftext", "It's  we'll\n\n\n end \t", "日本語 ñandú Ünder 🙂🙂‍", "x" * 3000, " " * 5000, "1234567890" * 50, "The quick brown fox. " * 900, "\r\n\r\n a b　c"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_library(text):
    assert [*op.encoder(PATH)(text or ""), 1] == reference_ids(text)


def test_special_strings_give_their_ids():
    assert op.encoder(PATH)("a<|endoftext|>").tolist()[-1] == 50256


def test_very_long_runs():
    for text in ("a" * 300_000, " " * 300_000, "ab c" * 100_000):
        assert op.encoder(PATH)(text).tolist() == reference_ids(text)[:-1]


def test_cut_covers_and_wastes_little():
    for n in range(1, 5000):
        pieces = op.cut(n)
        assert sum(pieces) == n and max(pieces) <= 2048 and min(pieces) > 0
    assert op.cut(2048) == [2048] and op.cut(4096 + 5) == [2048, 2048, 5]


def test_round_trip_and_padding(spark):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "Beta,", "ñ", "x1"]) for _ in range(rng.choice([3, 50, 700, 2500]))) for _ in range(300)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, "a", "s"), (None, "b", "s")]
    got = op.pack(spark.createDataFrame(rows, "doc_id bigint, text string, length string").repartition(3), PATH).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length
    for i, t in enumerate(texts):
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        copies = 2 if i == 3 else 1
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist()
        assert ids == reference_ids(t) * copies
        assert sum(r.length for r in pieces) == copies * pieces[0].doc_tokens
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in by_doc[None]] == [reference_ids("b")]
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    used = sum(r.length for r in got)
    assert used >= 0.95 * 2048 * (len(by_seq) - 3)


def test_empty_table(spark):
    assert op.pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []
