"""SentencePiece encoding and decoding against the library."""

import random

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from memlake.llm import pieces

NAME = "piece_bpe_32k.model"
SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(NAME))
TEXTS = ["", "a", " a", "a  b", "   x ", " ", "日本𠮷x\n\n", "▁x y", "aaaaaaaaaaaaaaaaaaaaa", "the the", "\x00a\x00", "tion" * 30, "!!!???...", "1234567890", "x" * 3000, "ab " * 500]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdest \nßé日▁."), st.characters(exclude_categories=["Cs"]))), max_size=6))
def test_any_text(texts):
    m = pieces.model(NAME)
    for t, x in zip(texts, m.encode(texts), strict=True):
        ids = np.frombuffer(x, "<u4")
        assert ids.tolist() == SP.encode(t)
        assert m.decode(ids) == SP.decode(SP.encode(t))


def test_documents(spark):
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choices(["th", "e", "er", "ing", " ", "in", "Über", "ção", "."], k=r.randint(0, 200))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (3, texts[3])]
    enc = pieces.encode(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, ids int").repartition(3))
    assert sorted(((x.id, x.ids) for x in enc.collect()), key=str) == sorted(((d, SP.encode(t or "")) for d, t in rows), key=str)
    back = sorted(((x.id, x.text) for x in pieces.decode(enc).collect()), key=str)
    assert back == sorted(((d, (t or "").replace("▁", " ")) for d, t in rows), key=str)


def test_small_chunks(monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 20)
    monkeypatch.setattr(pieces, "KEPT", 5)
    m = pieces.model(NAME)
    m.known.clear()
    assert [np.frombuffer(x, "<u4").tolist() for x in m.encode(TEXTS)] == [SP.encode(t) for t in TEXTS]


def test_empty(spark):
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
