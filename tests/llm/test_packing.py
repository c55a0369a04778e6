"""Packing: whole, exact, and with little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from memlake.llm import packing


@pytest.fixture(scope="module")
def slow():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_every_id_once(spark, slow):
    r = random.Random(2)
    words = ["the", "ation", "Éa", "\n", "12", "  ", "it's", "日本", "<|endoftext|>"]
    rows = [(i, " ".join(r.choices(words, k=r.choice([0, 1, 5, 40, 200, 900])))) for i in range(120)]
    rows += [(None, None), (3, rows[3][1]), (7, ""), (8, "a" * 5000), (9, "word " * 4000)]
    size, grain = 128, 32
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, length int").repartition(3)
    got = packing.pack(df, size, grain).collect()
    want = sorted((d if d is not None else -1, tuple([*slow.encode(t or "", add_special_tokens=False).ids, 0])) for d, t in rows)
    left = defaultdict(list)
    for d, ids in want:
        left[d].append(ids)
    # pieces of a document in order, matched by length, then by checksum
    by = defaultdict(list)
    for x in got:
        by[(x.doc_id if x.doc_id is not None else -1, x.doc_tokens)].append(x)
    for (d, n), xs in by.items():
        own = [ids for ids in left[d] if len(ids) == n]
        at = packing.cuts(n, size, grain)
        assert at[0] == 0 and at == sorted(set(at)) and max(np.diff(at)) <= size
        crc = sorted((i, j - i, zlib.crc32(np.array(ids[i:j], "<u4").tobytes())) for ids in own for i, j in zip(at[:-1], at[1:], strict=True))
        assert sorted((x.start, x.length, x.ids_crc32) for x in xs) == crc
    assert sum(x.length for x in got) == sum(len(ids) for _, ids in want)
    seqs = defaultdict(list)
    for x in got:
        seqs[x.sequence_id].append((x.offset, x.length))
    pad = 0
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= size
        pad += 0 if at & (at - 1) == 0 else size - at
    assert pad < 0.05 * sum(x.length for x in got)


def test_plan_against_bound():
    r = np.random.default_rng(1)
    lengths = np.unique(r.integers(1, 60, 25))
    demand = r.integers(1, 50, len(lengths))
    plan = packing.plan(lengths, demand, 60)
    assert np.array_equal(sum(a * n for a, n in plan), demand)
    assert all(a @ lengths <= 60 for a, _ in plan)
    _, x = packing.column_generation(lengths, demand.astype(float), 60)
    assert int(lengths @ demand) / 60 <= x.sum() + 1e-6
    assert sum(n for _, n in plan) <= x.sum() + 3


def test_knapsack_is_best():
    r = np.random.default_rng(2)
    lengths = np.array([3, 5, 8, 11])
    for _ in range(20):
        price = r.random(4)
        best = max((np.array([a, b, c, d]) @ price for a in range(8) for b in range(5) for c in range(3) for d in range(3) if np.array([a, b, c, d]) @ lengths <= 23))
        found, top = packing.knapsacks(price * 2, lengths, 23, 4)
        assert abs(top - 2 * best) < 1e-9 and abs(found[0] @ price - best) < 1e-9
        assert all(a @ lengths <= 23 for a in found)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_needs_no_threads_of_blas(monkeypatch):
    """The driver has been seen to stand still in a threaded inv."""

    def stands(*a):
        raise AssertionError("threaded")

    for name in ("inv", "solve"):
        monkeypatch.setattr(np.linalg, name, stands)
    test_plan_against_bound()
    a = np.random.default_rng(4).integers(0, 5, (40, 40)).astype(float)
    assert np.allclose(packing.times(a, packing.inverse_of(a)), np.eye(40), atol=1e-8)


def test_second_tokenizer_is_loaded_for_texts_that_ask_for_it(monkeypatch):
    import tokenizers

    loaded = []

    class Counted:
        @staticmethod
        def from_file(path):
            loaded.append(path)
            return Tokenizer.from_file(path)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    monkeypatch.setattr(packing, "_encoder", None)
    encode = packing.encoder("byte_bpe_50k.json")
    assert len(encode("plain words")) and not loaded
    assert len(encode(packing.SPECIAL)) == len(encode(packing.SPECIAL)) == 1 and len(loaded) == 1
