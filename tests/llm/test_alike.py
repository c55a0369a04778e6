"""The pipeline's near-dedup against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest

from memlake.llm import alike
from memlake.llm.common import local_roots


def shingled(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingled(t) for _, t in rows]
    ij = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = local_roots(len(rows), *(np.array([p[k] for p in ij], int) for k in (0, 1)))
    least = {}
    for r, (d, _) in zip(root, rows):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted((d for r, (d, _) in zip(root, rows) if least.get(r) == d), key=str)


def edited(r, text, n):
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"new{r.random()}"
    return " ".join(w)


def data(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefÀé", k=r.randint(1, 7))) for _ in range(300)]
    line = " ".join(r.choice(vocab) for _ in range(20))
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(30, 400))) + " " + line for _ in range(30)]
    texts = [*base, None, "", " ", "One", "one", "a b c d", "A b  c d", "a b c d e", "a b c e"]
    for t in base:
        texts += [edited(r, t, max(1, int(len(t.split()) * r.choice([0.005, 0.01, 0.02, 0.03, 0.05])))) for _ in range(3)]
    texts += [edited(r, base[0], 2) for _ in range(100)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    return [*rows, (None, "alone here"), (None, "alone here"), (None, base[1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = data(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.simhash_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((x.doc_id for x in got.collect()), key=str) == brute(rows)


def test_copies_of_similarity_80_are_one(spark):
    """Long texts with edits, which differ in more than three bits of 64; those of less similarity stay."""
    r = random.Random(5)
    base = " ".join(f"w{r.random()}" for _ in range(600))
    rows = [(0, base), (1, edited(r, base, 8)), (2, edited(r, base, 60))]
    assert [5 * len(shingled(base) & shingled(t)) >= 4 * len(shingled(base) | shingled(t)) for _, t in rows] == [True, True, False]
    got = corpus_pipeline.simhash_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {x.doc_id for x in got.collect()} == {0, 2}


def test_pairs_at_the_limit_are_candidates():
    r = np.random.default_rng(3)
    far = []
    for n in (6, 9, 45, 900):
        for _ in range(300):
            s = r.integers(0, 2**64, n, dtype=np.uint64)
            m = n // 9 if n > 6 else 0
            both = np.sort(np.r_[s[m:], r.integers(0, 2**64, max(1, m), dtype=np.uint64)])
            x, y = (alike.simhash(np.sort(v), np.zeros(len(v), int), 1)[0] for v in (s, both))
            far.append(int(np.bitwise_count(x ^ y).sum()))
    assert max(far) <= 40


def test_empty(spark):
    assert alike.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bits_of_long_texts():
    """Counters of a byte each hold no more than 255 shingles; the pieces of a long text add up."""
    r = np.random.default_rng(7)
    size = np.array([0, 1, 254, 255, 256, 511, 70_000, 3])
    doc = np.repeat(np.arange(len(size)), size)
    code = r.integers(0, 2**64, len(doc), dtype=np.uint64)
    code[doc == 5] = code[doc == 5][0]
    got = alike.simhash(code, doc, len(size))
    for d in range(len(size)):
        h = np.stack([alike.mix(code[doc == d] + alike.C1), alike.mix(code[doc == d] ^ alike.C2)], axis=1)
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        assert np.array_equal(got[d], np.packbits(2 * bits > size[d], bitorder="little").view(np.uint64))


def test_pivots_discard_and_lose_nothing():
    """In groups of near copies around different texts, pivots discard most unlike pairs, and no pair within the limit."""
    r = np.random.default_rng(8)
    size = np.array([1, 2, 40, 64, 300])
    center = r.integers(0, 2**64, (4, 2), dtype=np.uint64)
    fp = center[r.integers(0, 4, size.sum())]
    for _ in range(10):
        fp[np.arange(len(fp)), r.integers(0, 2, len(fp))] ^= np.uint64(1) << r.integers(0, 64, len(fp)).astype(np.uint64)
    fp[-30:] = r.integers(0, 2**64, (30, 2), dtype=np.uint64)
    at = np.cumsum(size) - size
    p = alike.Pivots(fp[:, 0].copy(), fp[:, 1].copy(), at, size, 40)
    unlike = discarded = 0
    for s, n in zip(at.tolist(), size.tolist()):
        i, j = (x + s for x in np.triu_indices(n, 1))
        near = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1) <= 40
        assert np.array_equal(p.near(i, j), near)
        assert all(np.array_equal(p.near(int(k), j[i == k]), near[i == k]) for k in range(s, s + n))
        unlike += int((~near).sum())
        discarded += int((~p.maybe(i, j)).sum())
    assert discarded > unlike / 2


def test_stage_compares_by_pivot_tables(spark, monkeypatch):
    made = []
    monkeypatch.setattr(alike, "Pivots", lambda *a, old=alike.Pivots: made.append(old(*a)) or made[-1])
    code = np.arange(40, dtype=np.int32) // 8
    f = np.random.default_rng(2).integers(-(2**62), 2**62, 40)
    classes = spark.createDataFrame([(i, int(f[i // 2]), int(f[i // 2 + 1]), [int(code[i])]) for i in range(40)], "c long, f0 long, f1 long, first array<int>")
    kernel = {}
    monkeypatch.setattr(type(classes), "mapInArrow", lambda self, f, schema: kernel.setdefault("f", f))
    alike.candidates(classes, 40)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(code), pa.array(range(40), pa.int64()), pa.array(f[np.arange(40) // 2]), pa.array(f[np.arange(40) // 2 + 1])], ["h", "c", "f0", "f1"])
    (out,) = list(kernel["f"](iter([batch])))
    assert made and out["a"].to_pylist() == list(range(1, 40, 2)) and out["b"].to_pylist() == list(range(0, 40, 2))
