"""Suffix-array and Lempel-Ziv dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from memlake.llm import lz_dedup, suffix_dedup, windows


def brute(rows, window, unit):
    """rows: (id, text). Returns sorted (id, n, n_removed, n_spans, sha)."""
    split = (lambda t: t.encode().split()) if unit == "words" else (lambda t: list(t.encode()))
    docs = [(d, split(t or "")) for d, t in rows]
    least = {}
    for d, t in docs:
        if d is not None:
            for i in range(len(t) - window + 1):
                k = tuple(t[i : i + window])
                least[k] = min(d, least.get(k, d))
    out = []
    for d, t in docs:
        gone = [False] * len(t)
        if d is not None:
            for i in range(len(t) - window + 1):
                if least[tuple(t[i : i + window])] < d:
                    gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(t, gone) if not g]
        raw = b" ".join(kept) if unit == "words" else bytes(kept)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(raw).hexdigest()))
    return sorted(out, key=str)


def rows(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdé", k=r.randint(1, 6))) for _ in range(60)]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", "  ", "\n", "\t"]) for _ in range(n))
    shared = [text(n) for n in (5, 12, 20, 40)]
    out = []
    for i in range(60):
        t = text(r.randint(0, 30))
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            t = t[: len(t) // 2] + s[r.randint(0, 9) :] + t[len(t) // 2 :]
        out.append((r.randint(0, 50), t))
    return out + [(3, None), (None, out[0][1]), (None, None), (7, ""), (99, out[5][1]), (99, out[5][1]), (98, "a" * 300), (97, "a" * 200), (96, "x " * 90), (95, "x " * 70)]


@pytest.mark.parametrize(("unit", "window", "op"), [("bytes", 20, suffix_dedup.suffix_dedup), ("words", 6, lz_dedup.lz_dedup)])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, unit, window, op, seed):
    data = rows(seed)
    df = spark.createDataFrame([(d, t, "s", 1, 2) for d, t in data], "doc_id long, text string, src string, id int, n_removed int").repartition(3)
    got = op(df, window)
    found = sorted(((r.id, r.n, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=str)
    assert found == brute(data, window, unit)
    assert got.where("row.src = 's' and row.id = 1").count() == len(data)


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_anchors_give_the_same(spark, hot, monkeypatch):
    data = rows(3)
    df = spark.createDataFrame(data, "doc_id long, text string")
    spec = windows.Windows("words", 6, 3, hot)
    out = windows.remove_repeats(df, spec, lz_dedup.kernel, "doc_id", "text", False)
    assert sorted(((r.id, r.n, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()), key=str) == brute(data, 6, "words")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.suffix_dedup(df).count() == 0
    assert lz_dedup.lz_dedup(df).count() == 0


def test_long_document(spark):
    t = " ".join(f"w{i}" for i in range(60_000))
    got = lz_dedup.lz_dedup(spark.createDataFrame([(1, t), (2, "z " + t[: len(t) // 2])], "doc_id long, text string")).orderBy("id").collect()
    assert got[0].n_removed == 0
    assert got[1].n - got[1].n_removed == 1 or got[1].n - got[1].n_removed == 2


def test_smaller_neighbours():
    r = np.random.Generator(np.random.PCG64(4))
    for n in (0, 1, 2, 9, 64, 65, 200):
        v = r.integers(0, 12, n)
        cut = np.sort(r.integers(0, n + 1, 5)) if n else np.zeros(0, int)
        first = np.array([max([0, *cut[cut <= i]]) for i in range(n)], int)
        stop = np.array([min([n, *cut[cut > i]]) for i in range(n)], int)
        for a, b, lo, hi in ((None, None, np.zeros(n, int), np.full(n, n)), (first, stop, first, stop)):
            prev, nxt = windows.smaller_neighbours(v, a, b)
            for i in range(n):
                assert prev[i] == max([j for j in range(lo[i], i) if v[j] < v[i]], default=-1)
                assert nxt[i] == min([j for j in range(i + 1, hi[i]) if v[j] < v[i]], default=-1)


def blocks(seed):
    r = random.Random(seed)
    texts = [[r.randint(0, 2) for _ in range(r.randint(1, 30))] for _ in range(9)]
    docs = [r.randint(0, 5) for _ in texts]
    return texts, docs, np.array([x for t in texts for x in t], np.uint64), np.r_[0, np.cumsum([len(t) for t in texts])], np.array(docs)


def test_longest_previous_factors():
    for seed in range(20):
        texts, docs, tok, off, doc = blocks(seed)
        got = lz_dedup.Block(tok, off, doc).longest()
        flat = got[~lz_dedup.Block(tok, off, doc).ends]
        w = 4
        at = np.array([o + i for o, t in zip(off, texts) for i in range(len(t) - w + 1)], np.int64)
        capped = dict(zip(at.tolist(), suffix_dedup.longest_previous(tok, at, np.repeat(doc, np.diff(off))[at], w).tolist()))
        for t, d, o in zip(texts, docs, off):
            for i in range(len(t)):
                want = max((k for k in range(len(t) - i + 1) for u, e in zip(texts, docs) if e < d and any(u[j : j + k] == t[i : i + k] for j in range(len(u) - k + 1))), default=0)
                assert flat[o + i] == want
                if o + i in capped:
                    assert capped[o + i] == (w if want >= w else 0)


def test_parse_covers_every_window():
    for seed in range(40):
        texts, docs, tok, off, doc = blocks(seed)
        block = lz_dedup.Block(tok, off, doc)
        got = lz_dedup.parse(block, 4)[~block.ends]
        for t, d, o in zip(texts, docs, off):
            have = {tuple(u[j : j + 4]) for u, e in zip(texts, docs) if e < d for j in range(len(u) - 3)}
            assert [bool(x) for x in got[o : o + len(t)]] == [len(t) - i >= 4 and tuple(t[i : i + 4]) in have for i in range(len(t))]


def test_words_as_bytes_split():
    t = ["a b", "", " \tx\x0by ", " z w", "q"]
    raw = [x.encode() for x in t]
    code, s, e, first = windows.words(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    whole = b"".join(raw)
    assert [whole[a:b] for a, b in zip(s, e)] == [w for x in raw for w in x.split()]
    assert len(set(code.tolist())) == len(code)
