"""SimHash components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from memlake.llm import simhash
from memlake.llm.common import connected_components, local_roots


def plain(text):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, most=3):
    fps = [plain(t) for _, t in rows]
    n = len(rows)
    i, j = np.triu_indices(n, 1)
    f = np.array(fps, np.uint64)
    ok = np.bitwise_count(f[i] ^ f[j]) <= most
    root = local_roots(n, i[ok], j[ok])
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root[k]] = min(d, least.get(root[k], d))
    return sorted(((d, format(fp, "016x"), least.get(root[k])) for k, ((d, _), fp) in enumerate(zip(rows, fps))), key=str)


def data(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefÀé", k=r.randint(1, 7))) for _ in range(300)]
    base = [[r.choice(vocab) for _ in range(r.randint(0, 400))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            if w:
                w[r.randrange(len(w))] = r.choice(vocab).upper()
        rows.append((r.randint(0, 400), " ".join(w)))
    return rows + [(None, None), (5, ""), (6, " \t"), (7, "one"), (8, "one two"), (9, "One TWO"), (10, "x " * 5000), (None, rows[0][1]), rows[3], rows[3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rows = data(seed)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int").repartition(3)
    out = simhash.simhash_components(df)
    got = sorted(((x.id, format(x.fp & (2**64 - 1), "016x"), x.component_id) for x in out.collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(df).count() == 0


@pytest.mark.parametrize("large", [8, 2048])
def test_large_keys_keep_links(monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    r = np.random.default_rng(3)
    center = r.integers(0, 2**64, 5, dtype=np.uint64)
    fp = np.unique(center[r.integers(0, 5, 900)] ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (3, 900)).astype(np.uint64), axis=0))
    a, b = [], []
    for m in simhash.masks(3):
        x, y = simhash.links_in(fp, fp & np.uint64(m), 3, m)
        a.append(x), b.append(y)
    i, j = np.triu_indices(len(fp), 1)
    ok = np.bitwise_count(fp[i] ^ fp[j]) <= 3
    assert np.array_equal(local_roots(len(fp), np.concatenate(a), np.concatenate(b)), local_roots(len(fp), i[ok], j[ok]))


def test_connected_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(r.randint(50, 120), r.randint(50, 120)) for _ in range(40)] + [(200, x) for x in range(201, 260)] + [(None, 1), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x.node: x.root for x in connected_components(df).collect()}
    root = local_roots(300, np.array([a for a, b in edges if a is not None]), np.array([b for a, b in edges if a is not None]))
    assert got == {i: int(x) for i, x in enumerate(root) if i != x}


def test_components_of_a_long_path(spark):
    from memlake.llm.common import connected_components

    path = spark.range(2000).selectExpr("id as a", "id + 1 as b")
    assert connected_components(path).where("root = 0").count() == 2000
