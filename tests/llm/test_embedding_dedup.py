"""Embedding near-dedup against all cosines."""

import math

import numpy as np
import pytest

from memlake.llm import embedding_dedup as e
from memlake.llm.common import local_roots


def data(seed, n=400, dim=16):
    r = np.random.default_rng(seed)
    centers = r.standard_normal((12, dim))
    rows = []
    for i in range(n):
        v = centers[r.integers(12)] * r.uniform(0.5, 3) + r.standard_normal(dim) * r.choice([0.0, 0.05, 0.15, 1.0])
        rows.append((int(i), [float(np.float32(x)) for x in v], int(r.integers(3)) if r.random() > 0.05 else None))
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(60)] + [(rows[0][0], rows[0][1], rows[0][2])]
    rows += [(2000, None, 1), (2001, [0.0] * dim, 1), (2002, [float("nan")] * dim, 1), (2003, [1.0] * (dim - 1) + [float("inf")], 1), (2004, [], 1), (2005, [None] * dim, 1), (2006, rows[5][1][:-1], rows[5][2]), (None, rows[5][1], rows[5][2])]
    return rows


def brute(rows, limit=0.98):
    ok = [i is not None and lab is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    links, a, b = [0] * len(rows), [], []
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1]), np.array(rows[j][1])
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= limit:
                    links[i] += 1
                    links[j] += 1
                    a.append(i), b.append(j)
    # rows of one id are one node
    first = {}
    for k, x in enumerate(rows):
        if x[0] is not None:
            a.append(k), b.append(first.setdefault(x[0], k))
    root = local_roots(len(rows), np.array(a), np.array(b))
    least = {}
    for k, x in enumerate(rows):
        if x[0] is not None:
            least[root[k]] = min(x[0], least.get(root[k], x[0]))
    comp = [least.get(root[k]) if x[0] is not None else None for k, x in enumerate(rows)]
    return sorted(((x[0], n, c, x[0] == c) for x, n, c in zip(rows, links, comp)), key=str)


@pytest.mark.parametrize("block", [1024, 7])
def test_links_and_components(spark, block):
    rows = data(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted((tuple(x) for x in e.embedding_dedup(df, miss=1e-6, block=block).collect()), key=str)
    assert got == brute(rows)


def test_recall_by_tables():
    bits, tables = e.sizes(50_000, 0.98, 0.001)
    p = (1 - math.acos(0.98) / math.pi) ** bits
    assert (1 - p) ** tables <= 0.001


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert e.embedding_dedup(df).count() == 0
    df = spark.createDataFrame([(1, None, None)], "vec_id long, embedding array<float>, label int")
    assert [tuple(x) for x in e.embedding_dedup(df).collect()] == [(1, 0, 1, True)]
