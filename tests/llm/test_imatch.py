"""I-Match fingerprints: order of documents, edited texts, and likeness."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from memlake.llm import imatch


def corpus(n=150, seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghé", k=r.randint(2, 8))) for _ in range(3000)]
    rows = [(i * 7 % 1009, " ".join(r.choice(vocab) for _ in range(r.choice([3, 40, 300, 2000])))) for i in range(n)]
    return rows + [(5000, rows[0][1]), (5001, ""), (5002, None), (None, "null id"), (rows[3][0], "again"), (rows[4][0], rows[4][1]), (6000, "日本" * 10)]


@pytest.mark.parametrize("partitions", ["1", "4"])
def test_against_next(spark, partitions):
    rows = corpus()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, range string").repartition(5)
    band = imatch.lexicon(df)
    got = imatch.against_next(df, band).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(((d is None, -(d or 0), t or "", d) for d, t in rows), key=lambda x: x[:3])
    want = []
    for i, (_, _, t, d) in enumerate(order):
        nxt = order[(i + 1) % len(order)][2]
        k = len(t) // 3
        want.append((d, len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()))
    assert sorted(((x.doc_id, x.n_chars, x.edited_sha256) for x in got), key=str) == sorted(want, key=str)
    assert all(0 <= v <= 1 for x in got for v in (x.near_edited, x.near_next))
    long = [x for x in got if x.n_chars > 200]
    assert np.mean([x.near_edited > x.near_next for x in long]) > 0.97
    assert np.mean([x.near_edited for x in long]) > 0.5 > 0.25 > np.mean([x.near_next for x in long])
    by = {}
    for x in got:
        by.setdefault(x.doc_id, set()).add(x.fingerprint)
    assert by[5000] == by[rows[0][0]] and by[5001] == by[5002]
    plain = {(x.id, x.fingerprint) for x in imatch.fingerprint(df, band).collect()}
    assert plain == {(x.doc_id, x.fingerprint) for x in got}


def test_likeness_follows_shared_terms():
    r = random.Random(2)
    for n in (20, 600, 1900):
        for share in (0.0, 0.2, 0.5, 0.9):
            diff = []
            for trial in range(30):
                pool = [f"w{trial}x{i}" for i in r.sample(range(10 * n), 2 * n)]
                band = np.sort(imatch.terms(pa.array([" ".join(pool)]))[0])
                k = int(n * share)
                f = imatch.fingerprints(pa.array([" ".join(pool[:n]), " ".join(pool[n - k : 2 * n - k])]), band)
                got = imatch.likeness(f[:1], f[1:])[0]
                assert imatch.likeness(imatch.read(imatch.written(f[:1])), imatch.read(imatch.written(f[1:])))[0] == got
                diff.append(got - share)
            # where no term is shared, an estimate can only err upwards
            assert abs(np.mean(diff)) < (0.1 if share else 0.2)


def mixed(h):
    h = h * 0x165667B19E3779F9 % 2**64
    h ^= h >> 31
    h = h * 0xC2B2AE3D27D4EB4F % 2**64
    return h ^ h >> 29


def plain(text, band):
    """A fingerprint by sets and loops, from the terms' codes alone."""
    one = 0x9E3779B97F4A7C15
    codes = {int(imatch.terms(pa.array([w]))[0][0]) for w in "".join(c if c.isalnum() else " " for c in text).split()}

    def sequence(some):
        return mixed((sum(mixed((c * one + i) % 2**64) for i, c in enumerate(sorted(some))) + len(some)) % 2**64) >> 32

    inside = codes & band
    out = [len(inside), sequence(codes), sequence(inside)]
    for seed in range(imatch.SEEDS):
        out += [sequence({c for c in inside if mixed((c + (seed + 1) * one) % 2**64) < 2 ** (64 - size)}) for size in imatch.SIZES]
    return "".join(f"{x:08x}" for x in out)


def test_plain_fingerprints():
    r = random.Random(3)
    words = ["".join(r.choices("abcdé", k=r.randint(1, 6))) for _ in range(300)]
    band = np.sort(np.unique(imatch.terms(pa.array([" ".join(words[::2])]))[0]))
    texts = [" ".join(r.choices(words, k=k)) for k in (0, 1, 5, 80, 400)] + ["", "zzz yyy", "B " + words[0]]
    want = [plain(t.lower(), set(map(int, band))) for t in texts]
    assert imatch.written(imatch.fingerprints(pa.array(texts), band)) == want


def test_lexicon_band(spark):
    df = spark.createDataFrame([(i, f"common {'half' if i % 2 else 'x'} rare{i} {'some' if i < 15 else ''}") for i in range(100)], "doc_id long, text string")
    band = imatch.lexicon(df)
    code = {w: imatch.terms(pa.chunked_array([pa.array([w])]))[0][0] for w in ("common", "half", "some", "rare1")}
    assert code["some"] in band and not {code["common"], code["half"], code["rare1"]} & set(band.tolist())


def test_band_is_bounded_by_its_lower_edge(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(1000) if i % (j + 1) == 0)) for i in range(60)], "doc_id long, text string")
    wide, narrow = imatch.lexicon(df, pairs=10**6), imatch.lexicon(df, pairs=20)
    assert set(narrow.tolist()) <= set(wide.tolist()) and len(narrow) <= 20 < len(wide)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert imatch.against_next(df, imatch.lexicon(df)).count() == 0
