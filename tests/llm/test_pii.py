"""Personal data: base spans against Python's re, and contextual extraction."""

import hashlib
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from memlake.llm import pii

RE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def brute(t):
    out = []
    for k, (kind, e) in enumerate(RE.items()):
        for m in e.finditer(t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def texts():
    r = random.Random(1)
    bits = ["a@b.c", "x.y+z%q@mail-1.example.com", "@", "a@b", "1.2.3.4", "255.255.255.255", "256.1.1.1", "007.08.1.0000255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "12", "1  23", "+1 (234) 555-1234", "+12", "+1 2", "+44.20.7946.0958", "é", "😀", " ", "  ", "\n", "_", "%", "-", ".", "word", "9" * 25, "a@b.com_x@y.z", "a@b.c.@d.e", "1-2-3", "(", ")", "+", "+1+123456789012"]
    return ["".join(r.choices(bits, k=r.randint(0, 14))) for _ in range(600)] + ["", None, "a" * 5_000, "1" * 5_000 + "x", "1.2." * 3_000, "+1" * 5_000, "a@b.c " * 300]


def test_base_spans(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a@b.c"), (1, texts()[1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, key int").repartition(3)
    out = pii.find_pii(df).withColumn("said", pii.said(F.col("base")))
    got = sorted(((x.id, [tuple(s) for s in x.base], x.said) for x in out.collect()), key=str)
    want = []
    for d, t in rows:
        b = brute(t)
        want.append((d, b, ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b)))
    assert got == sorted(want, key=str)
    for x in out.collect():
        assert set(map(tuple, x.base)) <= set(map(tuple, x.spans))


def test_long_texts_take_linear_time(spark):
    df = spark.createDataFrame([(1, "a" * 1_000_000), (2, "1" * 500_000), (3, "1.2." * 30_000), (4, "é@" * 200_000)], "doc_id long, text string")
    got = {x.id: len(x.base) for x in pii.find_pii(df).collect()}
    assert got == {1: 0, 2: 0, 3: 15_000, 4: 0}


def test_context_finds_unseen(spark):
    r = random.Random(3)
    rows = []
    for i in range(60):
        w = ["lorem", "ipsum", "dolor", "amet"] * 5
        w.insert(r.randrange(len(w)), f"host: {r.randint(1, 250)}.{r.randint(1, 250)}.7.{r.randint(1, 99)}")
        rows.append((i, " ".join(w)))
    rows.append((100, "lorem host: 300.12.13.14, amet"))  # not an ip by its parts, but in an ip's place
    rows.append((101, "lorem version 300.12.13.14 amet"))
    rows.append((101, "lorem version 300.12.13.14 amet"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.id: [tuple(s) for s in x.spans] for x in pii.find_pii(df).collect()}
    assert got[100] == [(12, 1, 24)]
    assert got[101] == []
    masked = {x.doc_id: x.text for x in pii.mask(df).collect()}
    assert masked[100] == "lorem host: <IP>, amet" and masked[101] == rows[-1][1]
    assert pii.mask(df).count() == len(rows)


def test_context_finds_forms_that_no_base_expression_has(spark):
    r = random.Random(5)
    words = ["lorem", "ipsum", "dolor", "amet"]
    some = lambda: " ".join(r.choices(words, k=8))
    rows = [(i, f"{some()} write to {r.choice('abcd')}{i}.doe@site{chr(97 + i % 20)}.org please {some()} call +1 (212) 555-{1000 + i} today") for i in range(50)]
    rows += [(100, "lorem write to jane (at) home please"), (101, "ipsum call (212) 555-0199 today"), (102, "ipsum about 2125550199 amet"), (103, "write to 1234567 please")]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, side int, word string")
    got = {x.id: x for x in pii.find_pii(df).collect()}
    assert all(len(got[i].base) == len(got[i].spans) == 2 for i in range(50))
    assert [tuple(s) for s in got[100].spans] == [(15, 0, 29)]
    assert [tuple(s) for s in got[101].spans] == [(11, 3, 25)]
    assert not got[102].spans and not got[103].spans


def test_against_plain_bootstrapping(spark):
    """The same rounds by dictionaries, over candidates that Python's re finds."""
    r = random.Random(6)
    leads, tails = ["ip", "tel", "the", "von"], ["up", "now", "der"]
    ids = lambda: r.choice([f"{r.randint(1, 300)}.{r.randint(1, 9)}.7.{r.randint(1, 9)}", f"+1 (212) 555-{r.randint(1000, 1040)}", f"212 555 {r.randint(1000, 1020)}"])
    rows = [(i, " ".join(x for _ in range(3) for x in (r.choice(leads), ids(), r.choice(tails)))) for i in range(120)]
    found = [(d, m.start(), m.end(), m[0], t) for d, t in rows for m in re.finditer(r"(?<![A-Za-z0-9])[+(]{0,2}[0-9]++(?:[ ()./-]{1,3}+[0-9]++){0,11}+(?![A-Za-z0-9])", t) if sum(c.isdigit() for c in m[0]) >= 6]
    base = {d: brute(t) for d, t in rows}
    edge, seed = {}, {}
    for d, s, e, hit, t in found:
        hits = [b for b in base[d] if b[0] < e and b[2] > s]
        if hits:
            seed[hit] = seed.get(hit, set()) | {hits[0][1]}
        for p in ((0, t[:s].split()[-1]), (1, t[:s].split()[-1], t[e:].split()[0])):
            edge.setdefault(p, {}).setdefault(hit, set()).update({hits[0][1]} if hits else ())
    edge = {p: v for p, v in edge.items() if len(v) >= 4}
    kinds = range(4)
    score = {h: [float(k in seed.get(h, ())) for k in kinds] for v in edge.values() for h in v}
    for _ in range(3):
        pat = {p: [sum(score[h][k] for h in v) / (len(v) + 1) for k in kinds] for p, v in edge.items()}
        score = {h: s if h in seed else [max(pat[p][k] for p, v in edge.items() if h in v) for k in kinds] for h, s in score.items()}
    sure = {}
    for p, v in edge.items():
        n = [sum(k in x for x in v.values()) for k in kinds]
        best = max((pat[p][k] if n[k] >= 4 else 0.0, -k) for k in kinds)
        if best[0] >= 0.4:
            sure[p] = best
    want = {}
    for d, s, e, _, t in found:
        if not any(b[0] < e and b[2] > s for b in base[d]):
            best = max((sure[p] for p in ((0, t[:s].split()[-1]), (1, t[:s].split()[-1], t[e:].split()[0])) if p in sure), default=None)
            if best:
                want.setdefault(d, []).append((s, -best[1], e))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.id: sorted(set(map(tuple, x.spans)) - set(map(tuple, x.base))) for x in pii.find_pii(df, confidence=0.4).collect()}
    assert want and {d: x for d, x in got.items() if x} == want


def test_found_spans_of_the_test_tables(spark):
    """What is added touches no base span, and is a candidate of its kind's class."""
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = {x.doc_id: x.text for x in docs.select("doc_id", "text").collect()}
    for x in pii.find_pii(docs).where("size(spans) > size(base)").collect():
        for s in set(map(tuple, x.spans)) - set(map(tuple, x.base)):
            hit = text[x.id][s[0] : s[2]]
            assert not any(b[0] < s[2] and b[2] > s[0] for b in x.base)
            assert (s[1] == 0) == bool(re.search("[@a-z]", hit.lower())) and (s[1] == 0 or sum(c.isdigit() for c in hit) >= 6)


def test_mask_overlaps(spark):
    df = spark.createDataFrame([(1, "a 4111111111111111@b.com z", "s", 1, "p"), (2, None, "s", 1, "p"), (3, "x", None, 1, "p")], "doc_id long, text string, spans string, k1 int, row string")
    got = {x.doc_id: x.text for x in pii.mask(df).collect()}
    assert got == {1: "a <EMAIL> z", 2: None, 3: "x"} and pii.mask(df).columns == df.columns


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(df).count() == 0 and pii.mask(df).count() == 0


def test_digest(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.c and 1.2.3.4")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    x = pii.op5_pii(spark, str(tmp_path)).first()
    assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == (1, 1, 0, 0)
    assert x.base_sha256 == hashlib.sha256(b"email:0:5,ip:10:17").hexdigest()
