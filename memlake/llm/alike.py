"""Near-dedup of texts by their shingles: SimHash with pivot distance tables for candidates, exact similarity for links.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8
or more. Candidates are found in two steps. All texts put their shingles in one order;
of a text's n shingles, two that are alike share one of the first n - ceil(0.8 n) + 1, so
texts meet under those shingles and no linked pair escapes. The order has frequent shingles (of a
sample) last; which ones they are changes the work only. Texts that meet under a shingle are a group with a
table of their SimHash fingerprints' distances to pivots, some of the group's own; a pair whose distances to
a pivot differ by more than the limit is discarded, and what is left is compared by the
fingerprints themselves. These have 128 bits: at similarity 0.8 about 20 differ, and the limit of 40 is
passed by a linked pair with probability under 1e-4, in the usual estimate; unrelated texts differ in 64.
Candidates' components are then linked by the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import bytes_of, checkpointed, columns_of, connected_components, lean, local_roots, numbers_of, partitions, slices
from memlake.llm.windows import C1, C2, U, grams, mix, words

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAMPLE = 4000  # documents whose shingles tell which are frequent
OFTEN = 8
MOST = 65_536  # frequent shingles that are sent everywhere
SMALL = 64
PIVOTS = 3  # of each group
LANES = U(0x0101010101010101)


def shingles(column, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct shingles with their text's place, sorted by both, and the number of texts. A text of fewer words is one shingle."""
    buf, off = bytes_of(column)
    code, _, _, first = words(LOWER[buf], off)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0))
    start = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(n - k + 1, 0)) - np.maximum(n - k + 1, 0), np.maximum(n - k + 1, 0)) + first[doc]
    h = [grams(code, k)[start]] if len(start) else []
    docs = [doc]
    for s in range(1, k):
        short = np.flatnonzero(n == s)
        if len(short):
            h.append(mix(grams(code, s)[first[short]] + U(s)))
            docs.append(short)
    code, doc = np.concatenate(h) if h else np.empty(0, U), np.concatenate(docs)
    order = np.argsort(code)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(n) <= 65_536 else np.int64), kind="stable")]
    code, doc = code[order], doc[order]
    new = np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])] if len(code) else np.empty(0, bool)
    return code[new], doc[new], len(n)


def simhash(code: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """128 bits of each text as two numbers, a bit set if over half of the shingles have it.

    Shingles of one text stand together. Up to 255 are added at once, eight counters of a byte in one number.
    """
    count = np.zeros((n, 2, 8, 8), np.int64)  # number, bit of a byte, byte
    for i in range(0, len(code), 65_536):
        c, d = code[i : i + 65_536], doc[i : i + 65_536]
        start = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        place = np.arange(len(d)) - np.repeat(start, np.diff(np.r_[start, len(d)]))
        at = np.flatnonzero(place % 255 == 0)
        part = np.empty((len(at), 2, 8), U)
        for j, h in enumerate((mix(c + C1), mix(c ^ C2))):
            for k in range(8):
                part[:, j, k] = np.add.reduceat((h >> U(k)) & LANES, at)
        some = np.flatnonzero(place[at] == 0)
        count[d[start]] += np.add.reduceat(part.view(np.uint8).reshape(len(at), 2, 8, 8), some, axis=0, dtype=np.int64)
    bits = count.transpose(0, 1, 3, 2).reshape(n, 128)
    return np.packbits(2 * bits > np.bincount(doc, minlength=n)[:, None], axis=1, bitorder="little").view(U)


def classes_of(code: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each text's set of shingles."""
    total = np.zeros(n, U)
    if len(code):
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        total[doc[at]] = np.add.reduceat(mix(code ^ C1), at)
    return mix(total + np.bincount(doc, minlength=n).astype(U) * C1)


def inside(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x if len(sorted_) else np.zeros(len(x), bool)


def needed(n: np.ndarray, least: float) -> np.ndarray:
    """How many of n shingles, first in the order, are enough to meet every text that is alike."""
    return np.where(n > 0, n - np.ceil(least * n - 1e-9).astype(np.int64) + 1, 0)


def spread(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each component of n nodes; near(i, rest) says which of the rest link to i."""
    rest, a, b = np.arange(n), [], []
    while len(rest) > 1:
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            ok = near(i, rest)
            hit, rest = rest[ok], rest[~ok]
            a.append(np.full(len(hit), i))
            b.append(hit)
            todo.extend(hit.tolist())
    return (np.concatenate(a), np.concatenate(b)) if a else (rest[:0], rest[:0])


class Pivots:
    """Fingerprints in groups that stand together, with a table of distances to pivots, `most` for each group.

    A group's pivots are its own fingerprints: the first, then each time the first that is beyond
    the limit from those before, so they stand in different clusters. By the triangle inequality two whose distances to one pivot differ by more
    than the limit can't be linked, and are not compared. Pivots from elsewhere would tell nothing: all distances to them are near 64.
    """

    def __init__(self, f0: np.ndarray, f1: np.ndarray, at: np.ndarray, size: np.ndarray, bits: int, most: int = PIVOTS):
        self.f0, self.f1, self.bits = f0, f1, bits
        self.table = np.empty((most, len(f0)), np.int16)
        group = np.repeat(np.arange(len(at)), size)
        nearest, pivot = np.full(len(f0), 129, np.int16), at
        for d in self.table:
            d[:] = self.apart(np.arange(len(f0)), pivot[group])
            np.minimum(nearest, d, out=nearest)
            far = np.r_[np.flatnonzero(nearest > bits), len(f0)]
            first = far[np.searchsorted(far, at)]
            pivot = np.where(first < at + size, first, at)

    def apart(self, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.f0[i] ^ self.f0[j]).astype(np.int16) + np.bitwise_count(self.f1[i] ^ self.f1[j])

    def maybe(self, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        """Which pairs no pivot discards."""
        ok = np.ones(len(j), bool)
        for d in self.table:
            ok &= np.abs(d[i] - d[j]) <= self.bits
        return ok

    def near(self, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        """Which pairs of one group differ in at most `bits` bits."""
        ok = self.maybe(i, j)
        ok[ok] = self.apart(i if np.ndim(i) == 0 else i[ok], j[ok]) <= self.bits
        return ok


def frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted shingles of at least OFTEN of a sample's documents. They only order the rest."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, "text")):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(b["text"], k)[0].view(np.int64))], ["h"])

    every = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("k", F.lit(5)), F.lit(every)) == 0).select("text").mapInArrow(lean(f), "h long")
    return np.sort(columns_of(some.groupBy("h").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(MOST).select("h"))["h"].astype(np.int64).view(U))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k (the id, or for none a hash of the text), id, text."""
    text, i = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    return docs.select(F.coalesce(i, F.xxhash64(text)).alias("k"), i.alias("id"), text.alias("text"))


def marked(docs: DataFrame, often: np.ndarray, k: int, least: float) -> DataFrame:
    """k, id, class c, fingerprint f0, f1 and the first shingles, as 32 bits each, of every document."""
    held = docs.sparkSession.sparkContext.broadcast(often)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, "text")):
            code, doc, n = shingles(b["text"], k)
            fp, c = simhash(code, doc, n), classes_of(code, doc, n)
            order = np.lexsort((code, inside(held.value, code), doc))
            size = np.bincount(doc, minlength=n)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
            first = code[order][place < np.repeat(needed(size, least), size)]
            off = np.r_[0, np.cumsum(needed(size, least))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array((first >> U(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([b["k"], b["id"], pa.array(c.view(np.int64)), *[pa.array(fp[:, i].copy().view(np.int64)) for i in (0, 1)], lists], ["k", "id", "c", "f0", "f1", "first"])

    return docs.mapInArrow(lean(f), "k long, id long, c long, f0 long, f1 long, first array<int>")


def candidates(classes: DataFrame, bits: int) -> DataFrame:
    """Links a, b that join the components of classes which share a first shingle and differ in at most `bits` bits."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(numbers_of(b["h"], np.int32), *[numbers_of(b[x]) for x in ("c", "f0", "f1")]) for b in batches if b.num_rows]
        if not got:
            return
        h, c, f0, f1 = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(h, kind="stable")
        h, c, f0, f1 = h[order], c[order], f0[order].view(U), f1[order].view(U)
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[at, len(h)])
        pivots = Pivots(f0, f1, at, size, bits)
        name, node = np.unique(c, return_inverse=True)
        root = np.arange(len(name))

        def link(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal root
            old = np.flatnonzero(root != np.arange(len(root)))
            root = local_roots(len(root), np.r_[old, node[a]], np.r_[root[old], node[b]])

        last = np.repeat(np.where(size <= SMALL, at + size, at), size)
        i = np.arange(len(h))
        a, b = [i[:0]], [i[:0]]
        for d in range(1, SMALL):
            i = i[i + d < last[i]]
            if not len(i):
                break
            ok = pivots.near(i, i + d)
            a.append(i[ok])
            b.append(i[ok] + d)
        for s, n in zip(at[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            p, q = spread(n, lambda j, rest, s=s: pivots.near(s + j, s + rest))
            a.append(p + s)
            b.append(q + s)
        link(np.concatenate(a), np.concatenate(b))
        n = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(name[n]), pa.array(name[root[n]])], ["a", "b"])

    dealt = classes.select(F.explode("first").alias("h"), "c", "f0", "f1")
    return dealt.repartition(partitions(classes.sparkSession), "h").mapInArrow(lean(f), "a long, b long")


def linked(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the components of sets with a Jaccard similarity of `least` or more."""
    own = np.array([len(s) for s in sets])
    _, inv = np.unique(np.concatenate(sets), return_inverse=True)
    part = np.split(inv, np.cumsum(own)[:-1])
    flag = np.zeros(len(inv) + 1, np.int64)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        ok = np.minimum(own[rest], own[i]) >= least * np.maximum(own[rest], own[i]) - 1e-9
        maybe = rest[ok]
        if len(maybe):
            flag[part[i]] = 1
            both = np.add.reduceat(flag[np.concatenate([part[j] for j in maybe])], np.cumsum(own[maybe]) - own[maybe])
            flag[part[i]] = 0
            ok[ok] = both >= least * (own[i] + own[maybe] - both) - 1e-9
        return ok

    return spread(len(sets), near)


def verified(docs: DataFrame, members: DataFrame, k: int, least: float) -> DataFrame:
    """Of classes c with a candidates' component `root`, those that exact similarity links: node, and its component's smallest class."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, "text")):
            code, doc, n = shingles(b["text"], k)
            c = classes_of(code, doc, n).view(np.int64)
            own = np.split(code, np.cumsum(np.bincount(doc, minlength=n))[:-1])
            at = np.flatnonzero(c == numbers_of(b["c"]))
            yield pa.RecordBatch.from_arrays([b["root"].take(pa.array(at)), pa.array(c[at]), pa.array([own[i].tobytes() for i in at], pa.binary())], ["root", "c", "own"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, dict[int, bytes]] = {}
        for b in batches:
            for r, c, s in zip(b["root"].to_pylist(), b["c"].to_pylist(), b["own"].to_pylist(), strict=True):
                groups.setdefault(r, {})[c] = s
        out: list[tuple[int, int]] = []
        while groups:
            _, g = groups.popitem()
            name = np.array(sorted(g))
            a, b = linked([np.frombuffer(g[c], U) for c in name.tolist()], least)
            root = local_roots(len(name), a, b)
            n = np.flatnonzero(root != np.arange(len(name)))
            out += zip(name[n].tolist(), name[root[n]].tolist(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["node", "comp"])

    text = docs.join(members, "k").select("text", "c", "root").mapInArrow(lean(sets), "root long, c long, own binary")
    return text.repartition(partitions(docs.sparkSession), "root").mapInArrow(lean(f), "node long, comp long")


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8, bits: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each component of texts alike: its smallest id, once. Components of null ids alone stay whole.

    A-Z are lower-cased, words end at ASCII white space, shingles are a set. Texts without words, null or empty, are alike.
    """
    plain = keyed(docs, id_col, text_col)
    rows = checkpointed(marked(plain, frequent(plain, words), words, least))
    classes = checkpointed(rows.groupBy("c").agg(F.min("id").alias("id"), F.min("k").alias("k"), F.first(F.struct("f0", "f1", "first")).alias("x")).select("c", "id", "k", "x.*"))
    near = connected_components(candidates(classes, bits))
    group = near.unionByName(near.select(F.col("root").alias("node"), "root")).distinct()
    members = classes.join(group, F.col("c") == F.col("node")).select("k", "c", "root")
    links = checkpointed(verified(plain, members, words, least))
    named = classes.select("c", "id").join(links, F.col("c") == F.col("node"), "left").select("c", "id", F.coalesce("comp", "c").alias("comp"))
    first = named.groupBy("comp").agg(F.min("id").alias("first"))
    kept = first.where("first is not null").select(F.col("first").alias("__kept"))
    stay = docs.join(kept, F.col(id_col).cast("long") == F.col("__kept"), "left_semi").dropDuplicates([id_col])
    none = docs.where(F.col(id_col).isNull())
    if none.isEmpty():
        return stay
    alone = named.join(first.where("first is null"), "comp").select(F.col("c").alias("__c"))

    @F.pandas_udf("long")
    def class_of(text):
        import pandas as pd

        return pd.Series(classes_of(*shingles(pa.array([x or "" for x in text], pa.large_string()), words)).view(np.int64))

    return stay.unionByName(none.withColumn("__c", class_of(F.col(text_col).cast("string"))).join(alone, "__c", "left_semi").drop("__c"))
