"""Windows of tokens that also start in a document with a smaller id.

The frame that suffix-array dedup (bytes) and relative Lempel-Ziv dedup (words) share.
A window is `window` consecutive tokens of one document. Every window has an anchor, the
smallest hash among its grams, so equal windows have equal anchors, wherever they stand.

1. Documents are dealt once by a hash of their id into groups of a few megabytes; a text
   with copies is worked on only for its smallest id (its later copies are known whole).
2. Each group says once which anchors it has and in how many documents; an anchor that
   more than one document has is told back to those groups. A very frequent anchor so
   costs a row per group, not a row per document.
3. Groups send the stretches of tokens under shared anchors, equal stretches once, to the
   anchor's partition, where a kernel indexes the block of stretches and finds windows that an
   earlier document has (suffix_dedup.py, lz_dedup.py). Anchors of more than `hot` documents send each window under its
   own hash instead, so that such an anchor spreads over all partitions.
4. Spans return to the documents' groups.

No step holds more than a group of documents or a partition of stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.common import bytes_of, lean, numbers_of, partitions, text_key

U = np.uint64
C1, C2, C3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
_rng = np.random.Generator(np.random.PCG64(20))
CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
STEP = U(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Windows:
    """What a token is, how long a window is, and the gram that anchors are made of."""

    unit: str  # bytes or words
    window: int
    gram: int
    hot: int = 20_000

    def __post_init__(self):
        if self.unit not in ("bytes", "words") or not 1 <= self.gram <= self.window:
            raise ValueError(f"bad windows: {self}")


def mix(h: np.ndarray) -> np.ndarray:
    h = h * C3
    h ^= h >> U(31)
    h *= C2
    h ^= h >> U(29)
    return h


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and each document's first word. Words end at white space and at documents' ends."""
    if not len(buf):
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    on = ~SPACE[buf]
    before, after = np.empty(len(on), bool), np.empty(len(on), bool)
    before[0], before[1:] = False, on[:-1]
    after[-1], after[:-1] = False, on[1:]
    inner = off[:-1][np.diff(off) > 0]
    before[inner] = False
    after[inner[1:] - 1] = False
    starts, ends = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1
    size = ends - starts
    if not len(size):
        return np.empty(0, U), starts, ends, np.zeros(len(off), np.int64)
    first = np.cumsum(size) - size
    at = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
    power = np.cumprod(np.full(int(size.max()), STEP), dtype=np.uint64)
    code = np.add.reduceat(CODES[buf[on]] * power[at], first)
    return mix(code ^ (size.astype(U) * C1)), starts, ends, np.searchsorted(starts, off)


def tokens(spec: Windows, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if spec.unit == "bytes":
        return buf, off
    code, _, _, first = words(buf, off)
    return code, first


def grams(tok: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k tokens from each position on."""
    h, span = mix(tok.astype(U) + C1), 1
    out, have = None, 0
    while True:
        if k & span:
            if out is None:
                out = h
            else:
                n = len(h) - have
                out = mix(out[:n] * C1 + h[have : have + n]) if n > 0 else h[:0]
            have += span
        span *= 2
        if span > k:
            return out
        half = span // 2
        h = mix(h[:-half] * C1 + h[half:]) if len(h) > half else h[:0]


def runs(spec: Windows, tok: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, first window, number of windows and anchor of each run of windows with one anchor."""
    n = len(tok) - spec.window + 1
    if n <= 0:
        e = np.empty(0, np.int64)
        return e, e, e, np.empty(0, U)
    m = grams(tok, spec.gram)
    w, s = spec.window - spec.gram + 1, 1
    while s * 2 <= w:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    if s < w:
        m = np.minimum(m[: len(m) - (w - s)], m[w - s :])
    d = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = d[:n] == d[spec.window - 1 :]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (m[1:] != m[:-1]) | (d[1:n] != d[: n - 1]) | (inside[1:] != inside[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, n))
    ok = inside[at]
    return d[at[ok]], at[ok], count[ok], m[at[ok]]


def smaller_neighbours(value: np.ndarray, first: np.ndarray | None = None, stop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the previous and of the next strictly smaller value, -1 for none; within [first, stop) of each position, where given.

    Minima of the 2^k values up to each position are kept for every k, and positions step back, longest step first, while they pass nothing smaller.
    """
    n = len(value)
    start = np.zeros(n, np.int64) if first is None else first
    end = np.full(n, n) if stop is None else stop
    longest = int((end - start).max(initial=0))

    def previous(v: np.ndarray, least: np.ndarray) -> np.ndarray:
        table = [v]
        while 2 ** len(table) < longest:
            low, half = table[-1].copy(), 2 ** (len(table) - 1)
            np.minimum(low[half:], table[-1][:-half], out=low[half:])
            table.append(low)
        at = np.arange(n) - 1
        for k in range(len(table) - 1, -1, -1):
            # a step of 2^k from `at` is over table[k][at], if it stays within bounds
            step = (at - 2**k + 1 >= least) & (table[k][np.maximum(at, 0)] >= v)
            at = np.where(step, at - 2**k, at)
        return np.where((at >= least) & (v[np.maximum(at, 0)] < v), at, -1)

    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    prev = previous(value, start)
    nxt = previous(value[::-1], (n - end)[::-1])[::-1]
    return prev, np.where(nxt < 0, -1, n - 1 - nxt)


def dense(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks, in order, of tuples of keys."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def suffix_ranks(tok: np.ndarray, depth: int, at: np.ndarray | None = None) -> np.ndarray:
    """Place of every position, or of those `at` only, in the order of the suffixes, compared up to `depth` tokens, by prefix doubling.

    Positions closer than `depth` to the end are compared up to the end. Bytes start from eight at once, as they fit one number.
    """
    n = len(tok)
    if tok.dtype == np.uint8:
        have = min(8, depth)
        padded = np.append(tok.astype(U) + U(0), np.zeros(have, U))
        rank = np.zeros(n, U)
        for i in range(have):
            rank = (rank << U(8)) | padded[i : i + n]
        rank = dense(rank)
    else:
        have, rank = 1, dense(tok)
    while have < depth:
        step = min(have, depth - have)
        after = np.full(n, -1, np.int64)
        after[: max(0, n - step)] = rank[step:]
        have += step
        key = rank * (int(rank.max(initial=0)) + 2) + after + 1
        if at is not None and have >= depth:
            return dense(key[at])
        rank = dense(key)
    return rank if at is None else rank[at]


# ---- steps on groups of documents -------------------------------------------------------


def _group(left: pa.Table, right: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """The group's number, and of its rows which are the first of their text; a repeated row counts once."""
    own = set(zip(*(right.filter(right["kind"].cast(pa.int32()).to_numpy() == 0)[c].to_pylist() for c in ("id", "x", "y")), strict=True)) if right.num_rows else set()
    seen: set = set()
    first = np.zeros(left.num_rows, bool)
    for i, key in enumerate(zip(*(left[c].to_pylist() for c in ("id", "k1", "k2")), strict=True)):
        if key in own and key not in seen:
            first[i] = True
            seen.add(key)
    return (left["src"][0].as_py() if left.num_rows else right["src"][0].as_py()), first, np.array([x is not None and (x, a, b) in own for x, a, b in zip(*(left[c].to_pylist() for c in ("id", "k1", "k2")), strict=True)], bool)


def _numbers(first: pa.Table) -> np.ndarray:
    """A number within the group for each first text, the same in every step."""
    order = np.lexsort((numbers_of(first["k1"]), numbers_of(first["id"])))
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


OCCURS = np.dtype([("id", "<i8"), ("number", "<i4"), ("at", "<i4")])
ANCHORS = "anchor long, src int, n int"


def anchors_of(spec: Windows) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        src, first, _ = _group(left, right)
        part = left.filter(first)
        ids = numbers_of(part["id"])
        doc, _, _, key = runs(spec, *tokens(spec, *bytes_of(part["text"])))
        who = ids[doc] if len(doc) else doc
        order = np.lexsort((who, key))
        key, who = key[order], who[order]
        new_key = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
        new = new_key | np.r_[True, who[1:] != who[:-1]] if len(key) else new_key
        at = np.flatnonzero(new_key)
        n = np.add.reduceat(new.astype(np.int32), at) if len(at) else np.empty(0, np.int32)
        return pa.table({"anchor": key[at].view(np.int64), "src": np.full(len(at), src, np.int32), "n": n.astype(np.int32)})

    return f


SHARED = "src int, anchor long, hot boolean"


def shared(hot: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(numbers_of(b["anchor"]), numbers_of(b["src"], np.int32), numbers_of(b["n"], np.int32)) for b in batches if b.num_rows]
        if not got:
            return
        key, src, n = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(key, kind="stable")
        key, src, n = key[order], src[order], n[order]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        total = np.repeat(np.add.reduceat(n.astype(np.int64), at), np.diff(np.append(at, len(key))))
        ok = total > 1
        key, src, total = key[ok], src[ok], total[ok]
        for i in range(0, len(key), 100_000):
            s = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(src[s]), pa.array(key[s]), pa.array(total[s] > hot)], ["src", "anchor", "hot"])

    return f


STRETCHES = "part long, src int, stretch binary, occurs binary"


def stretches_of(spec: Windows) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        src, first, _ = _group(left, right)
        part = left.filter(first)
        told = right.filter(right["kind"].to_numpy() == 1)
        known = numbers_of(told["x"]).view(U)
        hot = numbers_of(told["y"]) > 0
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        ids = numbers_of(part["id"])
        texts = _numbers(part)
        tok, off = tokens(spec, *bytes_of(part["text"]))
        doc, at, count, key = runs(spec, tok, off)
        found: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        if len(known) and len(key):
            place = np.minimum(np.searchsorted(known, key), len(known) - 1)
            ok = known[place] == key
            doc, at, count, key, hot = doc[ok], at[ok], count[ok], key[ok], hot[place[ok]]
            raw, size, w = tok.tobytes(), tok.itemsize, spec.window
            for d, x, o, i, c, k, h in zip(*(v.tolist() for v in (ids[doc], texts[doc], off[doc], at, count, key.view(np.int64), hot)), strict=True):
                if not h:
                    found.setdefault((k, raw[i * size : (i + c - 1 + w) * size]), []).append((d, x, i - o))
                    continue
                for j in range(i, i + c):
                    one = raw[j * size : (j + w) * size]
                    found.setdefault((xxhash.xxh64_intdigest(one) - 2**63, one), []).append((d, x, j - o))
        occurs = [np.array(v, OCCURS).tobytes() for v in found.values()]
        keys = list(found)
        return pa.table({"part": pa.array([k for k, _ in keys], pa.int64()), "src": pa.array(np.full(len(keys), src, np.int32)), "stretch": pa.array([s for _, s in keys], pa.binary()), "occurs": pa.array(occurs, pa.binary())})

    return f


SPANS = "src int, number int, start long, stop long"
Kernel = Callable[[Windows, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def match(spec: Windows, kernel: Kernel, tile: int = 1 << 18) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans of each document covered by windows that an earlier document has.

    `kernel` gets a block's tokens, its stretches' offsets and each stretch's smallest document, and says of each position
    whether the window there also starts in a stretch of a smaller document. Documents that have a stretch besides the smallest have it all from an earlier one.
    """
    dtype = np.uint8 if spec.unit == "bytes" else U
    width = np.dtype(dtype).itemsize

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), schema=pa.schema([("part", pa.int64()), ("src", pa.int32()), ("stretch", pa.binary()), ("occurs", pa.binary())]))
        if not t.num_rows:
            return
        part = numbers_of(t["part"])
        order = np.argsort(part, kind="stable")
        part = part[order]
        t = t.take(pa.array(order))
        src, text, occurs = numbers_of(t["src"], np.int32), t["stretch"].to_pylist(), t["occurs"].to_pylist()
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist() + [len(part)]
        i = 0
        while i < len(cut) - 1:
            lo, size, j = cut[i], 0, i
            while j < len(cut) - 1 and (j == i or size < tile):
                size += sum(map(len, text[cut[j] : cut[j + 1]])) // width
                j += 1
            hi, i = cut[j], j
            # equal stretches of several groups are indexed once, for the smallest document
            index: dict[bytes, int] = {}
            which = np.array([index.setdefault(x, len(index)) for x in text[lo:hi]], np.int64)
            o = np.frombuffer(b"".join(occurs[lo:hi]), OCCURS)
            row = np.repeat(np.arange(hi - lo), [len(x) // OCCURS.itemsize for x in occurs[lo:hi]])
            st, group = which[row], src[lo:hi][row]
            least = np.full(len(index), np.iinfo(np.int64).max)
            np.minimum.at(least, st, o["id"])
            off = np.r_[0, np.cumsum([len(x) // width for x in index])]
            again = kernel(spec, np.frombuffer(b"".join(index), dtype), off, least)
            windows = np.diff(off) - spec.window + 1
            at = o["at"].astype(np.int64)
            whole = o["id"] > least[st]
            out = [(group[whole], o["number"][whole], at[whole], at[whole] + windows[st[whole]] - 1 + spec.window)]
            parts: list[tuple[int, int, int, int]] = []
            rest = np.flatnonzero(~whole & (np.add.reduceat(again, off[:-1], dtype=np.int64) > 0)[st])
            for k, g, x, i0 in zip(*(v[rest].tolist() for v in (st, group, o["number"], at)), strict=True):
                on = again[off[k] : off[k] + windows[k]]
                edge = np.flatnonzero(on[1:] != on[:-1]) + 1
                edge = [0, *edge.tolist(), len(on)]
                parts += [(g, x, i0 + s, i0 + e - 1 + spec.window) for s, e in zip(edge[:-1], edge[1:], strict=True) if on[s]]
            if parts:
                out.append(tuple(np.array(v) for v in zip(*parts, strict=True)))
            cols = [np.concatenate(v) for v in zip(*out, strict=True)]
            for s in range(0, len(cols[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 100_000], k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["src", "number", "start", "stop"])

    return f


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal runs; spans that touch are one run."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.r_[True, start[1:] > stop[:-1]]
    return start[new], stop[np.r_[np.flatnonzero(new)[1:] - 1, len(stop) - 1]]


def kept_of(spec: Windows, with_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_pylist([], pa.schema([("id", pa.int64()), ("row", left.schema.field("row").type), ("n", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]))
        _, first, known = _group(left, right)
        one = left.filter(first)
        number = dict(zip(zip(one["id"].to_pylist(), one["k1"].to_pylist(), strict=True), _numbers(one).tolist(), strict=True))
        spans = right.filter(right["kind"].to_numpy() == 2)
        by: dict[int, list[int]] = {}
        for i, d in enumerate(spans["id"].to_pylist()):
            by.setdefault(d, []).append(i)
        start, stop = numbers_of(spans["x"]), numbers_of(spans["y"])
        buf, off = bytes_of(left["text"])
        raw = buf.tobytes()
        out: list[tuple] = []
        for i, (d, x) in enumerate(zip(left["id"].to_pylist(), left["k1"].to_pylist(), strict=True)):
            whole, x = raw[off[i] : off[i + 1]], number.get((d, x))
            parts = whole.split() if spec.unit == "words" else whole
            n = len(parts)
            if d is None or n < spec.window or (known[i] and x not in by):
                a = b = np.empty(0, np.int64)
            elif not known[i]:
                a, b = np.array([0]), np.array([n])
            else:
                rows = np.array(by[x])
                a, b = merged(start[rows], stop[rows])
            gaps = zip(np.r_[0, b].tolist(), np.r_[a, n].tolist(), strict=True)
            if spec.unit == "words":
                kept = b" ".join(parts) if not len(a) else b" ".join(x for s, e in gaps for x in parts[s:e])
            else:
                kept = whole if not len(a) else b"".join(whole[s:e] for s, e in gaps)
            gone = int((b - a).sum())
            out.append((n, gone, len(a), hashlib.sha256(kept).hexdigest(), (whole if not gone else kept).decode("utf-8", "replace") if with_text else None))
        n, gone, count, sha, kept = zip(*out, strict=True)
        return pa.table({"id": left["id"], "row": left["row"], "n": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.string())})

    return f


def remove_repeats(docs: DataFrame, spec: Windows, kernel: Kernel, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    """One row per document: `row` (its other columns), `id`, `n` tokens, `n_removed`, `n_spans`, `kept_sha256`, `kept`."""
    p = partitions(docs.sparkSession)
    groups = 4 * p
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k1, k2 = text_key(text)
    ident = F.col(id_col).cast("long")
    deal = F.pmod(F.when(ident.isNull(), F.hash(k1)).otherwise(F.hash(ident)), F.lit(groups))
    rest = F.struct(F.col(id_col).isNull().alias("__null_id"), F.col(text_col).isNull().alias("__null_text"), *[F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)])
    base = docs.select(deal.alias("src"), ident.alias("id"), k1.alias("k1"), k2.alias("k2"), rest.alias("row"), text.alias("text"))
    reps = docs.where(ident.isNotNull()).select(ident.alias("id"), k1.alias("k1"), k2.alias("k2")).groupBy("k1", "k2").agg(F.min("id").alias("id"))
    none = F.lit(None)
    said = reps.select(F.pmod(F.hash("id"), F.lit(groups)).alias("src"), F.lit(0).alias("kind"), "id", F.col("k1").alias("x"), F.col("k2").alias("y"))

    def cogrouped(right: DataFrame, f, schema) -> DataFrame:
        return base.groupBy("src").cogroup(right.groupBy("src")).applyInArrow(lean(f), schema)

    found = cogrouped(said, anchors_of(spec), ANCHORS).repartition(p, "anchor").mapInArrow(lean(shared(spec.hot)), SHARED)
    told = said.unionByName(found.select("src", F.lit(1).alias("kind"), none.cast("long").alias("id"), F.col("anchor").alias("x"), F.col("hot").cast("long").alias("y")))
    spans = cogrouped(told, stretches_of(spec), STRETCHES).repartition(p, "part").mapInArrow(lean(match(spec, kernel)), SPANS)
    back = said.unionByName(spans.select("src", F.lit(2).alias("kind"), F.col("number").cast("long").alias("id"), F.col("start").alias("x"), F.col("stop").alias("y")))
    row_type = base.schema["row"].dataType
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("row", row_type), *[T.StructField(c, T.LongType()) for c in ("n", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())])
    return cogrouped(back, kept_of(spec, with_text), schema)
