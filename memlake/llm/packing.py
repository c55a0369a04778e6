"""Packing by cutting-stock column generation.

A document's tokens, with its end, are cut into whole sequences and a rest, and a rest
into a multiple of a grain and what is left below the grain: rests of a third to half a sequence
would otherwise leave a quarter of it empty. The pieces' lengths form a histogram, at most one
entry per length below the grain and per multiple of it, whatever the corpus' size. A linear program over patterns (how many rests of each length share a
sequence) is solved by column generation: a knapsack over the dual prices finds the next
pattern, by dynamic programming. Patterns are rounded down; what is left over is packed
first-fit decreasing, again as patterns. Documents of one length are ranked, and each
pattern takes the next ranks, so assigning is a join with the table of patterns, whose
size is bounded by the sequence's length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import checkpointed, lean, numbers_of, partitions, table

SPECIAL = "<|endoftext|>"
ROUNDS = 400  # of pricing; the program is then taken as it is

_encoder = None


def encoder(vocabulary: str):
    """ids of texts as the byte-level BPE file `vocabulary` (a name of public_tokenizers) has them; one per process.

    The file's ranks in tiktoken give the same ids several times faster; texts that hold
    the special token's string go through tokenizers itself.
    """
    global _encoder
    if _encoder is None or _encoder[0] != vocabulary:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = public_tokenizers.path(vocabulary)
        slow = cache(lambda: Tokenizer.from_file(path))  # some 30 MB, and few texts ask for it
        with open(public_tokenizers.path(vocabulary.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _encoder = (vocabulary, lambda t: slow().encode(t, add_special_tokens=False).ids if SPECIAL in t else fast.encode_ordinary(t))
    return _encoder[1]


def cuts(n: int, size: int, grain: int) -> list[int]:
    """Where pieces of n tokens start, and n."""
    whole = n - n % size
    out = list(range(0, whole, size))
    if n > whole:
        out.append(whole)
        if (n - whole) > grain and (n - whole) % grain:
            out.append(n - (n - whole) % grain)
    return [*out, n]


def pieces(docs: DataFrame, size: int, grain: int, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """Pieces of every document: id, row (a hash that tells rows of one id apart), start, length, ids_crc32, doc_tokens."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for b in batches:
            out: list[tuple] = []
            for d, h, t in zip(*(b[c].to_pylist() for c in ("id", "row", "text")), strict=True):
                ids = np.array([*encode(t), 0], "<u4")
                at = cuts(len(ids), size, grain)
                out += [(d, h, i, j - i, zlib.crc32(ids[i:j].tobytes()), len(ids)) for i, j in zip(at[:-1], at[1:], strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["id", "row", "start", "length", "ids_crc32", "doc_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("text")).mapInArrow(lean(f), "id long, row long, start long, length long, ids_crc32 long, doc_tokens long")


def knapsacks(price: np.ndarray, lengths: np.ndarray, size: int, most: int) -> tuple[list[np.ndarray], float]:
    """The most valuable patterns that hold each of up to `most` lengths, best first, and the best value; by dynamic programming over capacities."""
    best = np.zeros(size + 1)
    took = np.full(size + 1, -1)
    at = np.flatnonzero(price > 1e-12)
    own, value = lengths[at], price[at]
    upto = np.searchsorted(own, np.arange(size + 1), side="right").tolist()
    for c in range(1, size + 1):
        best[c] = best[c - 1]
        if n := upto[c]:
            v = best[c - own[:n]] + value[:n]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], took[c] = v[i], at[i]
    # the nearest capacity below at which something was taken
    down = np.maximum.accumulate(np.where(took >= 0, np.arange(size + 1), 0)).tolist()
    total = value + best[size - own]
    out = []
    for k in np.argsort(-total, kind="stable")[:most].tolist():
        if total[k] <= 1 + 1e-7:
            break
        pattern = np.zeros(len(lengths), np.int64)
        pattern[at[k]] += 1
        c = down[size - int(own[k])]
        while c > 0:
            pattern[took[c]] += 1
            c = down[c - int(lengths[took[c]])]
        out.append(pattern)
    return out, float(total.max(initial=0.0))


def first_fit(lengths: np.ndarray, left: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Patterns, and how often each, of first-fit decreasing over length classes; they hold all of `left`."""
    left, out = left.astype(np.int64).copy(), []
    while left.any():
        a, room = np.zeros_like(left), size
        for i in range(len(lengths) - 1, -1, -1):
            if lengths[i] <= room and left[i]:
                n = min(int(left[i]), room // int(lengths[i]))
                a[i], room = n, room - n * int(lengths[i])
        on = a > 0
        n = int((left[on] // a[on]).min())
        out.append((a, n))
        left -= n * a
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b without BLAS: its threads, which wait for each other by spinning, have stalled a Spark driver of few cores."""
    return np.einsum("...i,ij->...j" if b.ndim == 2 else "...i,i->...", a, b)


def inverse_of(a: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan elimination with row pivots, without threads."""
    n = len(a)
    w = np.c_[a.astype(float), np.eye(n)]
    for i in range(n):
        j = i + int(np.abs(w[i:, i]).argmax())
        if w[j, i] == 0:
            raise np.linalg.LinAlgError("Singular matrix")
        w[[i, j]] = w[[j, i]]
        w[i] /= w[i, i]
        on = np.flatnonzero(w[:, i])
        on = on[on != i]
        w[on] -= w[on, i][:, None] * w[i]
    return w[:, n:]


def column_generation(lengths: np.ndarray, demand: np.ndarray, size: int, rounds: int = ROUNDS, columns: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used in the linear program's optimum, by the revised simplex method.

    The program over the patterns so far, first-fit's to begin with, is solved; its prices
    then ask for up to `columns` new patterns. It ends at the optimum, or as soon as half a
    sequence or a ten-thousandth is left to the best lower bound: the tokens over the size, or
    the program's value over the best price. Demands are raised by random parts of a
    thousandth, so that few pivots are idle.
    """
    m = len(lengths)
    asked, demand = demand, demand * (1 + 1e-3 * np.random.Generator(np.random.PCG64(6)).random(m))
    # one length each to begin with; columns of -1 let a pattern hold less than it has room for
    pool = np.c_[np.diag(np.maximum(1, size // lengths)), -np.eye(m), np.array([a for a, _ in first_fit(lengths, asked, size)]).T].astype(float)
    cost = np.r_[np.ones(m), np.zeros(m), np.ones(pool.shape[1] - 2 * m)]
    basis = np.arange(m)
    least, pivots = float(lengths @ demand) / size, 0

    def solved() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inverse = inverse_of(pool[:, basis])
        return inverse, np.maximum(times(inverse, demand), 0), times(cost[basis], inverse)

    inverse, x, price = solved()
    for _ in range(rounds):
        for _ in range(40 * m):
            gain = times(price, pool) - cost
            j = int(gain.argmax())
            if gain[j] <= 1e-7:
                break
            d = times(inverse, pool[:, j])
            ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
            out = int(ratio.argmin())
            step = ratio[out]
            if not np.isfinite(step):
                break
            row = inverse[out] / d[out]
            inverse -= np.outer(d, row)
            inverse[out] = row
            price = price - gain[j] * row
            x = np.maximum(x - step * d, 0)
            x[out] = step
            basis[out] = j
            pivots += 1
            if pivots % 250 == 0:
                inverse, x, price = solved()
        found, top = knapsacks(price, lengths, size, columns)
        value = float((cost[basis] * x).sum())
        least = max(least, value / max(top, 1.0))
        if not found or value - least <= max(0.5, 1e-4 * value):
            break
        pool = np.c_[pool, np.array(found).T]
        cost = np.r_[cost, np.ones(len(found))]
    own = cost[basis] > 0
    x = np.maximum(times(inverse_of(pool[:, basis]), asked.astype(float)), 0)
    return pool[:, basis[own]].astype(np.int64), x[own]


def plan(lengths: np.ndarray, demand: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with their number of sequences; together they hold each length as often as `demand` says."""
    if not len(lengths):
        return []
    patterns, x = column_generation(lengths, demand, size)
    left, out = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable").tolist():
        a = patterns[:, j]
        on = a > 0
        n = min(int(x[j] + 1e-6), int((left[on] // a[on]).min()))
        if n > 0:
            out.append((a, n))
            left -= n * a
    # what rounding leaves
    return out + first_fit(lengths, left, size)


def pack(docs: DataFrame, size: int = 1024, grain: int = 256, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document, null texts as empty, into sequences of at most `size` tokens.

    Each document's ids end with id 0. Returns a row per piece: doc_id, start, length,
    ids_crc32 (of its ids as little-endian 32-bit), doc_tokens, sequence_id, offset. Pieces
    of one sequence follow each other from offset 0 without a gap. Repeated rows are packed
    as documents of their own. A whole piece is a sequence of its own, numbered after the
    packed ones.
    """
    spark = docs.sparkSession
    p = partitions(spark)
    cut = checkpointed(pieces(docs, size, grain, vocabulary, id_col, text_col))
    histogram = cut.where(F.col("length") < size).groupBy("length").count().orderBy("length").collect()  # fewer than `size` rows
    lengths = np.array([r[0] for r in histogram], np.int64)
    demand = np.array([r[1] for r in histogram], np.int64)
    rows, base = [], 0
    given = dict.fromkeys(lengths.tolist(), 0)
    for pattern, n in plan(lengths, demand, size):
        at = 0
        for i in np.flatnonzero(pattern).tolist():
            length, each = int(lengths[i]), int(pattern[i])
            rows.append((length, given[length], given[length] + n * each, each, base, at))
            given[length] += n * each
            at += length * each
        base += n
    # ranks among pieces of a length: dealt by hash, counted per length and part, then numbered within; so no length is ranked by one task
    dealt = cut.withColumn("part", F.when(F.col("length") < size, F.pmod(F.xxhash64("id", "row", "start"), F.lit(4 * p))).otherwise(F.pmod(F.xxhash64("id", "row", "start"), F.lit(4 * p)) + F.lit(4 * p)).cast("int"))
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "row", "start")) - 1)
    ranked = ranked.join(before.withColumnsRenamed({"length": "l2", "part": "p2"}), (F.col("length") == F.col("l2")) & (F.col("part") == F.col("p2"))).withColumn("rank", F.col("r") + F.col("before"))
    # the plan has at most a row per length and pattern, and patterns are bounded by the sequence's length
    steps = spark.createDataFrame(rows, "pl long, low long, high long, each long, base long, at long")
    rest = ranked.where(F.col("length") < size).join(F.broadcast(steps), (F.col("length") == F.col("pl")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    k = F.col("rank") - F.col("low")
    placed = rest.select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + (k % F.col("each")) * F.col("length")).cast("long").alias("offset"))
    whole = ranked.where(F.col("length") == size).select("id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(base) + F.col("rank")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole).withColumnRenamed("id", "doc_id")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
