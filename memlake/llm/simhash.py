"""SimHash near-dedup with pivot distance tables.

A fingerprint has a bit set where over half of the shingles' hashes have it. Equal
fingerprints are one class. For classes, candidates come from blocks: of six blocks of
the 64 bits, three differing bits leave three blocks alone, so two linked fingerprints
meet under one of twenty keys of three blocks. Each key's candidates carry a table of Hamming
distances to reference fingerprints, the pivots; by the triangle inequality a pair whose
distances to any pivot differ by more than the limit can't be linked and is discarded,
and the survivors' own distance is taken. Pivots alone would leave every pair of
the corpus to compare, as distances of unrelated fingerprints to a pivot differ by under
four bits in almost half of the cases; hence the blocks before them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import checkpointed, connected_components, local_roots, numbers_of, partitions, table

U = np.uint64
BLOCKS = (11, 11, 11, 11, 10, 10)
PIVOTS = np.random.Generator(np.random.PCG64(10)).integers(0, 2**64, 16, dtype=np.uint64)
LARGE = 2048  # candidates under one key that are compared at once


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits, each set if it is set in over half of the shingles' XXH64 (seed 42)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(parts) <= words:
        return h(join(parts), 42)
    hashes = np.array([h(join(s), 42) for s in zip(*(parts[i:] for i in range(words)), strict=False)], U)
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        count += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(U)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b["text"].to_pylist()], U)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(fp.view(np.int64), pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(f, "id long, fp long")


def masks(most: int) -> list[int]:
    """Keys of len(BLOCKS) - most blocks each, as masks over the bits."""
    at = np.r_[0, np.cumsum(BLOCKS)].tolist()
    block = [((1 << n) - 1) << s for n, s in zip(BLOCKS, at, strict=False)]
    return [sum(c) for c in combinations(block, len(BLOCKS) - most)]


def verified(fp: np.ndarray, i: np.ndarray, j: np.ndarray, most: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the candidate pairs i, j, those within `most` bits, by pivot distances first."""
    for p in pivots:
        d = np.bitwise_count(fp ^ p).astype(np.int8)
        ok = np.abs(d[i] - d[j]) <= most
        i, j = i[ok], j[ok]
        if not len(i):
            return i, j
    ok = np.bitwise_count(fp[i] ^ fp[j]) <= most
    return i[ok], j[ok]


def links_in(fp: np.ndarray, key: np.ndarray, most: int, mask: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of equal key, thinned so that they still join the same components.

    A large set under one key is dealt once more by its other bits: at `most` differing
    bits one of `most` + 1 pieces of them is equal. What is still large is compared in tiles.
    """
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    size = np.diff(np.append(first, len(k)))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def put(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal out, held
        out.append((order[i], order[j]))
        held += len(i)
        if held > 2_000_000:
            out, held = [star(len(fp), out)], 0

    small = size <= 64
    last = np.repeat(np.where(small, first + size, first), size)
    at = np.arange(len(k))
    f = fp[order]
    for d in range(1, int(size[small].max(initial=1))):
        i = at[at + d < last]
        if not len(i):
            break
        put(*verified(f, i, i + d, most, PIVOTS))
    for s, n in zip(first[~small].tolist(), size[~small].tolist(), strict=True):
        if n > LARGE and mask is not None:
            rest = [b for b in range(64) if not mask >> b & 1]
            for piece in np.array_split(np.array(rest), most + 1):
                bits = U(sum(1 << int(b) for b in piece))
                a, b = links_in(f[s : s + n], f[s : s + n] & bits, most, None)
                put(s + a, s + b)
            continue
        near = np.argsort(np.bitwise_count(f[s : s + n] ^ PIVOTS[0]), kind="stable") + s
        dist = np.bitwise_count(f[near] ^ PIVOTS[0]).astype(np.int64)
        for t in range(0, n, 256):
            end = int(np.searchsorted(dist, dist[min(n, t + 256) - 1] + most, side="right"))
            for v in range(t, end, 4096):
                i, j = (x.ravel() for x in np.meshgrid(np.arange(t, min(n, t + 256)), np.arange(v, min(end, v + 4096)), indexing="ij"))
                ok = i < j
                put(*verified(f, near[i[ok]], near[j[ok]], most, PIVOTS[1:3]))
    if not out:
        return at[:0], at[:0]
    return star(len(fp), out)


def star(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    root = local_roots(n, np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]))
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def near_pairs(classes: DataFrame, most: int) -> DataFrame:
    """Links a, b between distinct fingerprints within `most` bits, as many as join each component under each key."""
    keys = masks(most)
    p = partitions(classes.sparkSession)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(numbers_of(b["t"], np.int32), numbers_of(b["fp"]).view(U)) for b in batches if b.num_rows]
        if not got:
            return
        t, fp = (np.concatenate(x) for x in zip(*got, strict=True))
        for n, mask in enumerate(keys):
            own = fp[t == n]
            if len(own) > 1:
                a, b = links_in(own, own & U(mask), most, mask)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(own[a].view(np.int64)), pa.array(own[b].view(np.int64))], ["a", "b"])

    signed = [m - 2**64 if m >= 2**63 else m for m in keys]
    dealt = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("t", "key"))
    return dealt.repartition(p, "t", "key").select("t", "fp").mapInArrow(f, "a long, b long")


def simhash_components(docs: DataFrame, words: int = 3, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every document. Columns: id, fp (signed long), component_id.

    A-Z are lower-cased; words end at ASCII white space; shingles are `words` words joined
    by spaces, repeats included; a text of fewer words is one shingle; one without words,
    null or empty, has fingerprint zero and is linked like any other. component_id is the
    smallest id in the component, null if it has none but null ids. Repeated rows each get a row.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, words))
    classes = fps.groupBy("fp").agg(F.min("id").alias("first"))
    roots = connected_components(near_pairs(classes, most))
    named = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(named.join(least, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
