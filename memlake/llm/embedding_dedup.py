"""Embedding near-dedup: sign hashing in several tables, exact cosines, components.

Equal vectors of a label are one class. Each table hashes a class by the signs of its
products with random hyperplanes; the bits grow with the logarithm of the classes, and the
tables with them so that a pair at the limit is missed with probability `miss`. Keys that
one class has alone are dropped before any vector moves. A key's classes are compared as
matrices; a key of many is cut into blocks, one task's work being a pair of blocks. A pair
that several tables bring together counts in the first of them only. Links are summed and
thinned to stars where they are found, so no step writes all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import checkpointed, connected_components, local_roots, numbers_of, partitions, table


def sizes(n: int, limit: float, miss: float) -> tuple[int, int]:
    """Bits of a table, and tables, for n classes."""
    same = 1 - math.acos(limit) / math.pi
    bits = min(30, max(8, math.ceil(math.log2(max(n, 2))) + 1))
    return bits, math.ceil(math.log(miss) / math.log(1 - same**bits))


def planes(dim: int, count: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([1, dim])).standard_normal((dim, count))


def usable(vector: Column, label: Column, ident: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(ident.isNotNull() & label.isNotNull() & vector.isNotNull() & ~bad & some, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.asarray(x, float) for x in column.to_pylist()]


def hashed(bits: int, tables: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = matrix(b["v"])
            codes: list[list[int]] = [[] for _ in rows]
            dims = np.array([len(r) for r in rows])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                on = np.stack([rows[i] for i in at]) @ planes(int(d), bits * tables) > 0
                code = on.reshape(len(at), tables, bits) @ (1 << np.arange(bits))
                for i, c in zip(at.tolist(), code.tolist(), strict=True):
                    codes[i] = c
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("node", "label", "n", "v")), pa.array(codes, pa.list_(pa.int64()))], ["node", "label", "n", "v", "codes"])

    return f


def linked(limit: float, t: int, block: np.ndarray, pair: tuple[int, int], node: np.ndarray, n: np.ndarray, rows: list[np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors linked to each row within one key or pair of blocks, and the row that each is joined with."""
    links, root = np.zeros(len(node), np.int64), np.arange(len(node))
    dims = np.array([len(r) for r in rows])
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        if len(at) < 2:
            continue
        x = np.stack([rows[i] for i in at])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        unit = x / norm[:, None]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for s in range(0, len(at), 1024):
            i, j = np.nonzero(unit[s : s + 1024] @ unit.T >= limit - 1e-9)
            i += s
            ok = i < j
            if pair[0] != pair[1]:
                ok &= block[at[i]] != block[at[j]]
            i, j = i[ok], j[ok]
            for c in range(0, len(i), 200_000):
                a, b = i[c : c + 200_000], j[c : c + 200_000]
                ok = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= limit
                if t:
                    ok &= (codes[at[a], :t] != codes[at[b], :t]).all(axis=1)
                a, b = at[a[ok]], at[b[ok]]
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                found.append((a, b))
        if found:
            own = local_roots(len(node), np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
            root = np.minimum(root, own)
    return links, root


def compared(limit: float):
    """Over rows sorted by key: (node, other, links). `other` is joined with node; holds one key's rows at a time."""
    names = ("label", "t", "code", "bi", "bj")

    def group(tb: pa.Table) -> pa.RecordBatch | None:
        node, n = numbers_of(tb["node"]), numbers_of(tb["n"])
        key = tb.slice(0, 1).to_pylist()[0]
        codes = np.array(tb["codes"].to_pylist(), np.int64)
        links, root = linked(limit, key["t"], numbers_of(tb["block"]), (key["bi"], key["bj"]), node, n, matrix(tb["v"]), codes)
        on = links > 0
        return pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(node[root[on]]), pa.array(links[on])], ["node", "other", "links"]) if on.any() else None

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            keys = [numbers_of(held[c]) for c in names]
            cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1 if held.num_rows else []
            s = 0
            for e in list(cut):
                if e - s > 1 and (out := group(held.slice(s, e - s))) is not None:
                    yield out
                s = e
            held = held.slice(s).combine_chunks()
        if held is not None and held.num_rows > 1 and (out := group(held)) is not None:
            yield out

    return f


def embedding_dedup(vectors: DataFrame, limit: float = 0.98, miss: float = 0.001, block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links and components of vectors with cosine of at least `limit` under equal labels.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows whose
    label or id is null, link with nothing; nor do vectors of different lengths. Cosines
    are of doubles; no link is below the limit, and one at it is missed with probability
    `miss`, less above it. Repeated rows are vectors of their own.
    Columns: vec_id, n_links, component_id (smallest id reachable), kept (the two are equal).
    """
    p = partitions(vectors.sparkSession)
    ident, v, label = F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"), F.col(label_col).cast("long")
    rows = vectors.select(ident.alias("id"), v.alias("v"), label.alias("label"), usable(v, label, ident).alias("ok"))
    keys = [F.when(F.col("ok"), h) for h in (F.xxhash64("label", "v"), F.xxhash64(F.lit(7), F.col("label"), F.col("v")))]
    rows = rows.withColumns({"k1": keys[0], "k2": keys[1]})
    classes = checkpointed(rows.where("ok").groupBy("k1", "k2").agg(F.min("id").alias("node"), F.first("label").alias("label"), F.count("*").alias("n"), F.first("v").alias("v")))
    bits, tables = sizes(classes.count(), limit, miss)
    coded = checkpointed(classes.select("node", "label", "n", "v").mapInArrow(hashed(bits, tables), "node long, label long, n long, v array<double>, codes array<long>"))
    key = coded.select("node", "label", F.posexplode("codes").alias("t", "code"))
    full = key.groupBy("label", "t", "code").agg(F.count("*").alias("members")).where("members > 1")
    live = key.join(full, ["label", "t", "code"]).join(coded.select("node", "n", "v", "codes"), "node")
    blocks = F.ceil(F.col("members") / F.lit(block)).cast("int")
    live = live.withColumn("blocks", blocks).withColumn("block", F.pmod(F.hash("node", "t"), F.col("blocks")))
    live = live.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    live = live.select("label", "t", "code", F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj"), "block", "node", "n", "v", "codes")
    order = ["label", "t", "code", "bi", "bj"]
    found = checkpointed(live.repartition(p, *order).sortWithinPartitions(*order).mapInArrow(compared(limit), "node long, other long, links long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found, "node", "other").withColumnRenamed("node", "member")
    named = classes.select("k1", "k2", "n", "node").join(links, "node", "left").join(roots, F.col("node") == F.col("member"), "left")
    named = named.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    out = rows.select("id", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
