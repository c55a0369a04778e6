"""Best matches and links among many vectors, by products of blocks: no row is made for a pair that isn't wanted."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, QUERIES = 100_000, 4096  # of one task that looks for best matches
SIDE = 8192  # rows of one side of a task that looks for links
CHUNK = 1024  # rows multiplied at once
PLACES = 6
NONE = -np.iinfo(np.int64).max


def half_up(x: np.ndarray) -> np.ndarray:
    """Millionths, rounded as Spark's round does: by a double's shortest decimal form, halves away from zero."""
    y = x * 10.0**PLACES
    n = np.floor(y + 0.5)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-4):
        n[i] = float(Decimal(repr(float(x[i]))).scaleb(PLACES).quantize(Decimal(1), ROUND_HALF_UP))
    return n


def one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.Array):
        return column
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def width(v: pa.Array) -> int:
    return pc.max(pc.list_value_length(v)).as_py() or 0


def dense(v: pa.Array, at: pa.Array | None, size: int, absent: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as rows of a matrix, and their lengths; `absent` for one that is null or has nulls. With `at`, the numbers' columns."""
    size_of = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
    values = pc.list_flatten(v)
    row = np.repeat(np.arange(len(v)), size_of)
    if at is None:
        column = np.arange(len(values)) - np.repeat(np.cumsum(size_of) - size_of, size_of)
    else:
        column = pc.list_flatten(at).to_numpy(zero_copy_only=False)
    out = np.zeros((len(v), size))
    out[row, column] = values.to_numpy(zero_copy_only=False)
    size_of = np.full(len(v), size) if at is not None else size_of.astype(np.int64)
    size_of[pc.is_null(v).to_numpy(zero_copy_only=False)] = absent
    if values.null_count:
        size_of[row[pc.is_null(values).to_numpy(zero_copy_only=False)]] = absent
    return out, size_of


def summed(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of a and j of b, summed from left to right."""
    s = np.zeros(len(i))
    for c in range(a.shape[1]):
        s += a[i, c] * b[j, c]
    return s


def numbers(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), NONE).to_numpy(zero_copy_only=False)


class Best:
    """The best k rows of each of n queries so far: by sums of 6 places, then by ids."""

    def __init__(self, n: int, k: int, least: float, newest: bool):
        self.n, self.k, self.newest = n, k, newest
        self.least = np.full(n, least)  # a smaller sum can't count any more
        self.held: list[tuple[np.ndarray, ...]] = []
        self.new, self.full = 0, False

    def add(self, *found: np.ndarray) -> None:
        """found: query, millionths, row, id, sum."""
        self.held.append(found)
        self.new += len(found[0])
        if not self.full or self.new > max(2 * self.n * self.k, 1 << 16):
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        query, n, row, tie, value = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((-tie if self.newest else tie, -n, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], np.arange(self.n))[query[order]]
        last = order[place == self.k - 1]
        self.least[query[last]] = np.maximum(self.least[query[last]], (n[last] - 0.5) / 10.0**PLACES - 1e-9)
        order = order[place < self.k]
        self.held, self.new, self.full = [tuple(x[order] for x in (query, n, row, tie, value))], 0, True
        return self.held[0]


def best(rows: pa.Table, queries: pa.Table, k: int, size: int | None, floor: float | None, newest: bool, other: bool) -> pa.Table:
    """query, id, sum of the best k rows of each query. Undefined sums (a null, unlike lengths) come last, as nulls; NaN first."""
    columns = {c: one(rows[c]) for c in rows.column_names}
    asked, v = one(queries["query"]), one(queries["v"])
    sparse = size is not None
    size = size if sparse else max(width(v), width(columns["v"]))
    q, q_size = dense(v, one(queries["at"]) if sparse else None, size, -1)
    q_id, ids = numbers(asked), numbers(columns["id"])
    top = Best(len(q), k, -np.inf if floor is None else floor - 1e-6, newest)
    for lo in range(0, len(ids) if len(q) else 0, CHUNK):
        d, d_size = dense(columns["v"].slice(lo, CHUNK), columns["at"].slice(lo, CHUNK) if sparse else None, size, -2)
        s = q @ d.T
        if np.isnan(s.min()):
            s[np.isnan(s)] = np.inf
        if len(np.unique(np.concatenate([q_size, d_size]))) > 1:
            s[q_size[:, None] != d_size] = -np.inf
        if other:
            s[q_id[:, None] == ids[lo : lo + CHUNK]] = np.nan  # in no comparison
        if not top.full and s.shape[1] > k:
            kth = np.partition(np.where(np.isnan(s), -np.inf, s), -k, axis=1)[:, -k]
            top.least = np.maximum(top.least, kth - 2e-6)
        i, j = np.nonzero(s >= top.least[:, None])
        value = s[i, j]
        near = np.flatnonzero(np.isfinite(value))
        y = value[near] * 10.0**PLACES
        near = near[np.abs(y - np.floor(y) - 0.5) < 1e-4]
        value[near] = summed(q, d, i[near], j[near])
        n = value * 10.0**PLACES
        sure = np.isfinite(value)
        n[sure] = half_up(value[sure])
        if floor is not None:
            over = n / 10.0**PLACES > floor
            i, j, n, value = i[over], j[over], n[over], value[over]
        top.add(i, n, lo + j, ids[lo + j], value)
    if not top.held:
        i, row, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    else:
        i, _, row, _, value = top.settle()
    value = np.where(value == np.inf, np.nan, value)
    return pa.table({"query": asked.take(pa.array(i)), "id": columns["id"].take(pa.array(row)), "sim": pa.array(value, mask=value == -np.inf)})


def top_matches(rows: DataFrame, queries: DataFrame, k: int, n: int, m: int, size: int | None = None, floor: float | None = None, newest: bool = False, other: bool = False) -> DataFrame:
    """Of each query, rows among which its best k are: query, id, sim (the sum of products, not rounded).

    rows: id, v; queries: query, v; with `size` the columns of v's numbers in `at`. n and m are about
    how many they are. Blocks of rows meet blocks of queries, so a task holds one of each, and only
    the best of a block leave it. `other` leaves out the row whose id is the query.
    """
    r, c = max(1, -(-n // ROWS), min(16, -(-n // 1000))), max(1, -(-m // QUERIES))
    left = rows.withColumn("r", F.pmod(F.xxhash64("id"), F.lit(r))).withColumn("c", F.explode(F.expr(f"sequence(0L, {c - 1}L)")))
    right = queries.select(*(F.col(x).alias(x) for x in queries.columns))  # columns of its own, where both come from one table
    right = right.withColumn("c", F.pmod(F.xxhash64("query"), F.lit(c))).withColumn("r", F.explode(F.expr(f"sequence(0L, {r - 1}L)")))
    left, right = (x.repartition(r * c, "r", "c").groupBy("r", "c") for x in (left, right))

    def found(a: pa.Table, b: pa.Table) -> pa.Table:
        return best(a, b, k, size, floor, newest, other)

    kinds = dict(queries.dtypes)["query"], dict(rows.dtypes)["id"]
    return left.cogroup(right).applyInArrow(found, f"query {kinds[0]}, id {kinds[1]}, sim double")


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each one's component, when links a-b join the components of `root`."""
    a, b = root[a], root[b]
    while (odd := a != b).any():
        a, b = a[odd], b[odd]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
    return root


def close(v: np.ndarray, x: range, y: range, least: float, test: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i of range x and j of range y whose product passes the test, and the product; of one range only i < j."""
    for lo in range(x.start, x.stop, CHUNK):
        hi = min(lo + CHUNK, x.stop)
        start = lo if x == y else y.start
        s = v[lo:hi] @ v[start : y.stop].T
        i, j = np.nonzero(~(s < least - 1e-9))
        value, i, j = s[i, j], i + lo, j + start
        edge = np.abs(value - least) < 1e-9
        y6 = value * 10.0**PLACES
        edge |= np.abs(y6 - np.floor(y6) - 0.5) < 1e-4
        value[edge] = summed(v, v, i[edge], j[edge])
        kept = test(value) & (i < j)
        yield i[kept], j[kept], value[kept]


def sides(vectors: DataFrame, by: str) -> DataFrame:
    """Vectors in blocks of about SIDE rows of one `by` and one length, each sent to every block that it meets: key (k, size, lo, hi), own, id, v."""
    v = vectors.where(F.col(by).isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    v = v.select(F.col(by).alias("k"), F.size("v").alias("size"), "id", "v")
    blocks = v.groupBy("k").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("blocks"))
    v = v.join(blocks, "k").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    v = v.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    v = v.select("k", "size", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "id", "v")
    return v.repartition(int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k", "size", "lo", "hi")


def block(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, range, range]:
    """ids, vectors, and the rows of either side of a block, each in the order of ids."""
    t = pa.Table.from_batches(batches)
    ids, v = numbers(one(t["id"])), dense(one(t["v"]), None, width(one(t["v"])), -1)[0]
    own = one(t["own"]).to_numpy(zero_copy_only=False)
    order = np.lexsort((ids, own))
    lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
    n = int((own == lo).sum())
    return ids[order], v[order], range(n), range(n) if lo == hi else range(n, len(ids))


def close_pairs(vectors: DataFrame, by: str, least: float) -> DataFrame:
    """a, b, sim of the pairs of one `by` with a < b and a product of `least` or more. vectors: by, id, v."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v, x, y = block(batches)
        for i, j, value in close(v, x, y, least, lambda s: ~(s < least)):
            a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(z[a < b]) for z in (a, b, value)], ["a", "b", "sim"])

    return sides(vectors, by).groupBy("k", "size", "lo", "hi").applyInArrow(found, "a long, b long, sim double")


def close_forest(vectors: DataFrame, by: str, eps: float) -> DataFrame:
    """Links a, b with the same components as all pairs of one `by` whose product is within `eps` of 1: of each two blocks, every row with the first of its component."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v, x, y = block(batches)
        order = np.argsort(ids, kind="stable")
        at = np.empty_like(order)
        at[order] = np.arange(len(order))
        root = np.arange(len(ids))
        for i, j, _ in close(v, x, y, 1 - eps, lambda s: 1 - s <= eps):
            root = merged(root, at[i], at[j])
        ids = ids[order]
        odd = np.flatnonzero(ids[root] != ids)
        yield pa.RecordBatch.from_arrays([pa.array(ids[odd]), pa.array(ids[root[odd]])], ["a", "b"])

    return sides(vectors, by).groupBy("k", "size", "lo", "hi").applyInArrow(found, "a long, b long")
