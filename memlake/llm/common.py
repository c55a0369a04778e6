"""Shared pieces: reading tables, durable cuts of lineage, connected components."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: its owner sizes them to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of this machine where none is named and all runs here."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="memlake-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def rewritten(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder, for loops: unlike a checkpoint it has its real size, where estimates of joined checkpoints multiply with each round."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released() -> None:
    """Give the memory that allocators keep back to the system. A Python worker outlives its task, and what it keeps stays with its executor."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc's
        trim(0)


def lean(f: Callable) -> Callable:
    """A function over Arrow data, or a generator over its batches, that ends with `released`."""
    if inspect.isgeneratorfunction(f):

        @wraps(f)
        def g(*data):
            yield from f(*data)
            released()
    else:

        @wraps(f)
        def g(*data):
            out = f(*data)
            released()
            return out

    g.__signature__ = inspect.signature(f)  # Spark asks how many tables it takes
    return g


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit(7), text)]


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each of n nodes' component under the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root


def bytes_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and each value's offsets."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.large_binary())
    arr = arr.cast(pa.large_binary())
    _, offsets, data = arr.buffers()
    if offsets is None or not len(arr):
        return np.empty(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about `most` bytes of text each, at least one row, so that arrays over its bytes stay small."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def numbers_of(column: pa.ChunkedArray, dtype=np.int64) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def columns_of(df: DataFrame) -> dict[str, np.ndarray]:
    """A result of bounded size, without nulls, as arrays; it comes to the driver as Arrow, not as rows."""
    t = df.toArrow()
    return {c: t[c].to_numpy(zero_copy_only=False) for c in t.column_names}


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph by large-star and small-star rounds.

    Takes links between long ids; nulls and self links are ignored. Returns `node`,
    `root` (smallest id of the component) for every node but the roots themselves.
    Each round is one aggregation and one join per star; the link set never leaves the
    executors and is written to the shared folder, so a lost executor costs only the current round.
    """
    x, y = F.col(a), F.col(b)
    e = edges.where(x.isNotNull() & y.isNotNull() & (x != y))
    e = rewritten(e.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long"))).first()
        if seen == tuple(mark) or not mark[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(mark)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = rewritten(small.distinct())
