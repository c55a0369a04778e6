"""Document fingerprints by I-Match with randomised lexicons.

The lexicon is the words of a band of inverse document frequency: not in more than
`common` of the documents, and in at least one of `PAIRS` of the corpus's pairs of a
document and a term (two documents at least). So no more than `PAIRS` words can be in it, and
it is sent everywhere. A randomised lexicon keeps each word of the band by a seeded hash:
half of them, an eighth, and so on, and for each size there are `SEEDS`. A document's
distinct terms of a lexicon, sorted, are hashed as a sequence. Its fingerprint has the
number of its terms in the band, the hash of all its terms, of those in the band, and of
those in each randomised lexicon.

A lexicon that keeps a share q of the words gives two documents equal hashes with
probability (1 - q)^d, d the number of terms that one has and the other has not. Large
lexicons so tell copies from near copies, small ones near copies from edited texts; d is
estimated as its mean over how likely each number makes the hashes that agree, within what the
numbers of terms a and b allow, and likeness is the share of both documents' terms that is left,
1 - d / (a + b). Nothing depends on the document's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import bytes_of, columns_of, partitions, slices, table
from memlake.llm.toxicity import FOLD
from memlake.llm.windows import C1, U, mix, words

PAIRS = 1_000_000
SEEDS = 12
SIZES = (1, 3, 5, 7, 9, 11, 13)  # a lexicon keeps one word of 2^n
FIELDS = 3 + SEEDS * len(SIZES)
DIFFERENT = np.r_[0.0, 2.0 ** np.arange(0, 18, 0.25)]  # numbers of differing terms that are tried
RANGE = 8_000_000  # bytes of text in a range of ids, about


def terms(column) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct terms with their document's place, sorted by both, and the number of documents."""
    buf, off = bytes_of(column)
    code, _, _, first = words(FOLD[buf], off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    new = np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])] if len(code) else np.empty(0, bool)
    return code[new], doc[new], len(off) - 1


def lexicon(docs: DataFrame, text_col: str = "text", common: float = 0.2, pairs: int = PAIRS) -> np.ndarray:
    """Sorted hashes of the band's words, `pairs` at most by its lower edge; document frequencies are of all documents."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, n = [], b.num_rows
            for x in slices(b, "text"):
                got.append(np.unique(terms(x["text"])[0], return_counts=True))
            if not got:
                continue
            w, df = (np.concatenate(v) for v in zip(*got, strict=True))
            w, at = np.unique(w, return_inverse=True)
            df = np.bincount(at, df).astype(np.int64)
            # the count of documents travels as a word of its own, null
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[0, w.view(np.int64)], mask=np.r_[True, np.zeros(len(w), bool)]), pa.array(np.r_[n, df].astype(np.int64))], ["w", "n"])

    text = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = text.mapInArrow(f, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).persist()
    whole = df.agg(F.sum(F.when(F.col("w").isNull(), F.col("n"))).alias("docs"), F.sum(F.when(F.col("w").isNotNull(), F.col("n"))).alias("pairs")).first()
    edge = max(2, -(-(whole.pairs or 0) // pairs))
    band = columns_of(df.where(F.col("w").isNotNull() & F.col("n").between(edge, common * (whole.docs or 0))).select("w"))["w"]
    df.unpersist()
    return np.sort(band.astype(np.int64).view(U))


def _sequences(code: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """A 32-bit hash of each document's sequence of terms; `doc` ascends."""
    size = np.bincount(doc, minlength=n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros(n, U)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(mix(code * C1 + at.astype(U)), np.cumsum(size)[some] - size[some])
    return (mix(out + size.astype(U)) >> U(32)).astype(np.uint32)


def fingerprints(column, band: np.ndarray) -> np.ndarray:
    """A row of FIELDS numbers of 32 bits for each text."""
    code, doc, n = terms(column)
    out = np.zeros((n, FIELDS), np.uint32)
    out[:, 1] = _sequences(code, doc, n)
    inside = np.zeros(len(code), bool)
    if len(band):
        inside = band[np.minimum(np.searchsorted(band, code), len(band) - 1)] == code
    code, doc = code[inside], doc[inside]
    out[:, 0] = np.bincount(doc, minlength=n)
    out[:, 2] = _sequences(code, doc, n)
    for seed in range(SEEDS):
        some, of, draw = code, doc, mix(code + np.array([seed + 1], U) * C1)
        for k, size in enumerate(SIZES):
            kept = draw < U(1 << 64 - size)
            some, of, draw = some[kept], of[kept], draw[kept]
            out[:, 3 + seed * len(SIZES) + k] = _sequences(some, of, n)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of both texts' terms of the band that are common, 0 to 1; for two texts without such terms, whether all their terms are the same."""
    same = a[:, 3:] == b[:, 3:]
    hits = same.reshape(len(a), SEEDS, len(SIZES)).sum(axis=1)
    agree = np.log1p(-(2.0 ** -np.array(SIZES)))[:, None] * DIFFERENT  # log-probability of equal hashes
    other = np.log(np.maximum(-np.expm1(agree), 1e-300))
    likely = hits @ np.maximum(agree, -700.0) + (SEEDS - hits) @ other
    x, y = a[:, 0].astype(float), b[:, 0].astype(float)
    # sets of these sizes differ in so many terms at least, and in so many at most
    likely[(DIFFERENT < np.abs(x - y)[:, None] / 1.2) | (DIFFERENT > np.maximum(x + y, 1)[:, None] * 1.2)] = -np.inf
    weight = np.exp(likely - likely.max(axis=1, keepdims=True, where=np.isfinite(likely), initial=-1e300))
    d = (weight @ DIFFERENT) / np.maximum(weight.sum(axis=1), 1e-300)
    d = np.where(a[:, 2] == b[:, 2], 0.0, np.maximum(d, np.maximum(np.abs(x - y), 1.0)))
    return np.where(x + y > 0, np.clip(1 - d / np.maximum(x + y, 1), 0.0, 1.0), (a[:, 1] == b[:, 1]).astype(float))


def written(f: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in np.ascontiguousarray(f.astype(">u4"))]


def read(strings: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(strings)), ">u4").reshape(-1, FIELDS).astype(np.uint32)


def fingerprint(docs: DataFrame, band: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars and fingerprint of every document; null texts count as empty. `likeness(read(x), read(y))` compares them."""
    held = docs.sparkSession.sparkContext.broadcast(band)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, "text")):
            n = pa.array([len(t) for t in b["text"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b["id"], n, pa.array(written(fingerprints(b["text"], held.value)))], ["id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(f, "id long, n_chars long, fingerprint string")


def against_next(docs: DataFrame, band: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and both likenesses.

    The next document has the next smaller id; rows of one id follow each other by text,
    null ids come last, and after the last row comes the first. Texts are dealt by ranges of ids; the
    range's first row also goes to the range before it, so no step orders all rows at once.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    groups = max(4 * partitions(spark), int(size // RANGE))
    ids = docs.select(F.col(id_col).cast("long").alias("id")).where("id is not null")
    tops = ids.repartitionByRange(groups, "id").groupBy(F.spark_partition_id()).agg(F.max("id").alias("top")).collect()
    top = np.sort(np.array([r.top for r in tops], np.int64))  # one number per range
    held = spark.sparkContext.broadcast(band)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            out: list[tuple] = []
            for d, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                raw = z.compress(t.encode())
                g = int(np.searchsorted(top, d)) if d is not None else 0
                out.append((g, False, d, raw))
                if d is not None and top[g] == d:
                    out.append(((g + 1) % len(top), True, d, raw))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], ["range", "ahead", "id", "z"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def group(t: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        rows = [(d is None, -(d or 0), z.decompress(x).decode(), d, a) for d, x, a in zip(t["id"].to_pylist(), t["z"].to_pylist(), t["ahead"].to_pylist(), strict=True)]
        own = sorted((r for r in rows if not r[4]), key=lambda r: r[:3])
        after = min((r for r in rows if r[4]), key=lambda r: r[:3], default=None)
        after = own[0] if after is None else after
        text = [r[2] for r in own]
        follow = [*text[1:], after[2]]
        edited = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for a, b in zip(text, follow, strict=True)]
        f = fingerprints(pa.chunked_array([pa.array([*text, after[2]], pa.large_string())]), held.value)
        e = fingerprints(pa.chunked_array([pa.array(edited, pa.large_string())]), held.value)
        mine, nxt = f[:-1], f[1:]
        return pa.table({"doc_id": pa.array([r[3] for r in own], pa.int64()), "n_chars": pa.array([len(x) for x in text], pa.int64()), "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited], "fingerprint": written(mine), "edited_fingerprint": written(e), "near_edited": likeness(mine, e), "near_next": likeness(mine, nxt)})

    text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return text.mapInArrow(deal, "range int, ahead boolean, id long, z binary").groupBy("range").applyInArrow(group, schema)


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return against_next(docs, lexicon(docs))
