"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

Words are lower-cased runs of letters and digits. Each class has an interpolated
Kneser-Ney model of the bytes of a word, given up to seven before them and the word's
start: discounted counts of eight bytes over discounted continuation counts of seven, six
and five, over one backoff distribution of four bytes that both classes share and that is
counted over all documents. Spelling serves words that no training row has, and a rare
expression falls back to counts where both classes agree.

A word's evidence is its log-likelihood ratio, toxic over ordinary. Ratios within the
noise of the estimate (`BAND`, which only such words as are really likelier in toxic
texts exceed) count zero; the rest, summed and divided by the number of words, is a
document's one feature. The score is a logistic curve over it, fitted on training rows
by models of the other three quarters of the rows, both classes weighing alike; so 0.7
means that the text is 2.3 times as likely under toxic as under ordinary documents.

Labels are learned from at most `sample` training rows (by a hash of their id); the class
models keep every gram of these rows, and that is all that is sent to every executor, so
its size is bounded by the rows. Shared counts are gathered from every document by shuffle, and
only those under grams of the training rows are sent: elsewhere they cancel out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import bytes_of, checkpointed, columns_of, lean, numbers_of, released, slices, table
from memlake.llm.windows import U, words

ORDER = 8  # bytes of a gram; they fit one number
SHARED = 4  # bytes of the grams that both classes share
D = 0.95
BAND = 2.0
FOLDS = 4
KNOWN = 262_144  # words whose evidence a task keeps
EDGE = 32
FOLD = np.full(256, EDGE, np.uint8)
FOLD[128:] = np.arange(128, 256)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    FOLD[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    FOLD[_c] = _c + 32


def plain(text_col: str) -> Column:
    return F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def low(n: int) -> int:
    return (1 << 8 * n) - 1


@dataclass
class Vocabulary:
    """The distinct words of some texts."""

    code: np.ndarray  # hashes of the distinct words, sorted
    which: np.ndarray  # each word's place among the distinct ones
    first: np.ndarray  # each text's first word
    buf: np.ndarray  # the texts' bytes, folded
    start: np.ndarray  # where a distinct word stands in them
    size: np.ndarray

    def grams(self, some: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
        """Grams of the bytes, and of the ends, of `some` distinct words, and each gram's place in `some`."""
        if not len(some):
            return np.empty(0, U), np.empty(0, np.int64)
        start, size = self.start[some], self.size[some]
        word = np.repeat(np.arange(len(some)), size + 1)
        head = np.cumsum(size + 1) - size - 1
        into = np.arange(len(word)) - head[word]
        last = into == size[word]
        byte = self.buf[np.where(last, 0, start[word] + into)]
        byte[last] = EDGE
        gram = byte.astype(U)
        for k in range(1, order):
            back = into - k
            gram |= np.where(back >= 0, byte[np.maximum(head[word] + back, 0)], np.where(back == -1, EDGE, 0)).astype(U) << U(8 * k)
        return gram, word


def vocabulary(column) -> Vocabulary:
    buf, off = bytes_of(column)
    buf = FOLD[buf]
    code, start, end, first = words(buf, off)
    code, at, which = np.unique(code, return_index=True, return_inverse=True)
    return Vocabulary(code, which, first, buf, start[at], (end - start)[at])


@dataclass
class Spelled:
    """The distinct words of some texts, with all their grams."""

    which: np.ndarray  # each word's place among the distinct ones
    first: np.ndarray  # each text's first word
    gram: np.ndarray  # grams of the distinct words' bytes, and of their ends
    word: np.ndarray  # the distinct word of each gram


def spelled(column, order: int = ORDER) -> Spelled:
    v = vocabulary(column)
    return Spelled(v.which, v.first, *v.grams(np.arange(len(v.code)), order))


def find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


@dataclass
class Level:
    size: int  # bytes of a gram
    gram: np.ndarray
    ratio: np.ndarray  # log of the classes' probabilities' ratio
    context: np.ndarray
    back: np.ndarray  # log of the classes' backoff weights' ratio


def levels(gram: np.ndarray, count: np.ndarray, shared: np.ndarray, p: np.ndarray) -> list[Level]:
    """The models of both classes, longest grams first, from counts by class (2 rows) and shared probabilities of `shared` grams, all sorted."""
    steps = [(gram, count)]
    for n in range(ORDER - 1, SHARED, -1):
        key, inv = np.unique(steps[-1][0] & U(low(n)), return_inverse=True)
        steps.append((key, np.stack([np.bincount(inv[c > 0], minlength=len(key)).astype(np.float32) for c in steps[-1][1]])))
    out: list[Level] = []
    under, below = shared, np.stack([p, p])
    for n, (key, c) in zip(range(SHARED + 1, ORDER + 1), reversed(steps), strict=True):
        context, inv = np.unique(key >> U(8), return_inverse=True)
        total = np.stack([np.bincount(inv, x, len(context)) for x in c])
        kinds = np.stack([np.bincount(inv[x > 0], minlength=len(context)) for x in c])
        back = np.where(total > 0, D * kinds / np.maximum(total, 1), 1.0)
        at, ok = find(under, key & U(low(n - 1)))
        now = np.maximum(c - D, 0) / np.maximum(total, 1)[:, inv] + back[:, inv] * np.where(ok, below[:, at], 1e-9)
        out.append(Level(n, key, np.log(now[1] / now[0]).astype(np.float32), context, np.log(back[1] / back[0]).astype(np.float32)))
        under, below = key, now
    return out[::-1]


def ratios(model: list[Level], gram: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each gram's last byte, given the others."""
    out = np.zeros(len(gram))
    left = np.arange(len(gram))
    for level in model:
        g = gram[left] & U(low(level.size))
        at, ok = find(level.gram, g)
        out[left[ok]] += level.ratio[at[ok]]
        left, g = left[~ok], g[~ok]
        at, ok = find(level.context, g >> U(8))
        out[left[ok]] += level.back[at[ok]]
    return out


class Known:
    """The evidence of words that were met before: a word's is worked out once, not once a batch. Beyond `most` words it starts again."""

    def __init__(self, most: int = KNOWN):
        self.most, self.code, self.value = most, np.empty(0, U), np.empty(0)

    def of(self, model: list[Level], v: Vocabulary) -> np.ndarray:
        at, ok = find(self.code, v.code)
        value, new = np.empty(len(v.code)), np.flatnonzero(~ok)
        value[ok] = self.value[at[ok]]
        if len(new):
            gram, word = v.grams(new)
            value[new] = np.maximum(np.bincount(word, ratios(model, gram)) - BAND, 0.0)
            if len(self.code) + len(new) > self.most:
                self.code, self.value = v.code[: self.most], value[: self.most]
            else:
                into = np.searchsorted(self.code, v.code[new])
                self.code, self.value = np.insert(self.code, into, v.code[new]), np.insert(self.value, into, value[new])
        return value


def evidence(model: list[Level], texts, known: Known | None = None) -> np.ndarray:
    """The feature of each text; one without words has none."""
    v = vocabulary(texts)
    n = np.diff(v.first)
    out = np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        word = (known or Known()).of(model, v)
        out[full] = np.add.reduceat(word[v.which], v.first[:-1][full]) / n[full]
    return out


@dataclass
class Curve:
    floor: float
    slope: float
    start: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(x + self.floor) + self.start, -30, 30)))


def curve(x: np.ndarray, y: np.ndarray) -> Curve:
    """Logistic curve over the logarithm of the feature; both classes weigh half."""
    floor = max(float(x[y == 0].mean()), 1e-6)
    z = np.c_[np.log(x + floor), np.ones(len(x))]
    middle, spread = z[:, 0].mean(), z[:, 0].std() + 1e-9
    z[:, 0] = (z[:, 0] - middle) / spread
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    w, ridge = np.zeros(2), np.diag([1.0, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (share * (y - p)) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return Curve(floor, max(w[0], 0.0) / spread, w[1] - max(w[0], 0.0) * middle / spread)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> DataFrame:
    """id, toxic, fold, text of at most `sample` labelled rows that may be learned from."""
    ok = labels.select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").where(F.crc32(F.col("id").cast("string")) % 3 != 1)
    one = ok.groupBy("id").agg(F.max("toxic").alias("toxic"))
    some = one.orderBy(F.xxhash64("id"), "id").limit(sample)
    text = docs.select(F.col(id_col).cast("long").alias("id"), plain(text_col).alias("text"))
    return text.join(F.broadcast(some), "id").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int"))


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(key) and max(int(key.max()), int(n.max())) >> 32 == 0:  # both fit one number, which sorts faster than places do
        both = np.sort(key << U(32) | n.astype(U))
        key, n = both >> U(32), (both & U(low(4))).astype(np.int64)
    else:
        order = np.argsort(key)
        key, n = key[order], n[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of training rows by fold and class."""
    for b in (x for whole in batches for x in slices(whole, "text")):
        s = spelled(pa.chunked_array([b["text"]]))
        slot = np.repeat(numbers_of(b["fold"]) * 2 + numbers_of(b["toxic"]), np.diff(s.first))
        for k in range(2 * FOLDS):
            n = np.bincount(s.which[slot == k], minlength=int(s.word[-1]) + 1 if len(s.word) else 0)[s.word]
            g, n = _summed(s.gram[n > 0], n[n > 0])
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.full(len(g), k, np.int32)), pa.array(n.astype(np.int64))], ["gram", "slot", "n"])


def _corpus(batches: Iterator[pa.RecordBatch], flush: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Short grams of all documents; a task adds up what it has before it sends it."""

    def out(key, n):
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    key, total = np.empty(0, U), np.empty(0, np.int64)
    code, own = np.empty(0, U), np.empty(0, np.int64)  # words so far, sorted, and their numbers
    count, gram, word, more = np.empty(0, np.int64), [key], [own], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        return _summed(np.concatenate([key, *gram]), np.concatenate([total, count[np.concatenate(word)]]))

    for b in (x for whole in batches for x in slices(whole, "text")):
        v = vocabulary(pa.chunked_array([b["text"]]))
        n = np.bincount(v.which, minlength=len(v.code))
        at, ok = find(code, v.code)
        count[own[at[ok]]] += n[ok]
        new = np.flatnonzero(~ok)
        if not len(new):
            continue
        g, w = v.grams(new, SHARED)
        gram.append(g)
        word.append(w + len(count))
        into = np.searchsorted(code, v.code[new])
        code, own = np.insert(code, into, v.code[new]), np.insert(own, into, np.arange(len(new)) + len(count))
        count = np.r_[count, n[new]]
        more += len(g)
        if more > flush // 2:
            key, total = summed()
            if len(key) > flush:
                yield out(key, total)
                key, total = key[:0], total[:0]
            code, own, count, gram, word, more = code[:0], own[:0], count[:0], [key[:0]], [own[:0]], 0
    key, total = summed()
    if len(key):
        yield out(key, total)


def shared_shares(corpus: DataFrame, wanted: DataFrame) -> DataFrame:
    """Kneser-Ney probability of each `wanted` gram of SHARED bytes by the counts of `corpus`: gram, p."""
    steps = [corpus]
    for n in range(SHARED - 1, 0, -1):
        steps.append(steps[-1].groupBy(F.col("gram").bitwiseAND(low(n)).alias("gram")).agg(F.count("*").alias("n")))
    p = None
    for n, step in zip(range(1, SHARED + 1), reversed(steps), strict=True):
        step = step.withColumn("h", F.shiftright("gram", 8))
        context = step.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        step = step.join(context, "h").withColumn("under", F.col("gram").bitwiseAND(low(n - 1)))
        step = step.withColumn("p", F.lit(1 / 256)) if p is None else step.join(p.withColumnRenamed("gram", "under"), "under")
        if n == SHARED:
            step = step.join(wanted, "gram", "left_semi")
        p = step.select("gram", (F.greatest(F.col("n") - D, F.lit(0.0)) / F.col("total") + D * F.col("kinds") / F.col("total") * F.col("p")).alias("p"))
    return p


def _model_of(t: pa.Table) -> list[Level]:
    """The models from rows of one gram each: counts by class, or a shared probability."""
    gram, p = numbers_of(t["gram"]).view(U), t["p"].to_numpy()
    is_shared = ~np.isnan(p)
    shared, p = gram[is_shared], p[is_shared]
    at = np.flatnonzero(~is_shared)
    at = at[np.argsort(gram[at])]
    count = np.stack([numbers_of(t[c], np.int32)[at].astype(np.float32) for c in ("ordinary", "toxic")])
    order = np.argsort(shared)
    return levels(gram[at], count, shared[order], p[order])


def _by_class(counted: DataFrame, p: DataFrame, *by: str) -> DataFrame:
    """Rows for `_model_of`, for each value of `by`."""
    n = [F.sum(F.when(F.col("slot") % 2 == c, F.col("n")).otherwise(0)).cast("int").alias(name) for c, name in enumerate(("ordinary", "toxic"))]
    return counted.groupBy(*by, "gram").agg(*n).withColumn("p", F.lit(float("nan"))).unionByName(p)


@dataclass
class Classifier:
    model: list[Level] | None
    curve: Curve | None
    prior: float
    known: Known = field(default_factory=Known, compare=False, repr=False)

    def scores(self, texts) -> np.ndarray:
        """Scores of lower-cased texts without nulls."""
        return np.full(len(texts), self.prior) if self.model is None else self.curve(evidence(self.model, texts, self.known))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Learn from `labels` and `docs`; without rows of both classes that have words, every score is the share of toxic rows.

    Of several labels of one id the toxic one holds; null labels, and any but 0 and 1, are none. Other columns do nothing.
    """
    rows = checkpointed(training_rows(docs, labels, sample, id_col, text_col))
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    nothing = Classifier(None, None, n.get(1, 0) / max(1, sum(n.values())))
    if not n.get(0) or not n.get(1):
        return nothing
    counted = checkpointed(rows.select("fold", "toxic", "text").mapInArrow(lean(_counts), "gram long, slot int, n long").groupBy("gram", "slot").agg(F.sum("n").alias("n")))
    corpus = checkpointed(docs.select(plain(text_col).alias("text")).mapInArrow(lean(_corpus), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    wanted = counted.select(F.col("gram").bitwiseAND(low(SHARED)).alias("gram")).distinct()
    p = checkpointed(shared_shares(corpus, wanted).select("gram", F.lit(0).alias("ordinary"), F.lit(0).alias("toxic"), "p"))
    # a model for each fold, of the rows of the others
    folds = F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("fold")
    others = _by_class(counted.select("*", folds).where("shiftright(slot, 1) <> fold"), p.select("*", folds), "fold")

    def crossed(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return pa.table({"toxic": pa.array([], pa.int32()), "x": pa.array([], pa.float64())})
        model, known = _model_of(left), Known()
        got = [(b["toxic"], evidence(model, pa.chunked_array([b["text"]]), known)) for whole in right.to_batches() for b in slices(whole, "text")]
        return pa.table({"toxic": pa.chunked_array([t for t, _ in got]), "x": np.concatenate([x for _, x in got])})

    tried = columns_of(others.groupBy("fold").cogroup(rows.select("fold", "toxic", "text").groupBy("fold")).applyInArrow(lean(crossed), "toxic int, x double"))
    y = tried["toxic"].astype(float)
    if not (y == 0).any() or not (y == 1).any():
        return nothing
    order = np.lexsort((tried["x"], y))

    def whole(t: pa.Table) -> pa.Table:
        model = _model_of(t)
        part = [(x.size, kind, key, value) for x in model for kind, key, value in ((0, x.gram, x.ratio), (1, x.context, x.back))]
        return pa.table({
            "size": np.concatenate([np.full(len(k), s, np.int8) for s, _, k, _ in part]),
            "kind": np.concatenate([np.full(len(k), kind, np.int8) for _, kind, k, _ in part]),
            "key": np.concatenate([k.view(np.int64) for _, _, k, _ in part]),
            "value": np.concatenate([v for *_, v in part]),
        })

    built = checkpointed(_by_class(counted, p).withColumn("one", F.lit(0)).groupBy("one").applyInArrow(lean(whole), "size byte, kind byte, key long, value float"))
    model = []
    for s in range(ORDER, SHARED, -1):
        two = []
        for kind in (0, 1):
            t = columns_of(built.where((F.col("size") == s) & (F.col("kind") == kind)).select("key", "value"))
            at = np.argsort(t["key"].view(U))
            two += [t["key"].view(U)[at], t["value"][at]]
        model.append(Level(s, *two))
    return Classifier(model, curve(tried["x"][order], y[order]), nothing.prior)


def score(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1, higher: label 1 likelier) of every row, repeated rows and null ids too. A null or empty text has the score of no evidence; long texts are read whole."""
    held = docs.sparkSession.sparkContext.broadcast(classifier)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, "text")):
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(held.value.scores(pa.chunked_array([b["text"]])))], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), plain(text_col).alias("text")).mapInArrow(lean(f), "id long, score double")


def keep_civil(docs: DataFrame, labels: DataFrame, limit: float = 0.7, text_col: str = "text") -> DataFrame:
    """`docs` without those that score `limit` or more; all columns stay, whatever their names."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col=text_col))

    @F.arrow_udf("double")
    def s(text: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([text], ["text"])
        got = [held.value.scores(pa.chunked_array([b["text"]])) for b in slices(whole, "text")]
        released()
        return pa.array(np.concatenate(got) if got else np.empty(0))

    return docs.where(s(plain(text_col)) < limit)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
