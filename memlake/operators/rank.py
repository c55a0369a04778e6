"""Ranking: TF-IDF, vectors, fusion, diversity, packing windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.blocks import top_matches
from memlake.operators.graph import cut

TERM = r"[\p{L}\p{N}_]{2,}"


def dot(a: Column, b: Column) -> Column:
    """Of unit vectors, the cosine; summed in doubles from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def terms_of(texts: DataFrame, by: str) -> DataFrame:
    t = texts.select(by, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({TERM})"), F.lit(1))).alias("term"))
    # the filter is that of the joins below: with it all of them read one shuffle
    return t.where("term is not null").groupBy(by, "term").agg(F.count("*").alias("tf"))


def vocabulary(tf: DataFrame, n: int, terms: int) -> DataFrame:
    """term, at (from 0), idf of the most frequent terms, ties by name; at most `terms` rows."""
    top = tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")).orderBy(F.desc("cf"), "term").limit(terms)
    at = F.row_number().over(Window.orderBy(F.desc("cf"), "term")) - 1
    return top.select("term", at.alias("at"), (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(tf: DataFrame, vocab: DataFrame, by: str) -> DataFrame:
    """By, at, v: of each text the numbers of its terms and 1 + ln tf times smoothed idf, at unit length."""
    w = tf.join(F.broadcast(vocab), "term").select(by, "at", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    w = w.groupBy(by).agg(F.collect_list(F.struct("at", "w")).alias("t"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.select(by, F.col("t.at").alias("at"), F.transform("t.w", lambda x: x / F.col("norm")).alias("v"))


def tfidf_topk(docs: DataFrame, queries: DataFrame, k: int, floor: float = 0.01, terms: int = 512) -> DataFrame:
    """The best documents of each query (query, text); query weights by the documents' vocabulary."""
    n, m = docs.count(), queries.count()
    tf = terms_of(docs, "id")
    vocab = vocabulary(tf, n, terms)
    found = top_matches(weights(tf, vocab, "id"), weights(terms_of(queries, "query"), vocab, "query"), k, n, m, terms, floor, newest=True)
    return ranked(found.withColumn("sim", F.round("sim", 6)), ["query"], [F.desc("sim"), F.desc("id")], k)


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int | None = None, name: str = "place") -> DataFrame:
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col(name) <= k)


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact nearest vectors of a stated set of queries; blocks of vectors meet blocks of queries."""
    q = queries.where("id is not null").select(F.col("id").alias("query"), "v")
    found = top_matches(vectors.where("id is not null").select("id", "v"), q, k, vectors.count(), queries.count(), other=True)
    return ranked(found.withColumn("sim", F.round("sim", 6)), ["query"], [F.desc("sim"), "id"], k)


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """Lists (query, list, id, place from 1) fused by reciprocal ranks."""
    return lists.groupBy("query", "id").agg(F.round(F.sum(1.0 / (k + F.col("place"))), 9).alias("score"))


def mmr(candidates: DataFrame, k: int, share: float = 0.5) -> DataFrame:
    """Greedy choice by relevance less likeness to what is chosen. candidates: query, id, sim, v.

    k rounds of one aggregation each; every round takes the best left of each query, ties by id.
    Rounds read candidates from a table: each round reads those before it twice, so else they'd be found 2^k times.
    """
    left, chosen = cut(candidates.select("query", "id", "sim", "v")).withColumn("near", F.lit(0.0)), None
    for i in range(k):
        score = F.round(share * F.col("sim") - (1 - share) * F.col("near"), 9)
        best = left.groupBy("query").agg(F.min(F.struct((-score).alias("s"), "id", "sim", "v")).alias("b")).select("query", F.col("b.id").alias("b_id"), F.col("b.v").alias("b_v"), (-F.col("b.s")).alias("score"))
        pick = best.select("query", F.col("b_id").alias("id"), F.lit(i + 1).alias("place"), "score")
        chosen = pick if chosen is None else chosen.unionByName(pick)
        near = dot(F.col("v"), F.col("b_v"))
        left = left.join(best, "query").where("id <> b_id").select("query", "id", "sim", "v", F.when(F.lit(i == 0), near).otherwise(F.greatest("near", near)).alias("near"))
    return chosen


def last_n(turns: DataFrame, n: int = 20) -> DataFrame:
    """The last turns of a session, told oldest first by their id."""
    return ranked(turns, ["session_id"], [F.desc("id")], n, "back")


def budget(rows: DataFrame, by: list[str], order: list[Column], cost: Column, limit: int, rule: str) -> DataFrame:
    """The prefix that a budget lets in. a: the first always; b: the row that crosses as well; c: what fits only."""
    w = Window.partitionBy(*by).orderBy(*order)
    df = rows.withColumns({"cum": F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)), "rn": F.row_number().over(w), "cost": cost})
    fits = {"a": (F.col("cum") <= limit) | (F.col("rn") == 1), "b": (F.col("cum") - F.col("cost") < limit) | (F.col("rn") == 1), "c": F.col("cum") <= limit}[rule]
    return df.where(fits)


def diverse(hits: DataFrame, k: int) -> DataFrame:
    """At most max(2, k // 6) of one session among the best k. hits: query, session_id, id, sim."""
    capped = ranked(hits, ["query", "session_id"], [F.desc("sim"), "id"], max(2, k // 6), "own").drop("own")
    return ranked(capped, ["query"], [F.desc("sim"), "id"], k)


def round_robin(hits: DataFrame, sessions: int = 12) -> DataFrame:
    """The best sessions by their best hit, one hit of each in turn."""
    best = hits.groupBy("query", "session_id").agg(F.max("sim").alias("top"))
    best = ranked(best, ["query"], [F.desc("top"), "session_id"], sessions, "s_rank").drop("top")
    own = ranked(hits, ["query", "session_id"], [F.desc("sim"), "id"], None, "own").join(best, ["query", "session_id"])
    return ranked(own, ["query"], ["own", "s_rank"])


def recency(turns: DataFrame, half_life: float = 20.0) -> DataFrame:
    """W4."""
    w = Window.partitionBy("session_id")
    at = F.row_number().over(w.orderBy("id"))
    return turns.withColumn("recency", F.pow(F.lit(2.0), -(F.count("*").over(w) - at) / half_life))


def minmax(x: Column, by: list[str]) -> Column:
    """A half where all are alike."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(hi - lo < 1e-10, 0.5).otherwise((x - lo) / F.nullif(hi - lo, F.lit(0.0)))
