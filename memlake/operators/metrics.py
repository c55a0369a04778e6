"""Evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retrieval(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Recall, precision, MRR and nDCG at k of every query. hits: query, id, place; gold: query, id. Queries without gold have zeros."""
    g = gold.select("query", "id").distinct().withColumn("rel", F.lit(1))
    n = g.groupBy("query").agg(F.count("*").alias("gold"))
    h = hits.join(g, ["query", "id"], "left").select("query", "place", F.coalesce("rel", F.lit(0)).alias("rel"))
    gain = F.col("rel") / F.log2(F.col("place") + 1)
    cols = []
    for k in ks:
        top = F.col("place") <= k
        cols += [F.sum(F.when(top, F.col("rel"))).alias(f"h{k}"), F.min(F.when(top & (F.col("rel") == 1), F.col("place"))).alias(f"f{k}"), F.sum(F.when(top, gain)).alias(f"d{k}")]
    out = h.groupBy("query").agg(*cols).join(n, "query", "left")
    sel = []
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        has = F.col("gold") > 0
        sel += [F.round(F.when(has, F.col(f"h{k}") / F.col("gold")).otherwise(0.0), 6).alias(f"recall_{k}"), F.round(F.when(has, F.col(f"h{k}") / k).otherwise(0.0), 6).alias(f"precision_{k}"), F.round(F.when(has, F.coalesce(1 / F.col(f"f{k}"), F.lit(0.0))).otherwise(0.0), 6).alias(f"mrr_{k}"), F.round(F.when(has, F.col(f"d{k}") / ideal).otherwise(0.0), 6).alias(f"ndcg_{k}")]
    return out.select("query", *sel)


def any_all(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Whether any and whether all of a query's gold is among the first k."""
    top = hits.where(F.col("place") <= k).select("query", "id").distinct().withColumn("hit", F.lit(True))
    out = gold.select("query", "id").distinct().join(top, ["query", "id"], "left").groupBy("query")
    return out.agg(F.max(F.coalesce("hit", F.lit(False))).alias("any_gold"), F.min(F.coalesce("hit", F.lit(False))).alias("all_gold"))


def runs(results: DataFrame) -> DataFrame:
    """Mean and sample deviation over runs; none for one run."""
    return results.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("spread"), F.count("*").alias("runs"))


def sweep(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Precision, recall and F1 at each of a few thresholds, a thousand at most: more are an error. scored: score, positive."""
    if len(thresholds.limit(1001).take(1001)) > 1000:
        raise ValueError("more than 1000 thresholds")
    t = scored.join(F.broadcast(thresholds), F.lit(True)).withColumn("said", F.col("score") >= F.col("threshold"))
    out = t.groupBy("threshold").agg(F.count_if(F.col("said") & F.col("positive")).alias("tp"), F.count_if(F.col("said") & ~F.col("positive")).alias("fp"), F.count_if(~F.col("said") & F.col("positive")).alias("fn"))
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return out.select("threshold", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def latency(times: DataFrame, by: str) -> DataFrame:
    """E7."""
    return times.groupBy(by).agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


def always_failed(runs_: DataFrame, runs: int) -> DataFrame:
    """Items that failed in every run. runs_: item, run, ok."""
    return runs_.groupBy("item").agg(F.count_if(~F.col("ok")).alias("failed")).where(F.col("failed") == runs).select("item")


def first_per_session(hits: DataFrame, n: int = 3) -> DataFrame:
    """A session's score is the mean of its best n hits."""
    w = Window.partitionBy("query", "session_id").orderBy(F.desc("sim"), "id")
    return hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).groupBy("query", "session_id").agg(F.round(F.avg("sim"), 9).alias("score"))
