"""Agents: trust, the shared pool, forks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import age_weight, promotion_score

ALPHA, LOW, HIGH, NEUTRAL = 0.80, 0.05, 0.98, 0.50


def clamp(x: Column) -> Column:
    return F.least(F.lit(HIGH), F.greatest(F.lit(LOW), x))


def trust(feedback: DataFrame) -> DataFrame:
    """A moving average of an ordered pair's feedback, clamped at each step. feedback: src, dst, ts, seq, signal."""
    one = feedback.where("signal is not null").groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "signal"))).alias("f"))
    ema = F.aggregate("f", F.lit(NEUTRAL), lambda s, x: clamp(ALPHA * s + (1 - ALPHA) * x["signal"]))
    return one.select("src", "dst", F.round(ema, 9).alias("trust"), F.size("f").alias("interactions"))


def transitive(trust_: DataFrame) -> DataFrame:
    """Direct and best one-hop trust of every pair that either has; unclamped without a path."""
    a, b = trust_.select("src", F.col("dst").alias("via"), F.col("trust").alias("t1")), trust_.select(F.col("src").alias("via"), "dst", F.col("trust").alias("t2"))
    hop = a.join(b, "via").where("src <> dst and via <> dst and via <> src").groupBy("src", "dst").agg(F.max(F.col("t1") * F.col("t2")).alias("hop"))
    out = trust_.select("src", "dst", F.col("trust").alias("direct")).join(hop, ["src", "dst"], "full")
    own = F.coalesce("direct", F.lit(NEUTRAL))
    return out.select("src", "dst", F.round(F.when(F.col("hop").isNull(), own).otherwise(clamp(0.7 * own + 0.3 * F.col("hop"))), 6).alias("trust"))


def promotable(summaries: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Abstractions of level two or more that aren't shared and score enough."""
    return summaries.withColumn("score", F.round(promotion_score(F.col("level"), F.col("content")), 6)).where((F.col("level") >= 2) & ~F.col("is_shared") & (F.col("score") >= threshold))


def retrieve(pool: DataFrame, queries: DataFrame, trust_: DataFrame, relevance: Column, as_of: Column, k: int = 5, least: float = 0.3) -> DataFrame:
    """T4: relevance by trust by age; the score is rounded before the sort, ties by entry.

    pool: entry_id, owner, content, created_at; queries: query, agent, text. An agent's own
    entries don't come back; unknown trust is neutral.
    """
    pairs = queries.join(pool, F.col("agent") != F.col("owner"))
    t = trust_.select(F.col("src").alias("agent"), F.col("dst").alias("owner"), "trust")
    df = pairs.join(t, ["agent", "owner"], "left").withColumn("trust", F.coalesce("trust", F.lit(NEUTRAL))).where(F.col("trust") >= least)
    rel = F.least(F.lit(1.0), F.greatest(F.lit(0.0), relevance))
    df = df.withColumn("score", F.round(rel * F.col("trust") * age_weight(F.col("created_at"), as_of), 4))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "entry_id")
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def decayed(pool: DataFrame, cutoff: Column, least: int = 2) -> DataFrame:
    """The pool with old entries that few asked for retired."""
    old = F.col("is_active") & (F.col("created_at") < cutoff) & (F.col("access_count") < least)
    return pool.withColumn("is_active", F.col("is_active") & ~old)


def pool_stats(pool: DataFrame) -> DataFrame:
    """A4, by level."""
    return pool.groupBy("level").agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("retired"), F.round(F.avg(F.when(F.col("is_active"), F.col("access_count"))), 6).alias("avg_access"))


def affinity(log: DataFrame, k: int = 5) -> DataFrame:
    """A5: an agent's sources by how often it read them, with mean relevance and mean feedback where given."""
    out = log.groupBy("agent", "source").agg(F.count("*").alias("reads"), F.round(F.avg("relevance"), 6).alias("relevance"), F.round(F.avg("feedback"), 6).alias("feedback"))
    w = Window.partitionBy("agent").orderBy(F.desc("reads"), F.desc("relevance"), "source")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def latest_access(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """Each feedback goes to the latest access of its entry by its agent. log: id, agent, entry; feedback: agent, entry, signal."""
    w = Window.partitionBy("agent", "entry").orderBy(F.desc("id"))
    last = log.withColumn("back", F.row_number().over(w)).where("back = 1").drop("back")
    return last.join(feedback, ["agent", "entry"])


def fork_summaries(summaries: DataFrame, forks: DataFrame) -> DataFrame:
    """A child gets copies of its parent's higher abstractions. summaries: id, agent_id, level, content; forks: parent, child."""
    up = summaries.where("level >= 2").join(forks, F.col("agent_id") == F.col("parent"))
    return up.select("id", "child", "level", F.concat(F.lit("[INHERITED from "), F.col("parent"), F.lit("] "), F.col("content")).alias("content"))


def fork_patterns(patterns: DataFrame, forks: DataFrame) -> DataFrame:
    """Patterns of confidence .7 or more, a little less sure and half as supported."""
    up = patterns.where("confidence >= 0.7").join(forks, F.col("agent_id") == F.col("parent"))
    return up.select("child", "trigger", "action", F.round(F.col("confidence") * 0.85, 6).alias("confidence"), F.greatest(F.lit(1), F.floor(F.col("support") / 2)).cast("long").alias("support"))


def merge_patterns(source: DataFrame, target: DataFrame, threshold: float = 0.75) -> DataFrame:
    """A known pattern keeps the higher confidence, and adds support only if the source's is higher; a new one comes in at nine tenths."""
    s = source.where(F.col("confidence") >= threshold).select("trigger", "action", F.col("confidence").alias("sc"), F.col("support").alias("ss"))
    t = target.select("trigger", "action", F.col("confidence").alias("tc"), F.col("support").alias("ts"))
    up = F.col("sc") > F.col("tc")
    return t.join(s, ["trigger", "action"], "full").select(
        "trigger", "action",
        F.round(F.when(F.col("tc").isNull(), F.col("sc") * 0.9).when(up, F.col("sc")).otherwise(F.col("tc")), 6).alias("confidence"),
        F.when(F.col("tc").isNull(), F.col("ss")).when(up, F.col("ts") + F.col("ss")).otherwise(F.col("ts")).cast("long").alias("support"),
    )


def agent_counts(agents: DataFrame, **tables: DataFrame) -> DataFrame:
    """Rows of each table by agent_id, zero where none."""
    out = agents.select("agent_id")
    for name, t in tables.items():
        out = out.join(t.groupBy("agent_id").agg(F.count("*").alias(name)), "agent_id", "left")
    return out.select("agent_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in tables])
