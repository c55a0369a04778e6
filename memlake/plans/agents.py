"""Queries over agents, trust and the shared pool."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import agents as op
from memlake.plans.domain import view, with_
from memlake.plans.registry import query

TRUST = with_("feedback") + """, o AS (SELECT src, dst, list(signal::DOUBLE ORDER BY ts, seq) AS f FROM feedback WHERE signal IS NOT NULL GROUP BY ALL),
t AS (SELECT src, dst, round(list_reduce(list_prepend(0.5::DOUBLE, f), lambda s, x: least(0.98::DOUBLE, greatest(0.05::DOUBLE, 0.8::DOUBLE * s + (1 - 0.8::DOUBLE) * x))), 9) AS trust, len(f)::INT AS interactions FROM o)"""


@query("trust_ema", f"{TRUST} SELECT * FROM t")
def trust_ema(spark, sf):
    return op.trust(view(spark, sf, "feedback"))


@query("trust_stable", f"{TRUST} SELECT src, dst, interactions >= 5 AS stable FROM t")
def trust_stable(spark, sf):
    return op.trust(view(spark, sf, "feedback")).select("src", "dst", (F.col("interactions") >= 5).alias("stable"))


@query("trust_top_sources", f"{TRUST} SELECT * FROM (SELECT src, dst, trust, row_number() OVER (PARTITION BY src ORDER BY trust DESC, dst) AS place FROM t) WHERE place <= 3")
def trust_top_sources(spark, sf):
    from memlake.operators.rank import ranked

    return ranked(op.trust(view(spark, sf, "feedback")).select("src", "dst", "trust"), ["src"], [F.desc("trust"), "dst"], 3)


# agents trust each other by what they bought: the mean share of two nations' trade
PAIRS = "t AS (SELECT c_nationkey AS src, s_nationkey AS dst, round(avg(l_discount) * 9, 6) AS trust FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"


@query(
    "transitive_trust",
    f"""WITH {PAIRS}, h AS (SELECT a.src, b.dst, max(a.trust * b.trust) AS hop FROM t a JOIN t b ON a.dst = b.src WHERE a.src <> b.dst AND a.dst <> b.dst AND a.dst <> a.src GROUP BY ALL)
SELECT coalesce(t.src, h.src) AS src, coalesce(t.dst, h.dst) AS dst, round(CASE WHEN hop IS NULL THEN coalesce(trust, 0.5) ELSE least(0.98, greatest(0.05, 0.7::DOUBLE * coalesce(trust, 0.5::DOUBLE) + 0.3::DOUBLE * hop)) END, 6) AS trust FROM t FULL JOIN h ON t.src = h.src AND t.dst = h.dst""",
)
def transitive_trust(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return op.transitive(j.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.round(F.avg("l_discount") * 9, 6).alias("trust")))


S = with_("summaries")
SCORE = "round(level * (1 + least(0.5::DOUBLE, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) / 100.0)), 6)"


@query("promotion", f"{S} SELECT id, agent_id, score FROM (SELECT *, {SCORE} AS score FROM summaries) WHERE level >= 2 AND NOT is_shared AND score >= 2.0")
def promotion(spark, sf):
    return op.promotable(view(spark, sf, "summaries")).select("id", "agent_id", "score")


POOL = "p AS (SELECT id AS entry_id, agent_id AS owner, content, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (id % 90) AS created_at, level, id % 7 AS access_count, id % 6 <> 0 AS is_active FROM summaries)"


def pool(spark, sf):
    s = view(spark, sf, "summaries")
    at = F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(cast(id % 90 as int))")
    return s.select(F.col("id").alias("entry_id"), F.col("agent_id").alias("owner"), "content", at.alias("created_at"), "level", (F.col("id") % 7).alias("access_count"), (F.col("id") % 6 != 0).alias("is_active"))


@query(
    "federated_retrieve",
    f"""{S}, {POOL}, q AS (SELECT n_nationkey AS query, concat('a', n_nationkey % 10) AS agent, n_name AS text FROM nation),
r AS (SELECT query, entry_id, round(least(1.0::DOUBLE, 0.2::DOUBLE + (entry_id % 50) / 100.0::DOUBLE) * 0.5::DOUBLE * pow(2::DOUBLE, -(epoch(TIMESTAMP '2024-06-01') - epoch(created_at)) / 86400.0::DOUBLE / 60.0::DOUBLE), 4) AS score FROM q JOIN p ON q.agent <> p.owner)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, entry_id) AS place FROM r) WHERE place <= 5""",
)
def federated_retrieve(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    q = n.select(F.col("n_nationkey").alias("query"), F.concat(F.lit("a"), F.col("n_nationkey") % 10).alias("agent"), F.col("n_name").alias("text"))
    t = spark.createDataFrame([], "src string, dst string, trust double")
    rel = 0.2 + (F.col("entry_id") % 50) / F.lit(100.0)
    return op.retrieve(pool(spark, sf), q, t, rel, F.lit("2024-06-01").cast("timestamp_ntz")).select("query", "entry_id", "score", "place")


@query("pool_decay", f"{S}, {POOL} SELECT entry_id, is_active AND NOT (created_at < TIMESTAMP '2024-02-15' AND access_count < 2) AS is_active FROM p")
def pool_decay(spark, sf):
    return op.decayed(pool(spark, sf), F.lit("2024-02-15").cast("timestamp_ntz")).select("entry_id", "is_active")


@query("pool_stats", f"{S}, {POOL} SELECT level, count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS retired, round(avg(access_count) FILTER (is_active), 6) AS avg_access FROM p GROUP BY 1")
def pool_stats(spark, sf):
    return op.pool_stats(pool(spark, sf))


@query("affinity", f"{with_('access')}, g AS (SELECT agent, source, count(*) AS reads, round(avg(relevance), 6) AS relevance, round(avg(feedback), 6) AS feedback FROM access GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY reads DESC, relevance DESC, source) AS place FROM g) WHERE place <= 5")
def affinity(spark, sf):
    return op.affinity(view(spark, sf, "access"))


@query("feedback_latest", f"{with_('access')} SELECT max(id) AS id, agent, source AS entry, 1.0::DOUBLE AS signal FROM access GROUP BY ALL")
def feedback_latest(spark, sf):
    log = view(spark, sf, "access").withColumnRenamed("source", "entry")
    fb = log.select("agent", "entry").distinct().withColumn("signal", F.lit(1.0))
    return op.latest_access(log, fb).select("id", "agent", "entry", "signal")


@query("fork_inherit", f"{S}, f AS (SELECT concat('a', n_nationkey % 10) AS parent, concat('child', n_nationkey) AS child FROM nation) SELECT id, child, level, md5('[INHERITED from ' || parent || '] ' || content) AS digest FROM summaries JOIN f ON agent_id = parent WHERE level >= 2")
def fork_inherit(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet")
    f = n.select(F.concat(F.lit("a"), F.col("n_nationkey") % 10).alias("parent"), F.concat(F.lit("child"), "n_nationkey").alias("child"))
    return op.fork_summaries(view(spark, sf, "summaries"), f).select("id", "child", "level", F.md5("content").alias("digest"))


def patterns(spark, sf, who: int):
    e = spark.read.parquet(f"{sf}/events.parquet").where(F.col("user_id") % 2 == who)
    g = e.groupBy(F.concat(F.lit("a"), F.col("user_id") % 2).alias("agent_id"), F.col("event_type").alias("trigger"), F.concat(F.lit("u"), F.col("user_id") % 20).alias("action"))
    return g.agg(F.count("*").alias("support"), F.round(F.least(F.lit(0.95), F.avg("value") / 60), 6).alias("confidence"))


PATTERNS = "pt AS (SELECT concat('a', user_id % 2) AS agent_id, event_type AS trigger, concat('u', user_id % 20) AS action, count(*) AS support, round(least(0.95::DOUBLE, avg(value) / 60), 6) AS confidence FROM events GROUP BY ALL)"


@query("fork_patterns", f"WITH {PATTERNS} SELECT concat('kid-', agent_id) AS child, trigger, action, round(confidence * 0.85::DOUBLE, 6) AS confidence, greatest(1, support // 2) AS support FROM pt WHERE confidence >= 0.7")
def fork_patterns(spark, sf):
    p = patterns(spark, sf, 0).unionByName(patterns(spark, sf, 1))
    f = spark.createDataFrame([("a0", "kid-a0"), ("a1", "kid-a1")], "parent string, child string")
    return op.fork_patterns(p, f)


@query(
    "pattern_merge",
    f"""WITH {PATTERNS}, s AS (SELECT trigger, concat('u', substr(action, 2)::INT // 2) AS action, max(confidence) AS sc, max(support) AS ss FROM pt WHERE agent_id = 'a0' AND confidence >= 0.75 GROUP BY ALL), t AS (SELECT trigger, concat('u', substr(action, 2)::INT // 2) AS action, max(confidence) AS tc, max(support) AS ts FROM pt WHERE agent_id = 'a1' GROUP BY ALL)
SELECT coalesce(s.trigger, t.trigger) AS trigger, coalesce(s.action, t.action) AS action, round(CASE WHEN tc IS NULL THEN sc * 0.9::DOUBLE WHEN sc > tc THEN sc ELSE tc END, 6) AS confidence, CASE WHEN tc IS NULL THEN ss WHEN sc > tc THEN ts + ss ELSE ts END AS support FROM s FULL JOIN t ON s.trigger = t.trigger AND s.action = t.action""",
)
def pattern_merge(spark, sf):
    half = F.concat(F.lit("u"), F.expr("cast(substring(action, 2) as int) div 2"))

    def side(who, least):
        p = patterns(spark, sf, who).where(F.col("confidence") >= least)
        return p.withColumn("action", half).groupBy("trigger", "action").agg(F.max("confidence").alias("confidence"), F.max("support").alias("support"))

    return op.merge_patterns(side(0, 0.75), side(1, 0.0))


@query("agent_counts", f"{with_('summaries', 'turns')} SELECT agent_id, coalesce(s, 0) AS summaries, coalesce(t, 0) AS turns FROM (SELECT DISTINCT agent_id FROM summaries) a LEFT JOIN (SELECT agent_id, count(*) AS s FROM summaries GROUP BY 1) b USING (agent_id) LEFT JOIN (SELECT agent_id, count(*) AS t FROM turns GROUP BY 1) c USING (agent_id)")
def agent_counts(spark, sf):
    s = view(spark, sf, "summaries")
    return op.agent_counts(s.select("agent_id").distinct(), summaries=s, turns=view(spark, sf, "turns"))
