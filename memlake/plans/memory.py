"""Queries over turns, patterns, profiles, costs and time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text as fx
from memlake.operators import memory as op
from memlake.operators import metrics, rank
from memlake.plans.domain import table, view, with_
from memlake.plans.registry import query

T = with_("turns")
IMPORTANCE = f"""{T}, nn AS (SELECT session_id, count(*) AS n FROM turns GROUP BY 1), tk AS (SELECT session_id, id, unnest(regexp_extract_all(lower(content), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1)) AS term FROM turns), tf AS (SELECT session_id, id, term, count(*) AS tf FROM tk GROUP BY ALL),
w AS (SELECT session_id, id, (1 + ln(tf)) * (ln((1 + n) / (1 + count(*) OVER (PARTITION BY session_id, term))::DOUBLE) + 1) AS w FROM tf JOIN nn USING (session_id)), r AS (SELECT session_id, id, sum(w) / sqrt(sum(w * w)) AS raw FROM w GROUP BY ALL),
o AS (SELECT t.session_id, t.id, n, coalesce(raw, 0) AS raw, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: regexp_matches(x, '^[A-Z][a-zA-Z]+')))::DOUBLE AS caps, pow(2::DOUBLE, -(n - row_number() OVER (PARTITION BY t.session_id ORDER BY t.id)) / 20.0::DOUBLE) AS rec FROM turns t LEFT JOIN r ON t.id = r.id JOIN nn ON t.session_id = nn.session_id),
z AS (SELECT *, min(raw) OVER s AS r0, max(raw) OVER s AS r1, min(caps) OVER s AS c0, max(caps) OVER s AS c1 FROM o WINDOW s AS (PARTITION BY session_id)),
sc AS (SELECT session_id, id, n, round(0.3::DOUBLE * CASE WHEN n < 2 OR r1 - r0 < 1e-10 THEN 0.5 ELSE (raw - r0) / (r1 - r0) END + 0.35::DOUBLE * 0.5::DOUBLE + 0.2::DOUBLE * CASE WHEN c1 - c0 < 1e-10 THEN 0.5 ELSE (caps - c0) / (c1 - c0) END + 0.15::DOUBLE * rec, 4) AS score FROM z)"""


@query("importance", f"{IMPORTANCE} SELECT session_id, id, round(score, 3) AS score FROM sc")
def importance(spark, sf):
    return op.importance(view(spark, sf, "turns")).select("session_id", "id", F.round("score", 3).alias("score"))


@query("compression_candidates", f"{IMPORTANCE} SELECT session_id, count(*) AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score, id) AS place FROM sc) WHERE place <= greatest(1, floor(0.3::DOUBLE * n)) GROUP BY 1")
def compression_candidates(spark, sf):
    out = op.compression_candidates(op.importance(view(spark, sf, "turns")))
    return out.groupBy("session_id").agg(F.count("*").alias("candidates"))


@query("session_token_totals", f"{T} SELECT session_id, sum(token_count)::BIGINT AS tokens, count(*) AS turns FROM turns GROUP BY 1 HAVING sum(token_count) > 0.70 * 500 AND count(*) >= 4")
def session_token_totals(spark, sf):
    return op.eligible(view(spark, sf, "turns"), 500)


@query("pattern_mining", f"""{T}, p AS (SELECT agent_id, role, content, lead(role) OVER w AS nr, lead(content) OVER w AS reply FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY id)), x AS (SELECT agent_id, content, reply FROM p WHERE role = 'user' AND nr = 'assistant'),
tr AS (SELECT agent_id, [{", ".join(f"{{'n': len(regexp_extract_all(lower(content), '{p}')), 'i': {-i}, 'k': '{k}'}}" for i, (k, p) in enumerate(fx.TRIGGERS))}] AS h, CASE {" ".join(f"WHEN regexp_matches(lower(reply), '{p}') THEN '{a}'" for p, a in fx.ACTIONS)} WHEN length(reply) > 500 THEN 'gave detailed response' ELSE 'responded' END AS action FROM x),
c AS (SELECT agent_id, CASE WHEN list_max(h).n > 0 THEN list_max(h).k ELSE 'general' END AS trigger, action FROM tr), t AS (SELECT agent_id, count(*) AS pairs FROM c GROUP BY 1)
SELECT agent_id, trigger, action, count(*) AS support, round(least(0.95::DOUBLE, count(*) / any_value(pairs)), 6) AS confidence, 'When ' || CASE trigger {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fx.TRIGGER_TEXT.items())} END || ' → ' || action AS pattern FROM c JOIN t USING (agent_id) GROUP BY agent_id, trigger, action HAVING count(*) >= 2""")
def pattern_mining(spark, sf):
    return op.mine_patterns(view(spark, sf, "turns"), "agent_id")


A = with_("attributes") + """, v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope_key, attribute_key ORDER BY mention_count DESC, "at" DESC, fact_id DESC) AS value_place FROM attributes) WHERE value_place <= 6), b AS (SELECT scope_key, attribute_key, max(mention_count) AS m, max("at") AS t FROM v GROUP BY ALL), k AS (SELECT scope_key, attribute_key, row_number() OVER (PARTITION BY scope_key ORDER BY m DESC, t DESC, attribute_key DESC) AS key_place FROM b)"""


@query("profile_current", f"{A} SELECT scope_key, attribute_key, value_text, value_place, key_place FROM v JOIN k USING (scope_key, attribute_key) WHERE key_place <= 40")
def profile_current(spark, sf):
    return op.profile(view(spark, sf, "attributes")).select("scope_key", "attribute_key", "value_text", "value_place", "key_place")


@query("profile_render", f"{A}, l AS (SELECT scope_key, key_place, attribute_key || ': ' || string_agg(value_text, '; ' ORDER BY value_place) AS line FROM v JOIN k USING (scope_key, attribute_key) GROUP BY scope_key, key_place, attribute_key) SELECT scope_key, string_agg(line, chr(10) ORDER BY key_place) AS profile FROM l GROUP BY 1")
def profile_render(spark, sf):
    return op.render_profile(op.profile(view(spark, sf, "attributes")))


@query("attribute_vocabulary", f"{with_('attributes')} SELECT attribute_key, count(*) AS n FROM attributes GROUP BY 1 ORDER BY n DESC, attribute_key LIMIT 60")
def attribute_vocabulary(spark, sf):
    return view(spark, sf, "attributes").groupBy("attribute_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "attribute_key").limit(60)


@query("cost_report", f"{with_('cost_log')}, g AS (SELECT session_id, sum(cost) AS cost, sum(input) AS input, sum(output)::BIGINT AS output FROM cost_log GROUP BY 1) SELECT session_id, round(cost, 6) AS cost, input, output, round(input * 5e-6::DOUBLE + output * 15e-6::DOUBLE, 6) AS baseline, round(input * 5e-6::DOUBLE + output * 15e-6::DOUBLE - cost, 6) AS saved FROM g")
def cost_report(spark, sf):
    return op.cost_report(view(spark, sf, "cost_log"))


@query("forget_topic", f"{T} SELECT id, NOT (role = 'user' AND len(list_intersect(regexp_extract_all(lower(content), '[a-z]{{4,}}'), ['about', 'things', 'that'])) > 0) AS is_active FROM turns")
def forget_topic(spark, sf):
    return op.forget(view(spark, sf, "turns"), "About things that").select("id", "is_active")


@query("conflict_candidates", f"{T}, u AS (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS rn FROM turns WHERE role = 'user') SELECT a.id, b.id AS old_id FROM u a JOIN u b ON a.session_id = b.session_id AND b.rn < a.rn AND a.rn - b.rn <= 40")
def conflict_candidates(spark, sf):
    return op.lookback_pairs(view(spark, sf, "turns")).select("id", "old_id")


_TOK = "regexp_extract_all(lower({x}), '([a-z]+)', 1)"


@query("pair_tfidf", f"""{T}, p AS (SELECT a.id, {_TOK.format(x="a.content")} AS x, {_TOK.format(x="b.content")} AS y FROM turns a JOIN turns b ON b.id = a.id + 1),
k AS (SELECT id, unnest(list_distinct(list_concat(x, y))) AS w, x, y FROM p), v AS (SELECT id, len(list_filter(x, lambda t: t = w)) / greatest(len(x), 1) * CASE WHEN list_contains(x, w) AND list_contains(y, w) THEN ln(1.5::DOUBLE) ELSE ln(2.0::DOUBLE) END AS a, len(list_filter(y, lambda t: t = w)) / greatest(len(y), 1) * CASE WHEN list_contains(x, w) AND list_contains(y, w) THEN ln(1.5::DOUBLE) ELSE ln(2.0::DOUBLE) END AS b FROM k)
SELECT p.id, round(coalesce(sum(a * b) / nullif(sqrt(sum(a * a)) * sqrt(sum(b * b)), 0), 0), 6) AS sim FROM p LEFT JOIN v ON p.id = v.id GROUP BY p.id""")
def pair_tfidf(spark, sf):
    t = view(spark, sf, "turns").select("id", "content")
    n = t.select((F.col("id") - 1).alias("id"), F.col("content").alias("next"))
    return op.pair_tfidf(t.join(n, "id"), "id", "content", "next")


@query("rule_importance", f"""{T}, w AS (SELECT id, role, content, id % 1000 AS i, list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '') AS w FROM turns)
SELECT id, round(least(1.0::DOUBLE, 0.25::DOUBLE + CASE WHEN len(w) > 0 THEN least(len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]') AND length(x) > 2)) / len(w), 0.5::DOUBLE) * 0.5::DOUBLE ELSE 0 END + CASE WHEN i < 20 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN length(content) > 80 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN role = 'user' AND regexp_matches(lower(content), '{fx.IDENTITY}') THEN 0.2::DOUBLE ELSE 0 END), 3) AS score FROM w""")
def rule_importance(spark, sf):
    return view(spark, sf, "turns").select("id", fx.rule_importance(F.col("role"), F.col("content"), F.col("id") % 1000).alias("score"))


@query("assembled_context", f"{T}, a AS (SELECT session_id, 1 AS n, '<[SYSTEM]>' || chr(10) || 'You remember.' || chr(10) || '</[SYSTEM]>' AS body FROM turns GROUP BY 1), r AS (SELECT session_id, string_agg(role || ': ' || content, chr(10) ORDER BY id) AS t FROM turns GROUP BY 1), b AS (SELECT session_id, 2 AS n, '<[RECENT]>' || chr(10) || CASE WHEN length(t) > 2000 THEN right(t, 2000) ELSE t END || chr(10) || '</[RECENT]>' AS body FROM r) SELECT session_id, md5(string_agg(body, chr(10) || chr(10) ORDER BY n)) AS digest, count(*)::INT AS sections FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1")
def assembled_context(spark, sf):
    t = view(spark, sf, "turns")
    one = t.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("id", F.concat_ws(": ", "role", "content").alias("l")))).alias("l"))
    a = one.select("session_id", F.lit(1).alias("section_no"), op.fit(F.lit("You remember."), 100, "SYSTEM").alias("body"))
    b = one.select("session_id", F.lit(2).alias("section_no"), op.fit(F.array_join("l.l", "\n"), 500, "RECENT").alias("body"))
    out = op.assemble(a.unionByName(b), "session_id")
    return out.select("session_id", F.md5("context").alias("digest"), "sections")


@query("daily_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_windows(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("day"), "event_type", "n", "total")


@query("user_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS events FROM s GROUP BY user_id, k")
def user_sessions(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("started"), F.count("*").alias("events")).select("user_id", "started", "events")


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, sf):
    return metrics.latency(table(spark, sf, "events"), "event_type")


@query("threshold_sweep", "WITH s AS (SELECT quality = 1 AS positive, least(1.0, n_chars / 5000.0)::DOUBLE AS score FROM labels JOIN documents USING (doc_id)), t AS (SELECT range / 20.0::DOUBLE AS threshold FROM range(1, 20)), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND positive) AS tp, count(*) FILTER (score >= threshold AND NOT positive) AS fp, count(*) FILTER (score < threshold AND positive) AS fn FROM s, t GROUP BY 1), p AS (SELECT threshold, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c) SELECT threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM p")
def threshold_sweep(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select((F.col("quality") == 1).alias("positive"), F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("score"))
    return metrics.sweep(j, spark.range(1, 20).select((F.col("id") / 20.0).alias("threshold")))


@query("run_spread", "SELECT event_type AS metric, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS spread, count(*) AS runs FROM (SELECT event_type, user_id % 3 AS run, avg(value) AS v FROM events GROUP BY ALL) GROUP BY 1")
def run_spread(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 3).alias("run")).agg(F.avg("value").alias("value"))
    return metrics.runs(e)


@query("always_failed", "SELECT item FROM (SELECT p_brand AS item, p_size % 3 AS run, avg(p_retailprice) >= 1450 AS ok FROM part GROUP BY ALL) GROUP BY 1 HAVING count(*) FILTER (NOT ok) = 3")
def always_failed(spark, sf):
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("item"), (F.col("p_size") % 3).alias("run")).agg((F.avg("p_retailprice") >= 1450).alias("ok"))
    return metrics.always_failed(p, 3)


@query("cluster_summaries", f"{T} SELECT session_id, min(id) || '-' || max(id) AS turn_range, md5(string_agg(substring(content, 1, 80), ' | ' ORDER BY id)) AS digest FROM turns GROUP BY 1")
def cluster_summaries(spark, sf):
    return op.fallback_summary(view(spark, sf, "turns"), ["session_id"]).select("session_id", "turn_range", F.md5("summary").alias("digest"))


@query("sessions_listing", f"{T} SELECT session_id, count(*) AS turns, max(id) AS newest FROM turns GROUP BY 1 ORDER BY newest DESC LIMIT 20")
def sessions_listing(spark, sf):
    return view(spark, sf, "turns").groupBy("session_id").agg(F.count("*").alias("turns"), F.max("id").alias("newest")).orderBy(F.desc("newest")).limit(20)


@query("date_rank", "SELECT o_orderkey, round((d - 1) / greatest(max(d) OVER (PARTITION BY o_custkey) - 1, 1) * 0.05::DOUBLE, 6) AS nudge FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS d FROM orders)")
def date_rank(spark, sf):
    """W10."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    o = table(spark, sf, "orders").withColumn("d", F.dense_rank().over(w.orderBy("o_orderdate")))
    return o.select("o_orderkey", F.round((F.col("d") - 1) / F.greatest(F.max("d").over(w) - 1, F.lit(1)) * 0.05, 6).alias("nudge"))


_ = rank
