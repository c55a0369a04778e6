"""Queries that rank: text, vectors, fusion, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text as fx
from memlake.operators import metrics, rank
from memlake.operators.blocks import close_pairs
from memlake.plans.domain import table, view, with_
from memlake.plans.registry import query

T = with_("turns")
# queries: the first turn of every conversation of the query set, whose ids divide by 50
QUERIES = "q AS (SELECT conv_id AS query, text FROM conversations WHERE conv_id % 50 = 0 AND turn = 1)"
TFIDF = f"""{T}, {QUERIES}, tk AS (SELECT id, unnest(regexp_extract_all(lower(content), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1)) AS term FROM turns), tf AS (SELECT id, term, count(*) AS tf FROM tk GROUP BY ALL),
vo AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY 1 ORDER BY cf DESC, term LIMIT 512), nn AS (SELECT count(*) AS n FROM turns), ix AS (SELECT term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM vo, nn),
w0 AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN ix USING (term)), w AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w0),
qk AS (SELECT query, unnest(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1)) AS term FROM q), qf AS (SELECT query, term, (1 + ln(count(*))) * any_value(idf) AS w FROM qk JOIN ix USING (term) GROUP BY ALL), qw AS (SELECT query, term, w / sqrt(sum(w * w) OVER (PARTITION BY query)) AS qw FROM qf),
sim AS (SELECT query, id, round(sum(qw * w), 6) AS sim FROM qw JOIN w USING (term) GROUP BY ALL), hits AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id DESC) AS place FROM sim WHERE sim > 0.01)"""


def turn_queries(spark, sf):
    return table(spark, sf, "conversations").where("conv_id % 50 = 0 and turn = 1").select(F.col("conv_id").alias("query"), "text")


def turn_hits(spark, sf, k):
    docs = view(spark, sf, "turns").select("id", F.col("content").alias("text"))
    return rank.tfidf_topk(docs, turn_queries(spark, sf), k)


@query("tfidf_topk", f"{TFIDF} SELECT query, id, sim, place FROM hits WHERE place <= 5")
def tfidf_topk(spark, sf):
    return turn_hits(spark, sf, 5).select("query", "id", "sim", "place")


@query("session_diverse_topk", f"{TFIDF}, h AS (SELECT query, id // 1000 AS session_id, id, sim FROM hits WHERE place <= 100), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, session_id ORDER BY sim DESC, id) AS own FROM h) WHERE own <= 2) SELECT * FROM (SELECT query, session_id, id, sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS place FROM c) WHERE place <= 10")
def session_diverse_topk(spark, sf):
    h = turn_hits(spark, sf, 100).select("query", F.expr("id div 1000").alias("session_id"), "id", "sim")
    return rank.diverse(h, 10)


@query("round_robin", f"{TFIDF}, h AS (SELECT query, id // 1000 AS session_id, id, sim FROM hits WHERE place <= 100), m AS (SELECT query, session_id, max(sim) AS top FROM h GROUP BY ALL), b AS (SELECT * FROM (SELECT query, session_id, row_number() OVER (PARTITION BY query ORDER BY top DESC, session_id) AS s_rank FROM m) WHERE s_rank <= 12), o AS (SELECT *, row_number() OVER (PARTITION BY query, session_id ORDER BY sim DESC, id) AS own FROM h JOIN b USING (query, session_id)) SELECT query, session_id, id, sim, own, s_rank, row_number() OVER (PARTITION BY query ORDER BY own, s_rank) AS place FROM o")
def round_robin(spark, sf):
    h = turn_hits(spark, sf, 100).select("query", F.expr("id div 1000").alias("session_id"), "id", "sim")
    return rank.round_robin(h)


@query("session_scores", f"{TFIDF}, h AS (SELECT query, id // 1000 AS session_id, id, sim, row_number() OVER (PARTITION BY query, id // 1000 ORDER BY sim DESC, id) AS r FROM hits WHERE place <= 100) SELECT query, session_id, round(avg(sim), 9) AS score FROM h WHERE r <= 3 GROUP BY ALL")
def session_scores(spark, sf):
    h = turn_hits(spark, sf, 100).select("query", F.expr("id div 1000").alias("session_id"), "id", "sim")
    return metrics.first_per_session(h)


@query("retrieval_metrics", f"""{TFIDF}, h AS (SELECT query, place, (id // 1000 = query)::INT AS rel FROM hits WHERE place <= 10), g AS (SELECT conv_id AS query, count(*) AS gold FROM conversations GROUP BY 1),
a AS (SELECT query, sum(rel) FILTER (place <= 5) AS h5, min(place) FILTER (rel = 1) AS f, sum(rel / log2(place + 1)) AS d, sum(rel) AS h10 FROM h GROUP BY 1)
SELECT query, round(h5 / gold, 6) AS recall_5, round(coalesce(1.0::DOUBLE / f, 0), 6) AS mrr_10, round(d / list_sum(list_transform(range(1, least(gold, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_10, round(h10 / 10, 6) AS precision_10 FROM a JOIN g USING (query)""")
def retrieval_metrics(spark, sf):
    gold = view(spark, sf, "turns").select(F.expr("id div 1000").alias("query"), "id")
    return metrics.retrieval(turn_hits(spark, sf, 10), gold).select("query", "recall_5", "mrr_10", "ndcg_10", "precision_10")


@query("any_all_gold", f"{TFIDF} SELECT c.conv_id AS query, max(coalesce(h.place <= 10, FALSE)) AS any_gold, min(coalesce(h.place <= 10, FALSE)) AS all_gold FROM conversations c JOIN q ON c.conv_id = q.query LEFT JOIN (SELECT * FROM hits WHERE place <= 10) h ON h.query = c.conv_id AND h.id = c.conv_id * 1000 + c.turn GROUP BY 1")
def any_all_gold(spark, sf):
    gold = view(spark, sf, "turns").select(F.expr("id div 1000").alias("query"), "id").join(turn_queries(spark, sf).select("query"), "query")
    return metrics.any_all(turn_hits(spark, sf, 10), gold, 10)


V = with_("vectors") + """, c AS (SELECT q.id AS query, v.id, round(list_sum(list_transform(range(1, 65), lambda i: q.v[i]::DOUBLE * v.v[i]::DOUBLE)), 6) AS sim FROM vectors q JOIN vectors v ON q.id <> v.id WHERE q.id % 50 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS place FROM c)"""


def near(spark, sf, k):
    v = view(spark, sf, "vectors").select("id", "v")
    return rank.cosine_topk(v, v.where("id % 50 = 0"), k)


@query("cosine_topk", f"{V} SELECT query, id, sim, place FROM n WHERE place <= 10")
def cosine_topk(spark, sf):
    return near(spark, sf, 10)


LISTS = ", l AS (SELECT query, 1 AS list, id, place FROM n WHERE place <= 20 UNION ALL SELECT query, 2, id, row_number() OVER (PARTITION BY query ORDER BY abs(id - query), id) FROM n WHERE abs(id - query) <= 10)"


@query("rrf_fused", f"{V}{LISTS} SELECT query, id, round(sum(1.0::DOUBLE / (60 + place)), 9) AS score FROM l GROUP BY ALL")
def rrf_fused(spark, sf):
    v = view(spark, sf, "vectors").select("id")
    a = near(spark, sf, 20).select("query", F.lit(1).alias("list"), "id", "place")
    q = v.where("id % 50 = 0").select(F.col("id").alias("query"))
    close = q.select("query", F.explode(F.sequence(F.col("query") - 10, F.col("query") + 10)).alias("id")).join(v, "id").where("id <> query")
    b = rank.ranked(close, ["query"], [F.abs(F.col("id") - F.col("query")), F.col("id")]).select("query", F.lit(2).alias("list"), "id", "place")
    return rank.rrf(a.unionByName(b))


DOT = "list_sum(list_transform(range(1, 65), lambda i: a.v[i]::DOUBLE * b.v[i]::DOUBLE))"


@query(
    "mmr_top3",
    f"""{V}, k AS (SELECT query, n.id, sim, v FROM n JOIN vectors USING (id) WHERE place <= 9), s1 AS (SELECT query, id, v, round(0.5::DOUBLE * sim, 9) AS score FROM k), p1 AS (SELECT * FROM s1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) = 1),
k2 AS (SELECT a.query, a.id, a.sim, a.v, {DOT} AS near FROM k a JOIN p1 b ON a.query = b.query AND a.id <> b.id), p2 AS (SELECT query, id, v, round(0.5::DOUBLE * sim - 0.5::DOUBLE * near, 9) AS score FROM k2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) = 1),
k3 AS (SELECT a.query, a.id, a.sim, a.v, greatest(a.near, {DOT}) AS near FROM k2 a JOIN p2 b ON a.query = b.query AND a.id <> b.id), p3 AS (SELECT query, id, round(0.5::DOUBLE * sim - 0.5::DOUBLE * near, 9) AS score FROM k3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) = 1)
SELECT query, id, 1 AS place, round(score, 6) AS score FROM p1 UNION ALL SELECT query, id, 2, round(score, 6) FROM p2 UNION ALL SELECT query, id, 3, round(score, 6) FROM p3""",
)
def mmr_top3(spark, sf):
    v = view(spark, sf, "vectors").select("id", "v")
    return rank.mmr(near(spark, sf, 9).join(v, "id"), 3).select("query", "id", "place", F.round("score", 6).alias("score"))


BUDGET = f"{T}, b AS (SELECT session_id, id, token_count, sum(token_count) OVER (PARTITION BY session_id ORDER BY id DESC) AS cum, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS rn FROM turns)"
RULES = {"a": "cum <= 400 OR rn = 1", "b": "cum - token_count < 400 OR rn = 1", "c": "cum <= 400"}


def _budget(rule):
    @query(f"budget_fill_{rule}", f"{BUDGET} SELECT session_id, id, cum::BIGINT AS cum, rn FROM b WHERE {RULES[rule]}")
    def f(spark, sf):
        t = view(spark, sf, "turns")
        return rank.budget(t, ["session_id"], [F.desc("id")], F.col("token_count"), 400, rule).select("session_id", "id", "cum", "rn")

    return f


for _r in RULES:
    _budget(_r)


@query("history_last_n", f"{T} SELECT session_id, id, role, back FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS back FROM turns) WHERE back <= 20")
def history_last_n(spark, sf):
    return rank.last_n(view(spark, sf, "turns")).select("session_id", "id", "role", "back")


@query("recency_decay", f"{T} SELECT id, round(pow(2::DOUBLE, -(count(*) OVER (PARTITION BY session_id) - row_number() OVER (PARTITION BY session_id ORDER BY id)) / 20.0::DOUBLE), 9) AS recency FROM turns")
def recency_decay(spark, sf):
    return rank.recency(view(spark, sf, "turns")).select("id", F.round("recency", 9).alias("recency"))


@query("recall_block", f"{TFIDF}, k AS (SELECT query, hits.id, place, content, token_count FROM hits JOIN turns USING (id) WHERE place <= 20), b AS (SELECT *, sum(token_count) OVER (PARTITION BY query ORDER BY place) AS cum FROM k) SELECT query, count(*) AS turns, sum(token_count)::BIGINT AS tokens, md5(string_agg(content, chr(10) ORDER BY id)) AS digest FROM b WHERE cum <= 1000 OR place = 1 GROUP BY 1")
def recall_block(spark, sf):
    """K6: ranked turns, filled to a budget, told in their own order."""
    t = view(spark, sf, "turns").select("id", "content", "token_count")
    hits = turn_hits(spark, sf, 20).join(t, "id")
    kept = rank.budget(hits, ["query"], ["place"], F.col("token_count"), 1000, "a")
    out = kept.groupBy("query").agg(F.count("*").alias("turns"), F.sum("token_count").alias("tokens"), F.array_sort(F.collect_list(F.struct("id", "content"))).alias("c"))
    return out.select("query", "turns", "tokens", F.md5(F.array_join("c.content", "\n")).alias("digest"))


@query("novelty", f"{with_('vectors')}, s AS (SELECT label, id, v FROM vectors QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) = 1) SELECT v.id, round(1 - list_sum(list_transform(range(1, 65), lambda i: v.v[i]::DOUBLE * s.v[i]::DOUBLE)), 6) AS novelty FROM vectors v JOIN s USING (label)")
def novelty(spark, sf):
    """One less the likeness to the label's first vector."""
    v = view(spark, sf, "vectors")
    s = rank.ranked(v, ["label"], ["id"], 1).select("label", F.col("v").alias("sv"))
    return v.join(s, "label").select("id", F.round(1 - rank.dot(F.col("v"), F.col("sv")), 6).alias("novelty"))


@query("alias_pairs", f"{with_('vectors')} SELECT a.id AS a, b.id AS b, round({DOT}, 6) AS sim FROM vectors a JOIN vectors b ON a.label = b.label AND a.id < b.id WHERE {DOT} >= 0.3")
def alias_pairs(spark, sf):
    """J9, within a label."""
    return close_pairs(view(spark, sf, "vectors"), "label", 0.3).select("a", "b", F.round("sim", 6).alias("sim"))


@query("keyword_overlap", f"{T}, w AS (SELECT id, session_id, id // 1000 AS c, list_distinct(regexp_extract_all(lower(content), '([\\p{{L}}\\p{{N}}_]{{3,}})', 1)) AS w FROM turns) SELECT a.id, b.id AS next_id, round(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) ELSE 0 END, 6) AS overlap FROM w a JOIN w b ON b.id = a.id + 1")
def keyword_overlap(spark, sf):
    t = view(spark, sf, "turns").select("id", "content")
    n = t.select((F.col("id") - 1).alias("id"), F.col("content").alias("next"))
    return t.join(n, "id").select("id", (F.col("id") + 1).alias("next_id"), F.round(fx.word_jaccard(F.col("content"), F.col("next")), 6).alias("overlap"))
