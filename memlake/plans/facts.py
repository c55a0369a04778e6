"""Queries over facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text as fx
from memlake.operators import facts as op
from memlake.plans.domain import view, with_
from memlake.plans.registry import query

LIVE = "superseded_by IS NULL AND (event_status IS NULL OR event_status <> 'cancelled')"
F_ = with_("facts")


@query("facts_current", f"{F_} SELECT scope_key, id, t_occurred, place FROM (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY t_occurred DESC NULLS LAST, id DESC) AS place FROM facts WHERE {LIVE}) WHERE place <= 100")
def facts_current(spark, sf):
    return op.current(view(spark, sf, "facts"), 100).select("scope_key", "id", "t_occurred", "place")


@query("facts_of_sessions", f"{F_} SELECT scope_key, id, place FROM (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY t_occurred DESC NULLS LAST, id DESC) AS place FROM facts WHERE {LIVE} AND source_session_id IN (SELECT concat('s', conv_id) FROM conversations)) WHERE place <= 100")
def facts_of_sessions(spark, sf):
    return op.current(view(spark, sf, "facts"), 100, view(spark, sf, "turns")).select("scope_key", "id", "place")


@query("facts_as_of", f"{F_} SELECT f.id, f.scope_key, f.t_mentioned FROM facts f LEFT JOIN facts s ON f.superseded_by = s.id WHERE f.t_mentioned <= '2024/06/15' AND (f.superseded_by IS NULL OR s.t_mentioned > '2024/06/15')")
def facts_as_of(spark, sf):
    return op.as_of(view(spark, sf, "facts"), "2024/06/15").select("id", "scope_key", "t_mentioned")


@query("facts_overlapping", f"{F_} SELECT id, t_occurred, t_occurred_end FROM facts WHERE {LIVE} AND t_occurred <= '2023/05/31' AND coalesce(t_occurred_end, t_occurred) >= '2023/03/01'")
def facts_overlapping(spark, sf):
    return op.overlapping(view(spark, sf, "facts"), "2023/03/01", "2023/05/31").select("id", "t_occurred", "t_occurred_end")


@query("facts_timeline", f"{F_} SELECT scope_key, id, place FROM (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY t_occurred ASC NULLS LAST, id) AS place FROM facts WHERE {LIVE}) WHERE place <= 50")
def facts_timeline(spark, sf):
    return op.timeline(view(spark, sf, "facts"), 50).select("scope_key", "id", "place")


_MERGE = f"""{F_}, p AS (SELECT *, sha256('state' || chr(31) || regexp_replace(regexp_replace(lower(trim(fact_text)), '\\s+', ' ', 'g'), '[.!,;: ]+$', '')) AS h FROM facts)
SELECT h AS normalized_hash, arg_min(id, id) AS id, min(id) AS first_id, arg_min(t_occurred, id) FILTER (t_occurred IS NOT NULL) AS t_occurred, count(*) AS mention_count,
  CASE WHEN bool_or(event_status = 'cancelled') THEN 'cancelled' WHEN bool_or(event_status = 'occurred') THEN 'occurred' ELSE max(event_status) END AS event_status, max(t_mentioned) AS last_confirmed FROM p GROUP BY h"""


@query("facts_reaffirm_merge", _MERGE)
def facts_reaffirm_merge(spark, sf):
    f = view(spark, sf, "facts").withColumns({"scope_key": F.lit("global"), "seq": F.col("id"), "normalized_hash": fx.fact_hash(F.col("fact_text"), F.lit("state"), F.lit(None), F.lit(None))})
    return op.merge(f).select("normalized_hash", "id", F.col("id").alias("first_id"), "t_occurred", "mention_count", "event_status", "last_confirmed")


@query("facts_unlinked", f"{F_} SELECT id FROM facts f WHERE {LIVE} AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.id)")
def facts_unlinked(spark, sf):
    links = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("fact_id"))
    return op.unlinked(view(spark, sf, "facts"), links).select("id")


_CHAIN = f"""{F_.replace("WITH ", "WITH RECURSIVE ", 1)}, e AS (SELECT id AS a, superseded_by AS b FROM facts WHERE superseded_by IS NOT NULL UNION ALL SELECT superseded_by, id FROM facts WHERE superseded_by IS NOT NULL),
reach AS (SELECT id AS a, id AS b FROM facts UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), c AS (SELECT a AS id, min(b) AS chain FROM reach GROUP BY a)"""


@query("fact_chain_components", f"{_CHAIN} SELECT id, chain FROM c")
def fact_chain_components(spark, sf):
    return op.chains(view(spark, sf, "facts")).select("id", "chain")


@query("fact_transitions", f"{_CHAIN} SELECT chain, count(*)::INT AS links, CASE WHEN count(*) > 1 THEN string_agg(t_mentioned || ' #' || id, ' → ' ORDER BY t_mentioned, id) ELSE '' END AS transition FROM c JOIN facts USING (id) GROUP BY chain")
def fact_transitions(spark, sf):
    return op.transition_text(view(spark, sf, "facts"))


@query(
    "facts_supersede",
    f"""{F_}, p AS (SELECT id AS old_id, id + 20 AS new_id FROM facts), w AS (SELECT p.old_id, arg_min(p.new_id, p.new_id) AS new_id, arg_min(n.t_mentioned, p.new_id) AS at FROM p JOIN facts o ON o.id = p.old_id JOIN facts n ON n.id = p.new_id
WHERE o.id <> n.id AND o.scope_key = n.scope_key AND o.superseded_by IS NULL AND (o.t_mentioned < n.t_mentioned OR (o.t_mentioned = n.t_mentioned AND o.id < n.id)) GROUP BY 1)
SELECT f.id, coalesce(f.superseded_by, w.new_id) AS superseded_by, w.at AS t_invalid FROM facts f LEFT JOIN w ON f.id = w.old_id""",
)
def facts_supersede(spark, sf):
    f = view(spark, sf, "facts")
    return op.supersede(f, f.select(F.col("id").alias("old_id"), (F.col("id") + 20).alias("new_id"))).select("id", "superseded_by", "t_invalid")


@query("facts_cancel", f"{F_} SELECT id, CASE WHEN id IN (SELECT doc_id FROM labels) AND superseded_by IS NULL AND event_status = 'planned' THEN 'cancelled' ELSE event_status END AS event_status FROM facts")
def facts_cancel(spark, sf):
    f = view(spark, sf, "facts")
    return op.cancel(f, spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("id"))).select("id", "event_status")


@query("fact_provenance", """WITH c AS (SELECT doc_id AS id, unnest([doc_id * 1000 + 1, doc_id * 1000 + 2, doc_id * 1000 + 50]) AS t FROM documents), j AS (SELECT c.id, count(*) AS cited, count(v.conv_id) AS found FROM c LEFT JOIN conversations v ON v.conv_id * 1000 + v.turn = c.t GROUP BY 1)
SELECT id, cited, found, CASE WHEN cited = found THEN 'intact' WHEN found = 0 THEN 'lost' ELSE 'partial' END AS integrity FROM j""")
def fact_provenance(spark, sf):
    f = view(spark, sf, "facts").select("id", F.array(*[F.col("id") * 1000 + n for n in (1, 2, 50)]).alias("source_turn_ids"))
    return op.provenance(f, view(spark, sf, "turns"))


@query("fact_directions", f"{F_}, p AS (SELECT a.id AS ai, b.id AS bi, a.t_occurred AS sa, b.t_occurred AS sb, coalesce(a.t_occurred_end, a.t_occurred) AS ea, coalesce(b.t_occurred_end, b.t_occurred) AS eb, a.t_mentioned AS ma, b.t_mentioned AS mb, a.t_occurred IS NOT NULL AND b.t_occurred IS NOT NULL AS d FROM facts a JOIN facts b ON b.id = a.id + 20)\nSELECT ai, bi, CASE WHEN (d AND eb < sa) OR (NOT d AND mb < ma) THEN bi WHEN (d AND ea < sb) OR (NOT d AND ma < mb) THEN ai END AS loser FROM p")
def fact_directions(spark, sf):
    f = view(spark, sf, "facts")
    side = lambda p: f.select(*[F.col(c).alias(f"{p}_{n}") for c, n in (("id", "id"), ("t_occurred", "start"), ("t_occurred_end", "end"), ("t_mentioned", "mentioned"))])
    j = side("a").join(side("b"), F.col("b_id") == F.col("a_id") + 20)
    cols = lambda p: {n: F.col(f"{p}_{n}") for n in ("id", "start", "end", "mentioned")}
    return j.select(F.col("a_id").alias("ai"), F.col("b_id").alias("bi"), fx.direction(cols("a"), cols("b"))[0].alias("loser"))
