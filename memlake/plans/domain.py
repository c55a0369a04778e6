"""The engine's tables, derived from the driver's by SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "turns": "SELECT conv_id * 1000 + turn AS id, concat('s', conv_id) AS session_id, concat('a', conv_id % 5) AS agent_id, role, text AS content, CAST(ceil(length(text) / 4.0) AS BIGINT) AS token_count FROM {conversations}",
    "facts": """SELECT id, scope_key, fact_type, fact_text, t_mentioned, t_occurred, CASE WHEN t_occurred IS NOT NULL AND id % 10 = 1 THEN concat(substring(t_occurred, 1, 8), '28') END AS t_occurred_end,
        CASE WHEN fact_type = 'event' THEN CASE WHEN id % 5 = 0 THEN 'cancelled' WHEN id % 5 = 1 THEN 'planned' ELSE 'occurred' END END AS event_status,
        CASE WHEN id % 7 = 0 THEN lead(id) OVER (PARTITION BY scope_key, fact_type ORDER BY id) END AS superseded_by, source_session_id
      FROM (SELECT doc_id AS id, source AS scope_key, CASE doc_id % 4 WHEN 0 THEN 'state' WHEN 1 THEN 'preference' WHEN 2 THEN 'event' ELSE 'identity' END AS fact_type, text AS fact_text,
        concat('2024/', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '/', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0')) AS t_mentioned,
        CASE WHEN doc_id % 3 <> 0 THEN concat('2023/', lpad(CAST(1 + doc_id % 11 AS STRING), 2, '0'), '/', lpad(CAST(1 + doc_id % 27 AS STRING), 2, '0')) END AS t_occurred,
        concat('s', doc_id % 100) AS source_session_id FROM {documents}) d""",
    "vectors": "SELECT vec_id AS id, embedding AS v, label FROM {embeddings}",
    "typed_edges": "SELECT o_orderkey AS seq, o_custkey AS source, 'PREFERS' AS relation, o_orderpriority AS target, o_orderdate AS valid_from FROM {orders}",
    "feedback": "SELECT user_id % 10 AS src, event_type AS dst, ts, event_id AS seq, CASE WHEN event_type <> 'view' OR event_id % 2 = 0 THEN least(1.0, value / 100) END AS signal FROM {events}",
    "access": "SELECT event_id AS id, concat('a', user_id % 10) AS agent, event_type AS source, least(1.0, value / 100) AS relevance, CASE WHEN event_type <> 'view' THEN least(1.0, value / 200) END AS feedback FROM {events}",
    "summaries": "SELECT doc_id AS id, concat('a', doc_id % 10) AS agent_id, 1 + doc_id % 3 AS level, text AS content, doc_id % 4 = 0 AS is_shared FROM {documents}",
    "cost_log": "SELECT o_custkey AS session_id, l_quantity AS input, l_linenumber AS output, l_extendedprice * 1e-6 AS cost FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
    "attributes": "SELECT n_name AS scope_key, concat('market.', lower(c_mktsegment)) AS attribute_key, c_name AS value_text, CAST(floor(c_acctbal / 1000) AS BIGINT) AS mention_count, c_custkey % 365 AS at, c_custkey AS fact_id FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey",
}
TABLES = ("conversations", "documents", "embeddings", "orders", "events", "lineitem", "customer", "nation", "labels", "supplier", "part", "region", "pages", "benchmark")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def with_(*names: str) -> str:
    """The views as a WITH clause of DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
