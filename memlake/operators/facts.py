"""Facts: live and point-in-time reads, merging, chains, mutation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.graph import components


def live(status: Column | None = None, superseded: Column | None = None, cancelled: bool = False) -> Column:
    """Not superseded, and not cancelled unless asked for; an unknown status is no cancellation."""
    superseded = F.col("superseded_by") if superseded is None else superseded
    status = F.col("event_status") if status is None else status
    ok = superseded.isNull()
    return ok if cancelled else ok & (status.isNull() | (status != "cancelled"))


def in_sessions(facts: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """None reads all sessions, an empty table none."""
    if sessions is None:
        return facts
    ids = sessions.select(F.col("session_id").alias("source_session_id")).distinct()
    return facts.join(ids, "source_session_id", "left_semi")


def current(facts: DataFrame, per_scope: int, sessions: DataFrame | None = None, cancelled: bool = False) -> DataFrame:
    """T1 over P1: the newest live facts of each scope, undated last."""
    w = Window.partitionBy("scope_key").orderBy(F.desc_nulls_last("t_occurred"), F.desc("id"))
    return in_sessions(facts, sessions).where(live(cancelled=cancelled)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_scope)


def as_of(facts: DataFrame, day: str) -> DataFrame:
    """Told by that day, and not superseded by a fact that was told by then."""
    later = facts.select(F.col("id").alias("s_id"), F.col("t_mentioned").alias("s_mentioned"))
    joined = facts.where(F.col("t_mentioned") <= day).join(later, F.col("superseded_by") == F.col("s_id"), "left")
    return joined.where(F.col("superseded_by").isNull() | (F.col("s_mentioned") > day)).drop("s_id", "s_mentioned")


def overlapping(facts: DataFrame, first: str, last: str) -> DataFrame:
    """Live facts whose time touches a range; undated ones don't."""
    return facts.where(live() & (F.col("t_occurred") <= last) & (F.coalesce("t_occurred_end", "t_occurred") >= first))


def timeline(facts: DataFrame, per_scope: int) -> DataFrame:
    """Oldest first, undated last."""
    w = Window.partitionBy("scope_key").orderBy(F.asc_nulls_last("t_occurred"), F.asc("id"))
    return facts.where(live()).withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_scope)


def merge(proposals: DataFrame) -> DataFrame:
    """One fact per scope and hash, from proposals in the order of `seq`.

    The first telling gives text and time of ingest; sessions and turns are united in order;
    a missing date is filled by the first that has one; planned turns to occurred, and
    cancelled stays. Orders are by sorted structs, so a rerun gives the same rows.
    """
    said = F.struct("seq", "id", "fact_text", "t_occurred", "t_occurred_end", "event_status", "source_session_id", "t_mentioned")
    dated = F.when(F.col("t_occurred").isNotNull(), F.struct("seq", "t_occurred", "t_occurred_end"))
    status = F.when(F.max(F.when(F.col("event_status") == "cancelled", 1)).isNotNull(), "cancelled").when(F.max(F.when(F.col("event_status") == "occurred", 1)).isNotNull(), "occurred").otherwise(F.max("event_status"))
    out = proposals.groupBy("scope_key", "normalized_hash").agg(
        F.min(said).alias("first"), F.min(dated).alias("dated"), F.count("*").alias("mention_count"), status.alias("event_status"), F.max("t_mentioned").alias("last_confirmed"), F.array_sort(F.collect_list(F.struct("seq", "source_session_id"))).alias("told")
    )
    return out.select("scope_key", "normalized_hash", "first.id", "first.fact_text", F.col("dated.t_occurred").alias("t_occurred"), F.col("dated.t_occurred_end").alias("t_occurred_end"), "event_status", "mention_count", "last_confirmed", F.array_distinct("told.source_session_id").alias("source_session_ids"))


def unlinked(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Live facts without a link; also what a recovery drain has left to do."""
    return facts.where(live()).join(links.select(F.col("fact_id").alias("id")), "id", "left_anti")


def chains(facts: DataFrame) -> DataFrame:
    """G1: the chain of every fact, named by its smallest id."""
    found = components(facts.where("superseded_by is not null").select(F.col("id").alias("a"), F.col("superseded_by").alias("b")))
    return facts.join(found, F.col("id") == F.col("node"), "left").withColumn("chain", F.coalesce("root", "id")).drop("node", "root")


def transition_text(facts: DataFrame) -> DataFrame:
    """How a chain's fact changed, oldest first; empty for a fact alone."""
    one = chains(facts).withColumn("line", F.concat_ws(" ", F.col("t_mentioned"), F.concat(F.lit("#"), F.col("id").cast("string"))))
    out = one.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("t_mentioned", "id", "line"))).alias("s"))
    return out.select("chain", F.size("s").alias("links"), F.when(F.size("s") > 1, F.array_join("s.line", " → ")).otherwise("").alias("transition"))


def supersede(facts: DataFrame, proposals: DataFrame) -> DataFrame:
    """Apply old -> new proposals that hold, the smallest winner of each old fact.

    A proposal holds if both facts are there, differ, share a scope, the old one is not
    superseded yet, and the new one isn't older in its own chain: as replacements go from
    an older fact to a later one only, by (t_mentioned, id), no cycle can come about.
    """
    f = lambda p: facts.select(F.col("id").alias(f"{p}_id"), F.col("scope_key").alias(f"{p}_scope"), F.col("t_mentioned").alias(f"{p}_at"), F.col("superseded_by").alias(f"{p}_by"))
    ok = proposals.join(f("old"), "old_id").join(f("new"), "new_id").where("old_id <> new_id and old_scope = new_scope and old_by is null").where(F.struct("old_at", "old_id") < F.struct("new_at", "new_id"))
    win = ok.groupBy("old_id").agg(F.min(F.struct("new_id", "new_at")).alias("w"))
    out = facts.join(win, F.col("id") == F.col("old_id"), "left")
    return out.withColumns({"superseded_by": F.coalesce("superseded_by", "w.new_id"), "t_invalid": F.col("w.new_at")}).drop("old_id", "w")


def cancel(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """M4: live planned events of `ids` become cancelled; nothing else changes."""
    named = ids.select(F.col("id").alias("c_id")).distinct()
    hit = F.col("c_id").isNotNull() & F.col("superseded_by").isNull() & (F.col("event_status") == "planned")
    return facts.join(named, F.col("id") == F.col("c_id"), "left").withColumn("event_status", F.when(hit, "cancelled").otherwise(F.col("event_status"))).drop("c_id")


def provenance(facts: DataFrame, turns: DataFrame) -> DataFrame:
    """How many of a fact's cited turns are there: all, some or none of them."""
    cited = facts.select("id", F.explode_outer("source_turn_ids").alias("turn_id"))
    have = turns.select(F.col("id").alias("t_id")).distinct()
    out = cited.join(have, F.col("turn_id") == F.col("t_id"), "left").groupBy("id").agg(F.count("turn_id").alias("cited"), F.count("t_id").alias("found"))
    return out.withColumn("integrity", F.when(F.col("cited") == 0, "uncited").when(F.col("cited") == F.col("found"), "intact").when(F.col("found") == 0, "lost").otherwise("partial"))


def evidence(proposals: DataFrame, turns: DataFrame, most: int = 8) -> DataFrame:
    """Support of proposed facts in their session's turns.

    proposals: p_id, session_id, stems; turns: session_id, id, role, stems. A fact of up to
    four stems needs one in a user turn, a longer one two; up to `most` turns are cited, by overlap.
    """
    p = proposals.select("p_id", "session_id", F.size("stems").alias("stems_n"), F.explode("stems").alias("stem"))
    t = turns.select("session_id", "id", "role", F.explode("stems").alias("stem"))
    hit = p.join(t, ["session_id", "stem"]).groupBy("p_id", "stems_n", "id", "role").agg(F.count("*").alias("overlap"))
    w = Window.partitionBy("p_id").orderBy(F.desc("overlap"), "id")
    cited = hit.withColumn("place", F.row_number().over(w))
    out = cited.groupBy("p_id", "stems_n").agg(F.max(F.when(F.col("role") == "user", F.col("overlap"))).alias("best"), F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "id")))).alias("c"))
    enough = F.coalesce(F.col("best") >= F.when(F.col("stems_n") <= 4, 1).otherwise(2), F.lit(False))
    all_ = proposals.select("p_id").join(out, "p_id", "left")
    return all_.select("p_id", F.coalesce(enough, F.lit(False)).alias("accepted"), F.coalesce(F.col("c.id"), F.array().cast("array<bigint>")).alias("cited"))
