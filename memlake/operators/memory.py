"""Turns: importance, clusters, patterns, profiles, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text as fx
from memlake.operators.blocks import close_forest
from memlake.operators.graph import components
from memlake.operators.rank import minmax, ranked

SHARES = {"system": 5, "recent": 40, "snapshot": 25, "semantic": 20, "global": 7, "procedural": 3}


def importance(turns: DataFrame, terms: int = 5000) -> DataFrame:
    """Rarity, novelty (a half without vectors), entities and recency of each turn within its session, least important first."""
    t = turns.select("session_id", "id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))).alias("term"))
    tf = t.groupBy("session_id", "id", "term").agg(F.count("*").alias("tf"))
    df = F.count("*").over(Window.partitionBy("session_id", "term"))
    n = turns.groupBy("session_id").agg(F.count("*").alias("n"))
    w = tf.withColumn("df", df).join(n, "session_id").withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    rare = w.groupBy("session_id", "id").agg((F.sum("w") / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("raw"))
    words = F.filter(F.split("content", r"\s+"), lambda v: v != "")
    caps = F.size(F.filter(words, lambda v: v.rlike("^[A-Z][a-zA-Z]+"))).cast("double")
    one = turns.join(rare, ["session_id", "id"], "left").join(n, "session_id")
    s = Window.partitionBy("session_id")
    recent = F.pow(F.lit(2.0), -(F.col("n") - F.row_number().over(s.orderBy("id"))) / 20.0)
    one = one.withColumns({"raw": F.coalesce("raw", F.lit(0.0)), "caps": caps, "recent": recent})
    rarity = F.when(F.col("n") < 2, 0.5).otherwise(minmax(F.col("raw"), ["session_id"]))
    score = 0.30 * rarity + 0.35 * 0.5 + 0.20 * minmax(F.col("caps"), ["session_id"]) + 0.15 * F.col("recent")
    return one.select("session_id", "id", F.col("n"), F.round(score, 4).alias("score"))


def compression_candidates(scored: DataFrame, share: float = 0.30) -> DataFrame:
    """C2."""
    out = ranked(scored, ["session_id"], ["score", "id"])
    return out.where(F.col("place") <= F.greatest(F.lit(1), F.floor(share * F.col("n"))))


def eligible(turns: DataFrame, window: int = 128_000, share: float = 0.70, least: int = 4) -> DataFrame:
    """P8."""
    return turns.groupBy("session_id").agg(F.sum("token_count").alias("tokens"), F.count("*").alias("turns")).where((F.col("tokens") > share * window) & (F.col("turns") >= least))


def dbscan(vectors: DataFrame, eps: float = 0.25, by: str = "label") -> DataFrame:
    """With two points to a core, clusters are the components of links under `eps`; a point alone is its own.

    Links are looked for within `by` only, as the original clusters one session's turns; blocks of vectors
    meet each other, and only a forest of their links leaves them.
    """
    found = components(close_forest(vectors, by, eps))
    return vectors.join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("cluster"))


def fallback_summary(turns: DataFrame, by: list[str]) -> DataFrame:
    """A cluster's turn range, its first words and at most ten capitalised words, sorted."""
    out = turns.groupBy(*by).agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.array_sort(F.collect_list(F.struct("id", "content"))).alias("t"))
    said = F.array_join(F.transform("t", lambda x: F.substring(x["content"], 1, 80)), " | ")
    caps = F.array_sort(F.array_distinct(F.flatten(F.transform("t", lambda x: F.regexp_extract_all(x["content"], F.lit("(?:^|[^A-Za-z0-9_])([A-Z][a-z]{2,})"), F.lit(1))))))
    return out.select(*by, F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")).alias("turn_range"), said.alias("summary"), F.slice(caps, 1, 10).alias("entities"))


def pairs(turns: DataFrame) -> DataFrame:
    """A user's turn with the assistant's next."""
    w = Window.partitionBy("session_id").orderBy("id")
    out = turns.withColumns({"next_role": F.lead("role").over(w), "reply": F.lead("content").over(w)})
    return out.where("role = 'user' and next_role = 'assistant'").select("session_id", "id", "content", "reply")


def mine_patterns(turns: DataFrame, by: str, support: int = 2) -> DataFrame:
    """Triggers and actions that come together often enough, of every session at once. `by` names the owner's column."""
    told = pairs(turns).join(turns.select("id", by), "id").select(by, fx.trigger(F.col("content")).alias("trigger"), fx.action(F.col("reply")).alias("action"))
    total = told.groupBy(by).agg(F.count("*").alias("pairs"))
    out = told.groupBy(by, "trigger", "action").agg(F.count("*").alias("support")).where(F.col("support") >= support).join(total, by)
    return out.select(by, "trigger", "action", "support", F.round(F.least(F.lit(0.95), F.col("support") / F.col("pairs")), 6).alias("confidence"), fx.pattern_text(F.col("trigger"), F.col("action")).alias("pattern"))


def profile(attributes: DataFrame, values: int = 6, keys: int = 40) -> DataFrame:
    """The values of a key by mentions and time, and the keys of a scope by the best of each.

    attributes: scope_key, attribute_key, value_text, mention_count, at, fact_id.
    """
    own = ranked(attributes, ["scope_key", "attribute_key"], [F.desc("mention_count"), F.desc("at"), F.desc("fact_id")], values, "value_place")
    best = own.groupBy("scope_key", "attribute_key").agg(F.max("mention_count").alias("m"), F.max("at").alias("t"))
    best = ranked(best, ["scope_key"], [F.desc("m"), F.desc("t"), F.desc("attribute_key")], keys, "key_place").drop("m", "t")
    return own.join(best, ["scope_key", "attribute_key"])


def render_profile(current: DataFrame) -> DataFrame:
    """C14: `key: v1; v2`, each value once."""
    v = current.groupBy("scope_key", "attribute_key", "key_place").agg(F.array_sort(F.collect_list(F.struct("value_place", "value_text"))).alias("v"))
    line = v.select("scope_key", "key_place", F.concat(F.col("attribute_key"), F.lit(": "), F.array_join(F.array_distinct("v.value_text"), "; ")).alias("line"))
    out = line.groupBy("scope_key").agg(F.array_sort(F.collect_list(F.struct("key_place", "line"))).alias("l"))
    return out.select("scope_key", F.array_join("l.line", "\n").alias("profile"))


def forget(turns: DataFrame, topic: str) -> DataFrame:
    """M8: user turns that share a word of four letters or more with the topic are inactive."""
    hit = F.arrays_overlap(fx.words(F.col("content"), "[a-z]{4,}"), fx.words(F.lit(topic), "[a-z]{4,}"))
    return turns.withColumn("is_active", ~((F.col("role") == "user") & hit))


def lookback_pairs(turns: DataFrame, back: int = 40) -> DataFrame:
    """A user's turn with each of the user turns among the last `back` of its session."""
    u = ranked(turns.where("role = 'user'"), ["session_id"], ["id"], None, "rn").select("session_id", "id", "rn", "content")
    old = u.select("session_id", F.col("id").alias("old_id"), F.col("rn").alias("old_rn"), F.col("content").alias("old_content"))
    return u.join(old, "session_id").where((F.col("old_rn") < F.col("rn")) & (F.col("rn") - F.col("old_rn") <= back))


def pair_tfidf(pairs: DataFrame, id_col: str, a: str, b: str) -> DataFrame:
    """R2: id, sim: cosine of two texts over their own words; a word of both weighs ln 1.5, of one ln 2. Zero where either has no words."""
    p = pairs.select(F.col(id_col).alias("id"), fx.words(F.col(a)).alias("x"), fx.words(F.col(b)).alias("y"))
    p = p.select("id", F.size("x").alias("nx"), F.size("y").alias("ny"), F.concat(F.transform("x", lambda w: F.struct(F.lit(1).alias("mine"), w.alias("w"))), F.transform("y", lambda w: F.struct(F.lit(0).alias("mine"), w.alias("w")))).alias("t"))
    t = p.select("id", "nx", "ny", F.explode_outer("t").alias("t")).groupBy("id", "nx", "ny", "t.w").agg(F.count_if(F.expr("t.mine = 1")).alias("cx"), F.count_if(F.expr("t.mine = 0")).alias("cy"))
    idf = F.when((F.col("cx") > 0) & (F.col("cy") > 0), F.log(F.lit(1.5))).otherwise(F.log(F.lit(2.0)))
    t = t.select("id", (F.col("cx") / F.greatest("nx", F.lit(1)) * idf).alias("wx"), (F.col("cy") / F.greatest("ny", F.lit(1)) * idf).alias("wy"))
    size = F.sqrt(F.sum(F.col("wx") * F.col("wx")) * F.sum(F.col("wy") * F.col("wy")))
    return t.groupBy("id").agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("wx") * F.col("wy")), size), F.lit(0.0)), 6).alias("sim"))


def allocation(window: int, share: float = 0.60) -> dict[str, int]:
    """K1."""
    whole = int(window * share)
    return {k: int(whole * v / 100) for k, v in SHARES.items()}


def fit(x: Column, tokens: int, label: str, keep: str = "tail") -> Column:
    """K4: a section cut to its budget of four characters a token, wrapped in its tags; empty stays empty."""
    cut = F.right(x, F.lit(tokens * 4)) if keep == "tail" else F.left(x, F.lit(tokens * 4))
    return F.when(F.length(x) > 0, F.concat(F.lit(f"<[{label}]>\n"), F.when(F.length(x) > tokens * 4, cut).otherwise(x), F.lit(f"\n</[{label}]>"))).otherwise("")


def assemble(sections: DataFrame, by: str) -> DataFrame:
    """K2: sections (by, section_no, body) that are not empty, in order, as one text."""
    out = sections.where("length(body) > 0").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("section_no", "body"))).alias("s"))
    return out.select(by, F.array_join("s.body", "\n\n").alias("context"), F.size("s").alias("sections"))


def cost_report(log: DataFrame) -> DataFrame:
    """A1: cost of each session, and what it would have been without a cache."""
    out = log.groupBy("session_id").agg(F.sum("cost").alias("cost"), F.sum("input").alias("input"), F.sum("output").alias("output"))
    base = F.col("input") * 5e-6 + F.col("output") * 15e-6
    return out.select("session_id", F.round("cost", 6).alias("cost"), "input", "output", F.round(base, 6).alias("baseline"), F.round(base - F.col("cost"), 6).alias("saved"))
