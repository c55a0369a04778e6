"""Entity graph: ingest, bounded walks, validity, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Cut a loop's lineage by a table in the folder that all executors share.

    A table has its real size; estimates of joined checkpoints would multiply with each round.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="memlake-checkpoint-"))
    path = f"{sc.getCheckpointDir()}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, most: int = 1000) -> DataFrame:
    """Node, root (the smallest id it is joined with) of the nodes of edges a, b.

    Smallest labels spread over links and then over themselves, so rounds grow with the
    logarithm of the longest path. After `most` rounds it stops with an error.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct())
    label = cut(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    for _ in range(most):
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("low"))
        step = label.join(near, F.col("node") == F.col("a"), "left").select("node", "root", F.least("root", F.coalesce("low", "root")).alias("low"))
        up = label.select(F.col("node").alias("up"), F.col("root").alias("top"))
        new = cut(step.join(up, F.col("low") == F.col("up"), "left").select("node", "root", F.least("low", F.coalesce("top", "low")).alias("low")))
        if new.where("low <> root").isEmpty():
            return label
        label = new.select("node", F.col("low").alias("root"))
    raise RuntimeError(f"components did not settle in {most} rounds")


def nodes(mentions: DataFrame) -> DataFrame:
    """Entities of an agent with their mentions. mentions: agent_id, turn_id, entity."""
    return mentions.groupBy("agent_id", "entity").agg(F.count("*").alias("mentions"), F.min("turn_id").alias("first_seen"), F.max("turn_id").alias("last_seen"))


def cooccurrence(mentions: DataFrame, least: int = 1) -> DataFrame:
    """Pairs of entities with the number of turns that name both.

    A turn's entities are gathered into one sorted set, whose pairs are made in the row: a
    turn is short, so no join multiplies rows of a frequent entity.
    """
    sets = mentions.groupBy("agent_id", "turn_id").agg(F.array_sort(F.collect_set("entity")).alias("e"))
    pairs = sets.select("agent_id", F.explode(F.expr("flatten(transform(e, (x, i) -> transform(slice(e, i + 2, size(e)), y -> struct(x as source, y as target))))")).alias("p"))
    return pairs.groupBy("agent_id", "p.source", "p.target").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def walk(edges: DataFrame, seeds: DataFrame, hops: int = 2, least: int = 2) -> DataFrame:
    """Nodes within `hops` of seeds (query, node) over links of `least` weight, with their distance."""
    both = edges.where(F.col("weight") >= least).select(F.col("source").alias("x"), F.col("target").alias("y"))
    both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y")))
    seen = seeds.select("query", "node", F.lit(0).alias("hop"))
    for h in range(1, hops + 1):
        more = seen.where(F.col("hop") == h - 1).join(both, F.col("node") == F.col("x")).select("query", F.col("y").alias("node"), F.lit(h).alias("hop"))
        seen = seen.unionByName(more).groupBy("query", "node").agg(F.min("hop").alias("hop"))
    return seen


def versions(edges: DataFrame) -> DataFrame:
    """A new target of (source, relation) ends the one before; the same target again changes nothing."""
    w = Window.partitionBy("source", "relation").orderBy("valid_from", "seq")
    new = edges.withColumn("last", F.lag("target").over(w)).where(F.col("last").isNull() | (F.col("last") != F.col("target")))
    return new.withColumn("valid_until", F.lead("valid_from").over(w)).drop("last")


def at(edges: DataFrame, when) -> DataFrame:
    """Links that hold at a time, from the first moment to before the last."""
    return edges.where((F.col("valid_from") <= when) & (F.col("valid_until").isNull() | (F.col("valid_until") > when)))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per unordered pair, weights added, without self links."""
    return edges.where("source <> target").groupBy(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).agg(F.sum("weight").alias("weight"), F.count("*").alias("merged"))


def alias_closure(edges: DataFrame, seeds: DataFrame, depth: int = 10, bound: int = 5000) -> tuple[DataFrame, bool]:
    """What seeds reach over alias links, and whether depth or bound stopped the walk."""
    both = edges.select(F.col("source").alias("x"), F.col("target").alias("y"))
    both = cut(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))))
    seen = cut(seeds.select("node").distinct())
    front = seen
    for _ in range(depth):
        new = cut(front.join(both, F.col("node") == F.col("x")).select(F.col("y").alias("node")).distinct().join(seen, "node", "left_anti"))
        if new.isEmpty():
            return seen, False
        seen, front = cut(seen.unionByName(new)), new
        if seen.count() > bound:
            return seen.orderBy("node").limit(bound), True
    return seen, not front.join(both, F.col("node") == F.col("x")).select(F.col("y").alias("node")).join(seen, "node", "left_anti").isEmpty()


def ancestors(forks: DataFrame, most: int = 20) -> DataFrame:
    """Every ancestor of every agent with its distance; a repeated ancestor ends the walk."""
    up = forks.select(F.col("child").alias("c"), F.col("parent").alias("p"))
    out = front = forks.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    for d in range(2, most + 1):
        front = cut(front.join(up, F.col("ancestor") == F.col("c")).select("child", F.col("p").alias("ancestor"), F.lit(d).alias("depth")).where("ancestor <> child"))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out.groupBy("child", "ancestor").agg(F.min("depth").alias("depth"))


def top_links(edges: DataFrame, n: int) -> DataFrame:
    """T9."""
    return merge_edges(edges).orderBy(F.desc("weight"), "lo", "hi").limit(n)
