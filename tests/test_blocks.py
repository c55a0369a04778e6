"""Best matches and links by blocks: right at ties and nulls, and without a row for each pair."""

import math

import pyarrow as pa
import pytest

from memlake.operators import blocks
from memlake.plans import catalogue


def shuffled(spark, df):
    """Rows that the stages of a query wrote for others to read."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        found = store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    old = stages()
    df().write.format("noop").mode("overwrite").save()
    return sum(n for k, n in stages().items() if k not in old)


@pytest.fixture
def large(spark):
    """No table is small enough to be sent to all."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


TFIDF = ["session_diverse_topk", "round_robin", "any_all_gold", "retrieval_metrics", "recall_block", "session_scores", "tfidf_topk"]


@pytest.mark.parametrize("name", TFIDF)
def test_matches_of_all_queries_are_not_shuffled(spark, large, tmp_path, name):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = {}
    for n in (40, 80):
        t = spark.range(n).selectExpr("id * 50 as conv_id", "explode(sequence(1L, 10L)) as turn")
        t = t.selectExpr("conv_id", "turn", "'user' as role", f"concat('common ', array('{"','".join(words)}')[cast((conv_id div 50 * 3 + turn * 5) % 8 as int)], ' ', array('{"','".join(words)}')[cast(turn % 8 as int)]) as text")
        t.write.parquet(f"{tmp_path}/{n}/conversations.parquet")
        rows[n] = shuffled(spark, lambda: catalogue.queries()[name](spark, f"{tmp_path}/{n}"))
    assert rows[80] < 2.5 * rows[40], rows


def plain_best(rows, queries, k, newest, other):
    out = set()
    for q, x in queries:
        sims = []
        for i, v in rows:
            if other and i == q:
                continue
            s = None if v is None or len(v) != len(x) or None in v else sum(a * b for a, b in zip(x, v))
            n = -math.inf if s is None else math.inf if math.isnan(s) else round(s, 6)
            sims.append((-n, -i if newest else i, i))
        out |= {(q, i) for _, _, i in sorted(sims)[:k]}
    return out


@pytest.mark.parametrize("newest", [False, True])
def test_best_with_ties_nulls_and_unlike_lengths(monkeypatch, newest):
    monkeypatch.setattr(blocks, "CHUNK", 7)
    rows = [(i, [float(i % 5), 1.0, (i * 7 % 11) / 4]) for i in range(40)] + [(40, None), (41, [1.0, None, 2.0]), (42, [1.0]), (43, [math.nan, 0.0, 0.0])]
    queries = [(0, [1.0, 0.0, 0.5]), (7, [0.0, 0.25, 0.0]), (50, [-1.0, 0.0, 1.0])]
    a = pa.table({"id": pa.array([r[0] for r in rows]), "v": pa.array([r[1] for r in rows], pa.list_(pa.float32()))})
    b = pa.table({"query": pa.array([q[0] for q in queries]), "v": pa.array([q[1] for q in queries], pa.list_(pa.float32()))})
    for k in (1, 3, 10, 100):
        got = blocks.best(a, b, k, None, None, newest, True)
        assert {(x["query"], x["id"]) for x in got.to_pylist()} == plain_best(rows, queries, k, newest, True)
    undefined = {x["id"] for x in got.to_pylist() if x["query"] == 0 and x["sim"] is None}
    assert undefined == {40, 41, 42}


def test_rounding_is_that_of_the_shortest_decimal():
    import numpy as np

    assert blocks.half_up(np.array([0.1234565, -0.1234565, 0.0000005, 0.3])).tolist() == [123457, -123457, 1, 300000]


def vectors(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def unit(i):
    """64 numbers of length 1, unlike for each i."""
    x = [math.sin((i + 1) * (j + 3) * 0.7) for j in range(64)]
    n = math.sqrt(sum(a * a for a in x))
    return [a / n for a in x]


@pytest.mark.parametrize("name", ["cosine_topk", "rrf_fused", "mmr_top3"])
def test_nearest_vectors_make_no_row_for_each_pair(spark, large, tmp_path, name):
    d = vectors(spark, tmp_path, [(i, unit(i), 1) for i in range(120)])
    plan = catalogue.queries()[name](spark, d)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_mmr_reads_its_candidates_once(spark, tmp_path):
    d = vectors(spark, tmp_path, [(i, unit(i), 1) for i in range(120)])
    files = catalogue.queries()["mmr_top3"](spark, d).inputFiles()
    assert files and not any("embeddings.parquet" in f for f in files)


@pytest.mark.parametrize("side", [8192, 9])
def test_close_pairs_over_blocks(spark, tmp_path, monkeypatch, side):
    monkeypatch.setattr(blocks, "SIDE", side)
    rows = [(i, unit(i // 2), i % 2 if i < 30 else 0) for i in range(40)] + [(40, None, 0), (41, [0.5] * 4, 0), (42, [1.0] * 4, 0), (43, unit(0), None)]
    df = catalogue.queries()["alias_pairs"](spark, vectors(spark, tmp_path, rows))
    v = {r[0]: r for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a][1], v[b][1]))
    alike = lambda a, b: v[a][2] is not None and v[a][2] == v[b][2] and None not in (v[a][1], v[b][1]) and len(v[a][1]) == len(v[b][1])
    want = {(a, b) for a in v for b in v if a < b and alike(a, b) and dot(a, b) >= 0.3}
    assert want and {(r["a"], r["b"]) for r in df.collect()} == want
    assert "a#" not in "".join(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)


def test_clusters_of_many_like_vectors_make_few_links(spark, large, tmp_path):
    rows = {n: shuffled(spark, lambda n=n: catalogue.queries()["dbscan_components"](spark, vectors(spark, tmp_path / str(n), [(i, unit(0), 1) for i in range(n)]))) for n in (200, 400)}
    assert rows[400] < 2.5 * rows[200], rows
