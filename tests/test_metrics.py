"""Evaluation operators beyond their oracles."""

import pytest

from memlake.operators import metrics


def test_too_many_thresholds_are_an_error(spark):
    scored = spark.createDataFrame([(0.4, True), (0.2, False)], "score double, positive boolean")
    some = lambda n: spark.range(n).selectExpr("id / 1000.0 as threshold")
    assert metrics.sweep(scored, some(1000)).count() == 1000
    with pytest.raises(ValueError):
        metrics.sweep(scored, some(1001))
