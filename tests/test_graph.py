"""Loops of the entity graph."""

from memlake.operators.graph import components


def test_components_of_a_path_take_many_rounds(spark):
    path = spark.range(3000).selectExpr("id as a", "id + 1 as b")
    found = components(path)
    assert found.where("root = 0").count() == 3001


def test_components_with_nulls_and_repeats(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (None, 4), (7, 8), (7, 8), (9, 9)], "a long, b long")
    assert {(x.node, x.root) for x in components(links).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9)}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
