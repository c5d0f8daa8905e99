"""Loops over graphs end when nothing changes, not at a number of rounds."""

import pytest

from lodepath.operators import graphs


def test_paths_of_more_than_64_edges(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(67)], "a long, b long, w double").coalesce(1)
    got = {r.v: r.dist for r in graphs.shortest_paths(e, spark.sql("select 0L as src")).collect()}
    assert got == {i: i for i in range(68)}


def test_a_bound_that_is_reached_raises(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "a long, b long, w double")
    with pytest.raises(RuntimeError):
        graphs.shortest_paths(e, spark.sql("select 0L as src"), 3)
    with pytest.raises(RuntimeError):
        graphs.components(e, 1)
    with pytest.raises(ValueError):
        graphs.shortest_paths(e.selectExpr("a", "b", "-w as w"), spark.sql("select 0L as src"))
