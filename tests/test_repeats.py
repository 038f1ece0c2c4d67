"""Work that repeated names and repeated parts of an expression must not multiply."""

import os

import pytest
from oracle import SF_DIR
from pyspark.sql import functions as F

from kbloom.operators import scoring
from kbloom.plans.catalogue import QUERIES


def test_repeated_names_are_compared_once(spark):
    names = ["Red Pump Services, Inc", "Blue Ring", "", "old plate", "x"]
    expected = spark.createDataFrame([(k, "b", names[k % 5]) for k in range(300)], "expected long, p_brand string, a string")
    produced = spark.createDataFrame([(k, "b", ["The red pump co", "ring", None][k % 3]) for k in range(300)], "produced long, p_brand string, b string")
    found = scoring.fuzzy_names(expected, produced, ["p_brand"])
    want = expected.join(produced, "p_brand").where(scoring.fuzzy_equal(F.col("a"), F.col("b"))).select("p_brand", "a", "b").distinct()
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == sorted(tuple(r) for r in want.collect()) == [("b", "Blue Ring", "ring"), ("b", "Red Pump Services, Inc", "The red pump co")]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_names_are_grouped_before_they_meet(spark):
    for name in ("fuzzy_pairs", "recall_micro"):
        tree = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
        below = tree[tree.index("array_intersect") :]
        assert "Aggregate [p_brand" in below, name


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_a_link_is_normalised_once(spark):
    """The expression is one tree; parts used twice in it are bound and not copied."""
    tree = QUERIES["social_profile"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("utm_source, utm_medium") <= 1 and "Filter (isnotnull(CASE" not in tree and len(tree) < 20_000
