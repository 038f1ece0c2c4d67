"""Shapes of the plans that large inputs depend on."""

import os

import pytest
from oracle import SF_DIR

from kbloom.plans.catalogue import QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["crawl_topk", "reconcile_scalar", "reconcile_list", "summary_view", "field_diff", "term_cooccurrence", "followup_questions", "text_metrics", "top_terms", "term_stats", "verbatim_quotes"])
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(spark, name) and "NestedLoop" not in plan(spark, name)


@pytest.mark.parametrize("name", ["fuzzy_pairs", "content_gaps"])
def test_no_cartesian_product_beside_keys(spark, name):
    assert "CartesianProduct" not in plan(spark, name)


def test_filters_and_columns_reach_the_scan(spark):
    shown = plan(spark, "category_lookup")
    assert "EqualTo(p_type,ECONOMY)" in shown and "p_retailprice" not in shown
    assert "html" not in plan(spark, "normalize_url")


def test_pages_are_parsed_once(spark):
    assert plan(spark, "crawl_topk").count("MapInPandas") == 1
    for name in ("text_metrics", "reconcile_scalar", "classify_url", "phones"):
        assert "Python" not in plan(spark, name) and "Pandas" not in plan(spark, name)


def test_quoted_texts_are_made_once_and_stay_in_place(spark):
    shown = plan(spark, "verbatim_quotes")
    assert shown.count("documents.parquet") == 1 and "hashpartitioning" not in shown
    assert sum("replace(" in line for line in shown.splitlines() if "doc_id" in line) == 1
