"""Every query with a SQL twin against DuckDB."""

import os

import pytest
from oracle import SF_DIR, connect, same

from kbloom.plans.catalogue import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    same(QUERIES[name](spark, SF_DIR), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_themes_follow_the_greedy_rule(spark):
    """Each site's themes equal a plain greedy pass over its term statistics."""
    from pyspark.sql import functions as F

    from kbloom.operators import terms

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(F.col("source").alias("site"), F.col("doc_id").alias("doc"), "text")
    found = terms.incidence(docs)
    ranked = terms.candidates(terms.statistics(found, docs)).collect()
    pages = {}
    for r in found.collect():
        pages.setdefault((r.site, r.term), set()).add(r.doc)
    want = {}
    for site in {r.site for r in ranked}:
        order = [r.term for r in sorted((x for x in ranked if x.site == site), key=lambda x: x.rank)]
        used, place = set(), 0
        for seed in order:
            if place == 8:
                break
            if seed in used:
                continue
            mine = pages[site, seed]
            near = [t for t in order if t != seed and t not in used and len(pages[site, t] & mine) / max(1, min(len(pages[site, t]), len(mine))) >= 0.6][:5]
            used |= {seed, *near}
            place += 1
            want[site, place] = "|".join([seed, *near])
    got = {(r.site, r.place): r.terms for r in QUERIES["themes"](spark, SF_DIR).collect()}
    assert got == want
