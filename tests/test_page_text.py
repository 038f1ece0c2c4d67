"""Text queries over pages with open references, and names with numbers, against their SQL."""

import duckdb
import pytest
from oracle import same

from kbloom.plans.catalogue import ORACLES, QUERIES

PAGES = [
    (1, "https://a.com/", "<html><head><title>Pumps &amp; wells&amp</title></head><body><p>Cut in a reference&amp</p><p>a && b &copy; c&lt d</p></body></html>"),
    (2, "https://a.com/b", "<html><head><title>R&D &amp;amp x &quotq</title></head><body><p>one &middot; two&middot</p></body></html>"),
]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    pages.toPandas().to_parquet(f"{where}/pages.parquet")
    spark.range(1, 22_000, 1, 2).selectExpr("id as s_suppkey").write.parquet(f"{where}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{where}/pages.parquet'")
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{where}/supplier.parquet/*.parquet'")
    return str(where), con


@pytest.mark.parametrize("name", ["js_rendered", "page_title", "visible_text"])
def test_open_references_are_text(spark, made, name):
    same(QUERIES[name](spark, made[0]), made[1], ORACLES[name])


def test_names_with_numbers_like_years(spark, made):
    same(QUERIES["legal_names"](spark, made[0]), made[1], ORACLES["legal_names"])


def test_years_beside_a_name(spark):
    from kbloom.operators import pages

    lines = {
        "© 2007-2023 Acme Wells, LLC. All Rights Reserved": "Acme Wells, LLC", "Copyright Acme Wells 2010 – 2023": "Acme Wells", "© Acme 1999, all rights reserved": "Acme",
        "© 2019, 2021 Route 2000 Pumps Inc 2021. Privacy": "Route 2000 Pumps Inc", "© Acme 18001 Ltd": "Acme 18001 Ltd", "© 2021": None,
    }
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    assert {r.line: r.name for r in df.select("line", pages.legal_name(df.line).alias("name")).collect()} == lines
