"""Shown lines, page marks, names in footers, review order and crawl ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbloom.functions import display, fields, urls
from kbloom.operators import crawl, pages, quality
from kbloom.plans.record_queries import pick
from kbloom.plans.registry import literal, query, table
from kbloom.plans.site_queries import _HELD, held
from kbloom.plans.url_queries import _ANCHORS, sql_class, sql_host, sql_normal
from kbloom.sources import site_files

_ARRAY = lambda xs: "[" + ", ".join(map(literal, xs)) + "]"
_MARKS = ['<script src="https://birdeye.com/x.js"></script>', '<div class="TP-Widget"></div>', '<iframe src="//widget.podium.com">', "<p>none</p>", '<div class="elfsight-app-1"></div><script src="//shopperapproved.com/a.js">']
_WIDGETS = " UNION ALL ".join(f"SELECT s_suppkey, {literal(n)} AS widget FROM h WHERE regexp_matches(lower(html), {literal(p)})" for p, n in pages.REVIEW_WIDGETS)


@query(f"WITH h AS (SELECT s_suppkey, ({_ARRAY(_MARKS)})[1 + s_suppkey % {len(_MARKS)}] AS html FROM supplier) {_WIDGETS}")
def review_widgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(pages.review_widgets(pick(_MARKS, F.col("s_suppkey")))).alias("widget"))


_KINDS = ["HVACBusiness", "GeneralContractor", "LocalBusiness", "Plumber", "Thing", "HomeAndConstructionBusiness", "AB"]


@query(rf"""WITH k AS (SELECT s_suppkey, ({_ARRAY(_KINDS)})[1 + s_suppkey % {len(_KINDS)}] AS kind FROM supplier),
w AS (SELECT s_suppkey, kind, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(kind, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '\bBusiness\b', '', 'g'), '\s+', ' ', 'g')) AS words FROM k)
SELECT s_suppkey, kind, CASE WHEN kind NOT IN ({", ".join(map(literal, pages.GENERIC_TYPES))}) AND length(words) >= 3 THEN words END AS industry FROM w""")
def industry_from_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = pick(_KINDS, F.col("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", kind.alias("kind"), pages.industry_from_type(kind).alias("industry"))


@query("SELECT s_suppkey, unnest(['Open Sans', 'Font ' || s_suppkey]) AS family FROM supplier")
def google_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.format_string("https://fonts.googleapis.com/css2?family=Open+Sans:wght@400&family=Font%%20%d&display=swap", F.col("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(pages.google_fonts(href)).alias("family"))


_FOOT = "CASE s_suppkey % 4 WHEN 0 THEN '© 2007-2023 Acme Wells ' || s_suppkey || ', LLC. All Rights Reserved | Privacy' WHEN 1 THEN 'Copyright 2020 Blue Pump Inc. Privacy Policy' WHEN 2 THEN '© 2021' ELSE 'no line' END"


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Acme Wells ' || s_suppkey || ', LLC' WHEN 1 THEN 'Blue Pump Inc' END AS name, CASE s_suppkey % 4 WHEN 0 THEN 'LLC' WHEN 1 THEN 'Inc' END AS entity FROM supplier")
def legal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered names and entity types of copyright lines."""
    name = table(spark, sf_dir, "supplier").select("s_suppkey", pages.legal_name(F.expr(_FOOT)).alias("name"))
    return name.withColumn("entity", pages.legal_entity(F.col("name")))


@query("""SELECT p_partkey, unnest(['people', 'offerings', 'onlinePresence.profiles', 'proof.testimonials']) AS path,
  unnest([p_name || CASE WHEN p_partkey % 2 = 0 THEN ' — ' || p_type ELSE '' END, p_name, 'Google business — h' || p_partkey, 'Customer — ' || p_brand]) AS line FROM part""")
def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    records = {
        "people": F.to_json(F.struct(F.col("p_name").alias("name"), F.when(key % 2 == 0, F.col("p_type")).alias("title"))),
        "offerings": F.to_json(F.struct(F.col("p_name").alias("name"))),
        "onlinePresence.profiles": F.to_json(F.struct(F.lit("google-business").alias("platform"), F.concat(F.lit("h"), key.cast("string")).alias("handle"))),
        "proof.testimonials": F.to_json(F.struct(F.lit(None).cast("string").alias("authorName"), F.col("p_brand").alias("authorCompany"))),
    }
    lines = F.array(*[F.struct(F.lit(p).alias("path"), display.record_line(p, r).alias("line")) for p, r in records.items()])
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(lines))




@query("""WITH u AS (SELECT c_custkey, c_custkey % 4 AS n FROM customer) SELECT c_custkey, CASE n WHEN 1 THEN 'Found on the About us page.' WHEN 2 THEN 'Found on the About us page and the home page.' WHEN 3 THEN 'Found on the About us page and 2 other pages.' END AS summary FROM u""")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.slice(F.array(*map(F.lit, ["https://x.com/en/about-us.html", "https://x.com/", "https://x.com/team"])), F.lit(1), (F.col("c_custkey") % 4).cast("int"))
    labels = F.transform(links, lambda u: urls.page_label(u))
    return table(spark, sf_dir, "customer").select("c_custkey", display.source_summary(labels).alias("summary"))


_IMPACT = ", ".join(f"({literal(p)}, {i})" for p, i, *_ in fields.FIELDS)


@query(f"""WITH {_HELD}, i AS (SELECT * FROM (VALUES {_IMPACT}) v(path, impact)),
f AS (SELECT h.doc AS site, h.path, place, impact, CASE WHEN value IS NOT NULL AND place % 5 = 0 THEN 'ai-mock' ELSE method END AS method, CASE WHEN place % 7 = 0 THEN 'n' END AS note, value, confidence FROM h JOIN i USING (path)),
a AS (SELECT * FROM f WHERE CASE WHEN method IN ('ai-live', 'ai-mock') THEN true WHEN note IS NOT NULL THEN true ELSE value IS NOT NULL AND confidence < 0.5 END AND (site + place) % 11 <> 0),
c AS (SELECT *, (site * place) % 6 = 1 AS contested FROM a)
SELECT site, path, contested, NOT contested AND method NOT IN ('ai-live', 'ai-mock') AS safe, row_number() OVER (PARTITION BY site ORDER BY contested DESC, impact DESC, place)::INT AS rank FROM c""")
def attention_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields to review, contested ones first, and which may be accepted at once."""
    impact = fields.by_key({p: i for p, i, *_ in fields.FIELDS}, F.col("path"))
    rows = held(spark, sf_dir).withColumnRenamed("doc", "site").withColumn("impact", impact)
    rows = rows.withColumn("method", F.when(F.col("value").isNotNull() & (F.col("place") % 5 == 0), "ai-mock").otherwise(F.col("method"))).withColumn("note", F.when(F.col("place") % 7 == 0, "n"))
    return quality.attention(rows, rows.where("(site * place) % 6 = 1"), rows.where("(site + place) % 11 = 0"))


@query(f"""WITH {_ANCHORS}, u AS (SELECT {sql_host('page')} AS site, url, arg_min(anchor, {{'p': page_id, 'q': pos}}) AS anchor FROM l GROUP BY ALL),
v AS (SELECT DISTINCT {sql_host('url')} AS site, {sql_normal('url')} AS url FROM pages),
g AS (SELECT site, count(*) AS found, count_if({sql_class('url', 'role', 'anchor')} IN ({", ".join(map(literal, crawl.HIGH_VALUE))}))::BIGINT AS high_value FROM u ANTI JOIN v USING (site, url) GROUP BY site)
SELECT site, found, high_value, found - 20 AS left_over FROM g WHERE found > 20""")
def crawl_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    found = crawl.links(rows).withColumn("site", urls.host_of(F.col("page_url")))
    return crawl.finish(found, rows.select(urls.host_of(F.col("url")).alias("site"), urls.normalize_url(F.col("url")).alias("url")))


@query("SELECT s_suppkey, 'You write for ' || s_name || '.' || chr(10) || 'Be brief.' AS prompt FROM supplier")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("# Title\n> not this\n## System prompt\n\n> You write for "), "s_name", F.lit(".\ntext between\n> Be brief.\n\n## Next\n> nor this\n"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", site_files.prompt_text(page).alias("prompt"))
