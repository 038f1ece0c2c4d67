"""Queries from pages and claims to whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbloom.functions import presenters, urls
from kbloom.operators import documents
from kbloom.plans import record_queries as R
from kbloom.plans.registry import literal, query, table
from kbloom.plans.url_queries import sql_class, sql_host, sql_normal

_NOW = "2024-02-01 00:00:00"
_FIELDS = f"(VALUES {R._FIELD_ROWS}) r(place, path, category, impact, askable, cost, grp, substitutes)"


def _score(*paths: str) -> str:
    known = ", ".join(map(literal, paths))
    return f"(SELECT floor(sum(CASE WHEN path IN ({known}) THEN impact ELSE 0 END) / sum(impact) * 1000.0 + 0.5) / 1000.0 FROM {_FIELDS} WHERE askable)"


def _missing(*paths: str) -> str:
    return f"(SELECT '[' || string_agg('\"' || path || '\"', ',' ORDER BY place) || ']' FROM {_FIELDS} WHERE path NOT IN ({', '.join(map(literal, paths))}))"


def _shown(document: str = "document") -> list:
    part = lambda path: F.get_json_object(document, f"$.{path}")
    return [part("foundation.website").alias("website"), part("quality.overallScore").cast("double").alias("score"), part("quality.missingFields").alias("missing"), part("scrape").alias("scrape")]


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of each host in the order of the table."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        urls.host_of(F.col("url")).alias("site"), F.col("page_id").alias("place"), "page_id", urls.normalize_url(F.col("url")).alias("url"), urls.classify(F.col("url"))["role"].alias("role"), "html",
        F.lit(200).alias("status"), F.octet_length("html").cast("long").alias("bytes"), F.lit("2024-01-01T00:00:00Z").alias("fetched_at"),
    ).where("site is not null")


def site_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = site_pages(spark, sf_dir)
    sites = pages.groupBy("site").agg(F.min_by("url", "place").alias("origin")).withColumn("now", F.lit(_NOW).cast("timestamp_ntz"))
    return documents.build(spark, pages, sites)


@query(f"""
WITH p AS (SELECT {sql_host('url')} AS site, page_id, {sql_normal('url')} AS url, {sql_class('url', 'role')} AS role, octet_length(encode(html)) AS bytes FROM pages),
g AS (SELECT site, arg_min(url, page_id) AS origin, string_agg('{{"url":' || to_json(url) || ',"role":"' || role || '","status":200,"bytes":' || bytes || ',"fetchedAt":"2024-01-01T00:00:00Z"}}', ',' ORDER BY page_id) AS t FROM p WHERE site IS NOT NULL GROUP BY site)
SELECT site, '{{"value":' || to_json(origin) || ',"method":"derived","confidence":0.95,"sourceUrls":[' || to_json(origin) || ']}}' AS website, {_score('foundation.website')} AS score, {_missing('foundation.website')} AS missing,
  '{{"startedAt":"2024-01-01T00:00:00Z","finishedAt":"2024-01-01T00:00:00Z","pages":[' || t || '],"robotsRespected":true,"warnings":[],"scraperVersion":"{documents.VERSION}"}}' AS scrape FROM g""")
def site_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to JSON documents, one for each host; some parts of each document."""
    return site_document(spark, sf_dir).select("site", *_shown())


def nation_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = R.claims(spark, sf_dir).withColumn("site", F.col("site").cast("string"))
    spelled = F.expr("CASE seq % 3 WHEN 0 THEN lower(value) WHEN 1 THEN concat('  ', value, ' co ') ELSE concat(value, '  Co') END")
    return base.unionByName(base.withColumn("value", spelled).withColumn("path", F.lit("market.buyers")))


def claim_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as claims of their nation's industry and buyers."""
    claims = nation_claims(spark, sf_dir)
    sites = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("site"), F.concat(F.lit("https://s"), "n_nationkey", F.lit(".com/")).alias("origin"), F.lit(_NOW).cast("timestamp_ntz").alias("now"))
    pages = sites.select("site", F.lit(0).alias("place"), F.col("origin").alias("url"), F.lit("home").alias("role"), F.lit(200).alias("status"), F.lit(1).cast("long").alias("bytes"), F.lit("2024-01-01T00:00:00Z").alias("fetched_at"))
    return documents.from_claims(spark, claims, sites, pages)


_KNOWN = ("foundation.industry", "market.buyers", "foundation.website")


@query(rf"""WITH {R._SCALAR}, a AS (SELECT site, array_to_string(list(key ORDER BY o), ', ') AS alt FROM k WHERE place > 1 GROUP BY site),
x AS (SELECT site, '{{"value":' || to_json(value) || ',"method":"' || CASE WHEN method = 'computed' THEN 'derived' ELSE 'scraped' END || '","confidence":' || CASE WHEN n > 1 THEN least(confidence, 0.45::DOUBLE) ELSE confidence END || ',"sourceUrls":' || to_json(string_split(urls, '|'))
  || CASE WHEN n > 1 THEN ',"note":' || to_json('We found ' || n || ' different values: ' || alt) ELSE '' END || '}}' AS industry FROM k LEFT JOIN a USING (site) WHERE place = 1),
i AS (SELECT *, trim(regexp_replace(CASE seq % 3 WHEN 0 THEN lower(segment) WHEN 1 THEN '  ' || segment || ' co ' ELSE segment || '  Co' END, '\s+', ' ', 'g')) AS item FROM e),
b AS (SELECT site, lower(item) AS key, arg_max({{'item': item, 'c': confidence, 'm': method, 't': tier, 'u': url}}, {{'s': score, 'q': -seq}}) AS b, min(seq) AS first FROM i GROUP BY ALL),
l AS (SELECT site, list(b.item ORDER BY first) AS items, arg_min(b.m, {{'t': -b.t, 'f': first}}) AS m, list_sum(list(b.c ORDER BY first)) / count(*) AS c, list(b.u ORDER BY first) AS us FROM b GROUP BY site),
y AS (SELECT site, '{{"value":' || to_json(items) || ',"method":"' || CASE WHEN m = 'computed' THEN 'derived' ELSE 'scraped' END || '","confidence":' || floor(c * 1000.0 + 0.5) / 1000.0 || ',"sourceUrls":' || to_json(list_transform(list_filter(us, lambda x, i: list_position(us, x) = i), lambda x: x)) || '}}' AS buyers FROM l)
SELECT site::VARCHAR AS site, industry, buyers, '{{"value":"https://s' || site || '.com/","method":"derived","confidence":0.95,"sourceUrls":["https://s' || site || '.com/"]}}' AS website, {_score(*_KNOWN)} AS score, {_missing(*_KNOWN)} AS missing FROM x JOIN y USING (site)""")
def claim_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims to JSON documents; some parts of each document."""
    part = lambda path: F.get_json_object("document", f"$.{path}")
    return claim_document(spark, sf_dir).select("site", part("foundation.industry").alias("industry"), part("market.buyers").alias("buyers"), *_shown()[:3]).where("industry <> '" + documents.NOT_FOUND + "'")


@query(rf"""WITH {R._SCALAR},
i AS (SELECT *, trim(regexp_replace(CASE seq % 3 WHEN 0 THEN lower(segment) WHEN 1 THEN '  ' || segment || ' co ' ELSE segment || '  Co' END, '\s+', ' ', 'g')) AS item FROM e),
b AS (SELECT site, lower(item) AS key, arg_max({{'item': item, 'u': url}}, {{'s': score, 'q': -seq}}) AS b, min(seq) AS first FROM i GROUP BY ALL),
l AS (SELECT site, array_to_string(list(b.item ORDER BY first), ', ') AS v, arg_min(b.u, first) AS u FROM b GROUP BY site)
SELECT site::VARCHAR AS site, '- Industry: ' || k.value || '   [from ' || k.url || ']' || chr(10) || '- Who buys from you: ' || l.v || '   [from ' || l.u || ']' AS facts FROM k JOIN l USING (site) WHERE k.place = 1""")
def known_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each nation's site, as lines for a model."""
    origins = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("site"), F.lit("https://x.com/").alias("origin"))
    return presenters.fact_lines(presenters.facts(documents.collect(nation_claims(spark, sf_dir)), origins))


@query("""
WITH p AS (SELECT p_brand AS site, p_partkey, p_type, p_name, p_size, p_retailprice FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY p_partkey) - 1 AS k FROM p)
SELECT site, unnest(['people', 'offerings', 'proof.aggregateRatings']) AS path, k::INT AS position, unnest([p_name, p_name, 'R' || p_partkey]) AS title, unnest([p_type, NULL, (p_size % 10) // 2 || CASE WHEN p_size % 2 = 1 THEN '.5' ELSE '' END || ' out of 5']) AS subtitle,
  unnest([CASE WHEN p_partkey % 3 = 0 THEN 'Team lead' ELSE '' END, 'Service', '']) AS tags, unnest([CASE WHEN p_partkey % 2 = 0 THEN 'Email: e' || p_partkey ELSE '' END, 'Includes: a · ' || p_size, 'Reviews: ' || p_partkey]) AS details FROM n""")
def record_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records of their brand's fields, shown as cards."""
    key, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    bodies = {
        "people": F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("title"), F.when(key % 3 == 0, "team-lead").otherwise("unknown").alias("role"), F.when(key % 2 == 0, F.concat(F.lit("e"), key.cast("string"))).alias("email")),
        "offerings": F.struct(F.col("p_name").alias("name"), F.lit("service").alias("category"), F.array(F.lit("a"), F.col("p_size").cast("string")).alias("features")),
        "proof.aggregateRatings": F.struct(F.concat(F.lit("R"), key.cast("string")).alias("platform"), (F.col("p_size") % 10 / 2).alias("ratingValue"), key.alias("reviewCount")),
    }
    each = part.select("p_brand", key, F.inline(F.array(*[F.struct(F.lit(p).alias("path"), F.to_json(b).alias("r")) for p, b in bodies.items()])))
    listed = each.groupBy(F.col("p_brand").alias("site"), "path").agg(documents.objects(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "r"))), lambda x: x["r"])).alias("value"))
    shown = presenters.cards(listed)
    return shown.select("site", "path", "position", "title", "subtitle", F.array_join("tags", "|").alias("tags"), F.array_join(F.transform("details", lambda d: F.concat_ws(": ", d["label"], d["value"])), "|").alias("details"))
