"""Site files, fetch results, claims in text, enrichment and templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbloom.functions import fields
from kbloom.functions import text as T
from kbloom.operators import enrich, store, styles
from kbloom.plans.record_queries import pick
from kbloom.plans.registry import literal, query, table
from kbloom.sources import site_files
from kbloom.sources.scratch import cutter

_ARRAY = lambda xs: "[" + ", ".join(map(literal, xs)) + "]"


@query("SELECT s_suppkey AS site, 'https://s' || s_suppkey || '.io/' || CASE s_suppkey % 3 WHEN 0 THEN 'private/x' ELSE 'open' END AS url, NOT (s_suppkey % 2 = 0 AND s_suppkey % 3 = 0) AS allowed, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 20)::DOUBLE END AS delay, CASE WHEN s_suppkey % 2 = 0 THEN least(greatest(1000.0::DOUBLE, (s_suppkey % 20)::DOUBLE * 1000), 10000.0::DOUBLE) ELSE 1000.0::DOUBLE END AS interval_ms FROM supplier")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    text = F.format_string("User-agent: *\nDisallow: /private/\nCrawl-delay: %d\nSitemap: https://s%d.io/sitemap.xml\n", key % 20, key)
    url = F.concat(F.lit("https://s"), key.cast("string"), F.lit(".io/"), F.when(key % 3 == 0, "private/x").otherwise("open"))
    files = table(spark, sf_dir, "supplier").select(key.alias("site"), F.when(key % 2 == 0, 200).otherwise(404).alias("status"), text.alias("text"), url.alias("url"))
    return site_files.robots(files).select("site", "url", "allowed", "delay", site_files.crawl_interval(F.col("delay")).alias("interval_ms"))


_URLS = "SELECT s_suppkey AS site, unnest(range(s_suppkey % 7)) AS k FROM supplier"


@query(f"""WITH u AS ({_URLS})
SELECT site, 'https://s' || site || '.io/p' || k AS url, CASE WHEN k % 2 = 0 THEN '2024-01-0' || (k + 1) END AS modified, row_number() OVER (PARTITION BY site ORDER BY k)::INT AS place FROM u""")
def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages found through each site's sitemap index."""
    key = F.col("s_suppkey")
    base = F.concat(F.lit("https://s"), key.cast("string"), F.lit(".io"))
    rows = table(spark, sf_dir, "supplier").select(key.alias("site"), base.alias("origin"))
    index = rows.select(F.concat("origin", F.lit("/sitemap.xml")).alias("source"), F.concat(F.lit("<sitemapindex><sitemap><loc>"), "origin", F.lit("/pages.xml</loc></sitemap><sitemap><loc>"), "origin", F.lit("/image-map.xml</loc></sitemap></sitemapindex>")).alias("xml"))
    n = (F.col("site") % 7).cast("int")
    items = F.transform(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda k: k < n), lambda k: F.concat(F.lit("<url><loc> "), F.col("origin"), F.lit("/p"), k.cast("string"), F.lit("/ </loc>"), F.when(k % 2 == 0, F.concat(F.lit("<lastmod>2024-01-0"), (k + 1).cast("string"), F.lit("</lastmod>"))).otherwise(""), F.lit("</url>")))
    extra = F.lit("<url><loc>https://other.com/x</loc></url><url><loc>mailto:a@b</loc></url>")
    sheets = rows.select(F.concat("origin", F.lit("/pages.xml")).alias("source"), F.concat(F.lit("<urlset>"), F.array_join(items, ""), extra, F.lit("</urlset>")).alias("xml"))
    images = rows.select(F.concat("origin", F.lit("/image-map.xml")).alias("source"), F.concat(F.lit("<urlset><url><loc>"), "origin", F.lit("/never</loc></url></urlset>")).alias("xml"))
    start = rows.select("site", "origin", F.concat("origin", F.lit("/sitemap.xml")).alias("source"))
    return site_files.discover(start, index.unionByName(sheets).unionByName(images), cutter(spark, "sitemaps"))


_STATUS = "CASE c_custkey % 8 WHEN 0 THEN 503 WHEN 1 THEN 404 WHEN 2 THEN NULL WHEN 3 THEN 500 ELSE 200 END"


@query(f"""
WITH f AS (SELECT c_custkey, {_STATUS} AS status, CASE WHEN c_custkey % 16 = 0 THEN 'Just a moment...' ELSE 'x' END AS body, CASE WHEN c_custkey % 5 = 0 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS kind, CASE WHEN c_custkey % 9 = 0 THEN 3000000 ELSE 100 END AS b,
  c_custkey % 7 = 4 AS away, c_custkey % 11 = 0 AS own FROM customer),
e AS (SELECT c_custkey, status, CASE WHEN own THEN 'blocked-address' WHEN status IS NULL THEN 'network' WHEN away THEN 'offsite-redirect' WHEN b > 2097152 THEN 'too-large' WHEN status = 503 AND body <> 'x' THEN 'bot-challenge' WHEN status <> 200 THEN 'http-error' WHEN kind LIKE 'application%' THEN 'non-html' END AS error FROM f)
SELECT c_custkey, error, coalesce(error = 'network' OR (error = 'http-error' AND status >= 500), false) AS retryable, CASE error WHEN 'non-html' THEN 'non-html' WHEN 'offsite-redirect' THEN 'redirect-offsite' WHEN 'bot-challenge' THEN 'bot-challenge' ELSE CASE WHEN error IS NOT NULL THEN 'fetch-failed' END END AS warning FROM e""")
def fetch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    url = F.when(key % 11 == 0, "http://10.0.0.1/").otherwise("https://www.site.com/a")
    landed = F.when(key % 7 == 4, "https://elsewhere.net/").when(key % 11 == 0, "http://10.0.0.1/").otherwise("https://blog.site.com/a")
    found = site_files.fetch_outcome(url, landed, F.expr(_STATUS), F.when(key % 5 == 0, "application/pdf").otherwise("text/html; charset=utf-8"), F.when(key % 9 == 0, 3_000_000).otherwise(100), F.when(key % 16 == 0, "Just a moment...").otherwise("x"))
    return table(spark, sf_dir, "customer").select("c_custkey", found.alias("f")).select("c_custkey", "f.error", "f.retryable", site_files.warning_code(F.col("f.error")).alias("warning"))


# --- claims in text ---

_COPY = [
    "We are fully licensed, bonded and insured. 100% Satisfaction Guaranteed!", "Every pump has a 5-year warranty. Bonded crews. CPA on staff, BBB member.", "Our lifetime guarantee is your money-back guarantee; NGWA and LEED certified.",
    "Summer pump special! Proudly serving Austin, Round Rock, and the Hill Country.", "Back to school savings event now. We serve Customers, Dallas & Waco.", "Serving Marble Falls and Marfa since 1990. Winter deal? Chamber of Commerce, EPA-certified.", "Nothing to see here.",
]


def copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as pages with a few lines of advertising."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", pick(_COPY, F.col("s_suppkey")).alias("text"))


_SQL_COPY = f"SELECT s_suppkey, ({_ARRAY(_COPY)})[1 + s_suppkey % {len(_COPY)}] AS text FROM supplier"
_PROMISES = " UNION ALL ".join(f"SELECT s_suppkey, {literal(k)} AS kind, regexp_extract(text, {literal('(?i)' + p)}) AS promise FROM c" for k, p in T.GUARANTEES)


@query(f"WITH c AS ({_SQL_COPY}), g AS (SELECT * FROM ({_PROMISES}) WHERE promise <> ''), b AS (SELECT DISTINCT s_suppkey FROM g WHERE kind <> 'bonding' AND contains(lower(promise), 'bonded')) SELECT * FROM g WHERE kind <> 'bonding' OR s_suppkey NOT IN (SELECT s_suppkey FROM b)")
def guarantees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy(spark, sf_dir).select("s_suppkey", F.inline(T.guarantees(F.col("text")))).withColumnRenamed("text", "promise")


_NAMED = " UNION ALL ".join(f"SELECT s_suppkey, {literal(n)} AS name, {literal(k)} AS kind FROM c WHERE regexp_matches(text, {literal(p)})" for n, k, p in T.CREDENTIALS)


@query(f"WITH c AS ({_SQL_COPY}) {_NAMED}")
def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy(spark, sf_dir).select("s_suppkey", F.inline(T.credentials(F.col("text"))))


@query(f"WITH c AS ({_SQL_COPY}) SELECT s_suppkey, unnest(regexp_extract_all(text, {literal('(?i)' + T.SEASONAL)}, 1)) AS label FROM c")
def seasonal_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy(spark, sf_dir).select("s_suppkey", F.explode(T.found(F.col("text"), T.SEASONAL, 1)).alias("label"))


_PLACES = {3: ["Austin", "Round Rock", "Hill Country"], 4: ["Dallas"], 5: ["Marble Falls"]}


@query("SELECT s_suppkey, unnest(CASE s_suppkey % 7 " + " ".join(f"WHEN {k} THEN {_ARRAY(v)}" for k, v in _PLACES.items()) + " END) AS area FROM supplier")
def service_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.replace("text", F.lit("We serve Customers, Dallas"), F.lit("Fairly serving Customers, Dallas")), F.lit("and Marfa"), F.lit("wells"))
    return copy(spark, sf_dir).select("s_suppkey", F.explode(T.service_areas(text)).alias("area"))


@query("WITH f AS (SELECT s_suppkey AS page_id, ['Font ' || s_suppkey % 9, 'Inter'] AS l FROM supplier) SELECT page_id, (generate_subscripts(l, 1) - 1)::INT AS place, unnest(l) AS family FROM f")
def fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    css = F.format_string(":root{--a:var(--b);--b:'Font %d';--a:no}h1{font-family:var(--a), Arial}p{font-family: \"Font %d\",serif}b{font-family:var(--none)}i{font-family:var(--none, Inter)}", key % 9, key % 9)
    return styles.fonts(table(spark, sf_dir, "supplier").select(key.alias("page_id"), css.alias("css")))


# --- enrichment ---

_HELD = f"""
h AS (SELECT n_nationkey AS doc, path, CASE WHEN (n_nationkey + place) % 3 > 0 THEN 'v' || place END AS value, CASE WHEN (n_nationkey + place) % 3 > 0 THEN 'scraped' ELSE 'not-found' END AS method, CASE WHEN (n_nationkey + place) % 3 > 0 THEN ((n_nationkey * 3 + place) % 10) / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence, place
      FROM nation, (VALUES {", ".join(f"({k}, {literal(p)})" for k, (p, *_) in enumerate(fields.FIELDS))}) f(place, path))"""


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as documents with all fields, some of them filled."""
    each = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc"), F.inline(fields.rows())).select("doc", "place", "path")
    full = (F.col("doc") + F.col("place")) % 3 > 0
    return each.select(
        "doc", "path", F.when(full, F.concat(F.lit("v"), F.col("place").cast("string"))).alias("value"), F.when(full, "scraped").otherwise("not-found").alias("method"),
        F.when(full, (F.col("doc") * 3 + F.col("place")) % 10 / F.lit(10.0)).otherwise(0.0).alias("confidence"), "place",
    )


_GEN = ", ".join(map(literal, enrich.GENERATED))


@query(f"""WITH {_HELD}, m AS (SELECT doc, path, CASE WHEN place % 4 = 0 THEN ' ' ELSE 'made' END AS nv, 0.25::DOUBLE + (doc % 3) * 0.2::DOUBLE AS nc FROM h),
t AS (SELECT h.*, nv, nc, trim(nv) <> '' AND (value IS NULL OR (path IN ({_GEN}) AND confidence < 0.6 AND nc > confidence)) AS taken FROM h JOIN m USING (doc, path))
SELECT doc, path, CASE WHEN taken THEN nv ELSE value END AS value, CASE WHEN taken THEN 'ai-mock' ELSE method END AS method, CASE WHEN taken THEN nc ELSE confidence END AS confidence, taken FROM t""")
def apply_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = held(spark, sf_dir)
    made = rows.select("doc", "path", F.when(F.col("place") % 4 == 0, " ").otherwise("made").alias("value"), (F.lit(0.25) + F.col("doc") % 3 * F.lit(0.2)).alias("confidence"))
    return enrich.apply_generated(rows, made, "ai-mock")


@query("""
WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN [c_mktsegment, 'Homes'] ELSE [] END AS h, [' homes ', lower(c_mktsegment), '', 'New  item', 'new item', c_name] AS m FROM customer),
x AS (SELECT c_custkey, h, trim(regexp_replace(unnest(m), '\\s+', ' ', 'g')) AS t, generate_subscripts(m, 1) AS i FROM l),
a AS (SELECT c_custkey, h, t, i FROM x WHERE t <> '' AND NOT list_contains(list_transform(h, lambda y: lower(y)), lower(t)) QUALIFY row_number() OVER (PARTITION BY c_custkey, lower(t) ORDER BY i) = 1)
SELECT c_custkey, array_to_string(list_concat(any_value(h), list(t ORDER BY i)), '|') AS items FROM a GROUP BY c_custkey""")
def apply_generated_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    have = F.when(F.col("c_custkey") % 3 > 0, F.array(segment, F.lit("Homes"))).otherwise(F.array().cast("array<string>"))
    made = F.array(F.lit(" homes "), F.lower(segment), F.lit(""), F.lit("New  item"), F.lit("new item"), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(enrich.extend_list(have, made), "|").alias("items"))


@query("""
WITH c AS (SELECT p_brand AS doc, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS index, CASE WHEN p_partkey % 3 > 0 THEN '$' || p_size || ',000 and up' END AS pricing, CASE WHEN p_partkey % 4 = 0 THEN 'u' || p_partkey END AS url FROM part),
m AS (SELECT p_brand AS doc, p_partkey AS item, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN '$' || p_size || '000' ELSE 'call' END AS asked, [(p_partkey % 90)::INT, -1, ((p_partkey + 7) % 200)::INT] AS ix FROM part),
n AS (SELECT doc, item, name, asked, unnest(ix) AS index, generate_subscripts(ix, 1) AS pos FROM m),
t AS (SELECT n.*, pricing, url FROM n JOIN c USING (doc, index))
SELECT doc, item, any_value(name) AS name, CASE WHEN bool_or(coalesce(contains(regexp_replace(lower(pricing), '[\\s,]', '', 'g'), regexp_replace(lower(asked), '[\\s,]', '', 'g')) OR contains(regexp_replace(lower(asked), '[\\s,]', '', 'g'), regexp_replace(lower(pricing), '[\\s,]', '', 'g')), false)) THEN any_value(asked)
  ELSE arg_min(pricing, pos) FILTER (WHERE pricing IS NOT NULL) END AS pricing, arg_min(url, pos) FILTER (WHERE url IS NOT NULL) AS url, count(*) AS n_sources FROM t GROUP BY doc, item""")
def consolidate_offerings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    size = F.col("p_size").cast("string")
    index = (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("index")
    candidates = part.select(F.col("p_brand").alias("doc"), index, F.when(key % 3 > 0, F.concat(F.lit("$"), size, F.lit(",000 and up"))).alias("pricing"), F.when(key % 4 == 0, F.concat(F.lit("u"), key.cast("string"))).alias("url"))
    made = part.select(
        F.col("p_brand").alias("doc"), key.alias("item"), F.col("p_name").alias("name"), F.when(key % 2 == 0, F.concat(F.lit("$"), size, F.lit("000"))).otherwise("call").alias("pricing"), F.array((key % 90).cast("int"), F.lit(-1), ((key + 7) % 200).cast("int")).alias("indexes")
    )
    return enrich.consolidate(made, candidates)


@query("""
WITH h AS (SELECT p_brand AS doc, p_name AS key, min(p_partkey) AS seq, arg_min(p_type, p_partkey) AS value FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL),
m AS (SELECT p_brand AS doc, p_name AS key, min(p_partkey) AS seq, arg_min(p_type, p_partkey) AS value FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL)
SELECT doc, key, seq, value, 0.7::DOUBLE AS confidence, false AS made FROM h UNION ALL SELECT doc, key, seq, value, 0.25, true FROM m ANTI JOIN h USING (doc, key)""")
def merge_generated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_name").alias("key"), F.col("p_partkey").alias("seq"), F.col("p_type").alias("value"))
    have = part.where("seq % 2 = 0").groupBy("doc", "key").agg(F.min_by(F.struct("seq", "value"), "seq").alias("r")).select("doc", "key", "r.*", F.lit(0.7).alias("confidence"))
    return enrich.merge_records(have, part.where("seq % 2 = 1").withColumn("confidence", F.lit(0.25)))


_CLR = ", ".join(map(literal, enrich.CLEARED))


@query(f"""WITH {_HELD} SELECT doc, path, CASE WHEN path IN ({_CLR}) THEN NULL WHEN path = 'companyName' THEN CASE WHEN value IS NOT NULL THEN value || ' (template)' ELSE 'Untitled template' END ELSE value END AS value,
  CASE WHEN path IN ({_CLR}) THEN 'not-found' WHEN path = 'companyName' THEN 'user-edited' ELSE method END AS method, CASE WHEN path IN ({_CLR}) THEN 0.0::DOUBLE WHEN path = 'companyName' THEN 1.0::DOUBLE ELSE confidence END AS confidence,
  CASE WHEN path IN ({_CLR}) THEN {literal(enrich.CLEARED_NOTE)} END AS note FROM h""")
def template_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.as_template(held(spark, sf_dir))


# --- projections and jobs ---


@query("""
WITH d AS (SELECT o_custkey AS doc, o_orderkey, list({'name': 'P' || l_partkey, 'role': l_returnflag} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS l FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT doc, o_orderkey AS version, (generate_subscripts(l, 1) - 1)::INT AS position, unnest(l).name AS name, unnest(l).role AS role FROM d""")
def record_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of JSON documents as rows; items stand in for them."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    person = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name"), F.col("l_returnflag").alias("role"))
    people = F.transform(F.array_sort(F.collect_list(person)), lambda x: F.struct(x["name"].alias("name"), x["role"].alias("role")))
    documents = items.groupBy(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("version")).agg(people.alias("people")).select("doc", "version", F.to_json(F.struct("people")).alias("document"))
    return store.project(documents, "people", "name string, role string")


_STATES = ["queued", "crawling", "extracting", "enriching", "done", "failed"]


@query(f"""
WITH l AS (SELECT user_id AS job, ts, event_id, ({_ARRAY(_STATES)})[1 + event_id % 6] AS status FROM events)
SELECT job, arg_max(status, {{'t': ts, 'i': event_id}}) AS status, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0)::BIGINT AS duration_ms, count_if(status = 'failed')::BIGINT AS failures FROM l GROUP BY job""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each job from its appended log."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "ts", "event_id", pick(_STATES, F.col("event_id")).alias("status"))
    each = log.groupBy("job").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.count_if(F.col("status") == "failed").alias("failures"))
    return each.select("job", "status", F.floor(F.timestamp_diff("MICROSECOND", F.col("a"), F.col("b")) / 1000).alias("duration_ms"), "failures")


@query("SELECT p_brand AS site, array_to_string(list(DISTINCT p_type ORDER BY p_type)[1:30], '|') AS categories FROM part GROUP BY p_brand")
def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to thirty categories of a site's posts."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("site")).agg(F.array_join(F.slice(F.array_sort(F.collect_set("p_type")), 1, 30), "|").alias("categories"))


@query(r"""WITH a AS (SELECT s_suppkey, s_suppkey || ' Oak St, Marble Falls, TX 787' || lpad((s_suppkey % 100)::VARCHAR, 2, '0') AS f FROM supplier)
SELECT s_suppkey, s_suppkey || ' Oak St' AS street, 'Marble Falls' AS city, 'TX' AS region, '787' || lpad((s_suppkey % 100)::VARCHAR, 2, '0') AS postal_code FROM a""")
def us_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string("%d Oak St, Marble Falls, TX 787%02d", F.col("s_suppkey"), F.col("s_suppkey") % 100)
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.us_address(line).alias("a")).select("s_suppkey", "a.street", "a.city", "a.region", "a.postal_code")
