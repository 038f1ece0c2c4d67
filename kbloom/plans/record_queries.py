"""Reconciliation, completeness and library queries.

Tables stand in for the records: customers are claims or companies, parts are
offerings, nations are sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbloom.functions import fields
from kbloom.functions import text as T
from kbloom.operators import library, quality, reconcile
from kbloom.plans.registry import literal, query, table
from kbloom.sources.scratch import cutter

NOW = "2001-09-01 00:00:00"
_METHODS, _ROLES = list(fields.METHODS), list(fields.ROLE_WEIGHTS)
_ARRAY = lambda xs: "[" + ", ".join(map(literal, xs)) + "]"
_CASE = lambda key, pairs, kind: "CASE " + " ".join(f"WHEN {key} = {literal(k)} THEN {v}::{kind}" for k, v in pairs) + " END"
_TIER = _CASE("method", [(m, t) for m, (t, _) in fields.METHODS.items()], "INT")
_CONF = _CASE("method", [(m, c) for m, (_, c) in fields.METHODS.items()], "DOUBLE")
_WEIGHT = _CASE("role", fields.ROLE_WEIGHTS.items(), "DOUBLE")

SQL_CLAIMS = f"""
e0 AS (SELECT c_nationkey AS site, c_custkey AS seq, c_mktsegment AS segment, ({_ARRAY(_METHODS)})[1 + c_custkey % 6] AS method, ({_ARRAY(_ROLES)})[1 + c_custkey % 13] AS role,
       'https://s' || c_nationkey || '.com/' || c_custkey % 7 AS url FROM customer),
e1 AS (SELECT *, {_TIER} AS tier, {_CONF} AS confidence FROM e0), e AS (SELECT *, confidence * {_WEIGHT} AS score FROM e1)"""


def pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as claims about the industry of their nation's site."""
    key = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("site"), F.lit("foundation.industry").alias("path"), key.alias("seq"), F.col("c_mktsegment").alias("value"), pick(_METHODS, key).alias("method"), pick(_ROLES, key).alias("role"),
        F.concat(F.lit("https://s"), F.col("c_nationkey").cast("string"), F.lit(".com/"), (key % 7).cast("string")).alias("url"), F.lit(None).cast("string").alias("note"),
    )
    return base.withColumn("confidence", fields.by_key({m: c for m, (_, c) in fields.METHODS.items()}, F.col("method")))


_SCALAR = f"""{SQL_CLAIMS},
t AS (SELECT *, lower(trim(segment)) AS key, max(tier) OVER (PARTITION BY site) AS top FROM e),
s AS (SELECT * FROM t WHERE tier = top),
v AS (SELECT site, key, arg_min(segment, o) AS value, arg_min(method, o) AS method, arg_min(confidence, o) AS confidence, min(o) AS o, min(tier) AS tier FROM (SELECT *, {{'s': -score, 'q': seq}} AS o FROM s) GROUP BY site, key),
u AS (SELECT site, key, url, min({{'s': -score, 'q': seq}}) AS o FROM s GROUP BY ALL),
ul AS (SELECT site, key, array_to_string(list(url ORDER BY o), '|') AS urls, list(url ORDER BY o)[1] AS url FROM u GROUP BY ALL),
k AS (SELECT v.*, urls, url, row_number() OVER (PARTITION BY site ORDER BY o) AS place, count(*) OVER (PARTITION BY site) AS n FROM v JOIN ul USING (site, key))"""


@query(f"""WITH {_SCALAR}, a AS (SELECT site, array_to_string(list(key ORDER BY o), ', ') AS alt FROM k WHERE place > 1 GROUP BY site)
SELECT site, 'foundation.industry' AS path, value, CASE WHEN method = 'computed' THEN 'derived' ELSE 'scraped' END AS method, CASE WHEN n > 1 THEN least(confidence, 0.45::DOUBLE) ELSE confidence END AS confidence, urls,
  CASE WHEN n > 1 THEN 'We found ' || n || ' different values: ' || alt END AS note, n AS n_values FROM k LEFT JOIN a USING (site) WHERE place = 1""")
def reconcile_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.scalars(claims(spark, sf_dir)).drop("candidates")


@query(f"WITH {_SCALAR} SELECT site, 'foundation.industry' AS path, (place - 1)::INT AS place, value, confidence, url FROM k WHERE n > 1")
def reconcile_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.conflicts(claims(spark, sf_dir))


@query(rf"""WITH {SQL_CLAIMS},
i AS (SELECT *, trim(regexp_replace(CASE seq % 3 WHEN 0 THEN lower(segment) WHEN 1 THEN '  ' || segment || ' co ' ELSE segment || '  Co' END, '\s+', ' ', 'g')) AS item FROM e),
b AS (SELECT site, lower(item) AS key, arg_max({{'item': item, 'c': confidence, 'm': method, 't': tier, 'u': url}}, {{'s': score, 'q': -seq}}) AS b, min(seq) AS first FROM i GROUP BY ALL),
l AS (SELECT site, array_to_string(list(b.item ORDER BY first), '|') AS items, arg_min(b.m, {{'t': -b.t, 'f': first}}) AS m, list_sum(list(b.c ORDER BY first)) / count(*) AS c, list(b.u ORDER BY first) AS us FROM b GROUP BY site),
d AS (SELECT site, array_to_string(list_transform(list_filter(us, lambda x, i: list_position(us, x) = i), lambda x: x), '|') AS urls FROM l)
SELECT site, 'market.buyers' AS path, items, CASE WHEN m = 'computed' THEN 'derived' ELSE 'scraped' END AS method, floor(c * 1000.0 + 0.5) / 1000.0 AS confidence, urls FROM l JOIN d USING (site)""")
def reconcile_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.expr("CASE seq % 3 WHEN 0 THEN lower(value) WHEN 1 THEN concat('  ', value, ' co ') ELSE concat(value, '  Co') END")
    return reconcile.lists(claims(spark, sf_dir).withColumn("value", spelled).withColumn("path", F.lit("market.buyers")))


_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\s]', ' ', 'g'), '\b(services?|solutions?|systems?|company|inc|llc)\b', '', 'g'), '\s+', ' ', 'g'))"
_FIRST = "CASE WHEN {a}.{f} IS NULL OR {a}.{f} = '' THEN {b}.{f} ELSE {a}.{f} END"
_WINS = "(x.t > a.t OR (x.t = a.t AND x.s > a.s))"


@query(f"""
WITH p0 AS (SELECT p_brand AS site, {_KEY} AS key, p_partkey AS seq, ({_ARRAY(_METHODS)})[1 + p_partkey % 6] AS method, ({_ARRAY(_ROLES)})[1 + p_partkey % 13] AS role,
  CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '' ELSE p_type || p_partkey END AS description, CASE WHEN p_partkey % 4 = 0 THEN p_retailprice::VARCHAR END AS pricing, 'u' || p_partkey % 5 AS url FROM part),
p1 AS (SELECT *, {_TIER} AS tier, {_CONF} AS confidence FROM p0),
g AS (SELECT site, key, list({{'q': seq, 't': tier, 's': confidence * {_WEIGHT}, 'c': confidence, 'm': method, 'd': description, 'p': pricing}} ORDER BY seq) AS l, count(DISTINCT url) AS n_urls FROM p1 GROUP BY ALL),
r AS (SELECT site, key, n_urls, list_reduce(l, lambda a, x: {{'q': a.q, 't': CASE WHEN {_WINS} THEN x.t ELSE a.t END, 's': CASE WHEN {_WINS} THEN x.s ELSE a.s END, 'c': CASE WHEN {_WINS} THEN x.c ELSE a.c END, 'm': CASE WHEN {_WINS} THEN x.m ELSE a.m END,
  'd': CASE WHEN {_WINS} THEN {_FIRST.format(a='x', b='a', f='d')} ELSE {_FIRST.format(a='a', b='x', f='d')} END, 'p': CASE WHEN {_WINS} THEN {_FIRST.format(a='x', b='a', f='p')} ELSE {_FIRST.format(a='a', b='x', f='p')} END}}) AS r FROM g)
SELECT site, 'offerings' AS path, key, r.d AS description, r.p AS pricing, r.c AS confidence, CASE WHEN r.m = 'computed' THEN 'derived' ELSE 'scraped' END AS method, n_urls FROM r""")
def reconcile_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    base = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("site"), F.lit("offerings").alias("path"), T.offering_key(F.col("p_name")).alias("key"), key.alias("seq"), pick(_METHODS, key).alias("method"), pick(_ROLES, key).alias("role"),
        F.when(key % 3 == 0, F.lit(None)).when(key % 7 == 0, "").otherwise(F.concat("p_type", key.cast("string"))).alias("description"), F.when(key % 4 == 0, F.col("p_retailprice").cast("string")).alias("pricing"),
        F.concat(F.lit("u"), (key % 5).cast("string")).alias("url"),
    )
    rows = base.withColumn("confidence", fields.by_key({m: c for m, (_, c) in fields.METHODS.items()}, F.col("method")))
    return reconcile.fold_records(rows, ["description", "pricing"])


_REVIEW_METHODS = ["scraped", "user-edited", "ai-live", "ai-mock", "derived", "not-found"]


@query(f"""
WITH f AS (SELECT c_custkey, ({_ARRAY(_REVIEW_METHODS)})[1 + c_custkey % 6] AS method, CASE WHEN c_custkey % 5 = 0 THEN 'n' END AS note, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS value, (c_custkey % 10) / 10.0::DOUBLE AS confidence FROM customer)
SELECT c_custkey, CASE WHEN method = 'user-edited' THEN false WHEN method IN ('ai-live', 'ai-mock') THEN true WHEN note IS NOT NULL THEN true ELSE value IS NOT NULL AND confidence < 0.5 END AS needs_review FROM f""")
def needs_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    test = fields.needs_review(pick(_REVIEW_METHODS, key), F.when(key % 5 == 0, "n"), F.when(key % 4 > 0, F.col("c_mktsegment")), (key % 10) / F.lit(10.0))
    return table(spark, sf_dir, "customer").select("c_custkey", test.alias("needs_review"))


# --- completeness ---

_FIELD_ROWS = ", ".join(f"({k}, {literal(p)}, {literal(fields.category(p))}, {i}, {str(a).lower()}, {c}, {literal(g) if g else 'NULL'}, {_ARRAY(s) if s else '[]::VARCHAR[]'})" for k, (p, i, a, c, g, s) in enumerate(fields.FIELDS))
SQL_FILLED = f"fl AS (SELECT n_nationkey AS site, r.*, (n_nationkey * 7 + r.place * 3 + r.impact) % 5 < 3 AS filled FROM nation, (VALUES {_FIELD_ROWS}) r(place, path, category, impact, askable, cost, grp, substitutes))"


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation as a site with every field filled or not."""
    each = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("site"), F.inline(fields.rows()))
    return each.withColumn("filled", (F.col("site") * 7 + F.col("place") * 3 + F.col("impact")) % 5 < 3)


@query(f"WITH {SQL_FILLED} SELECT site, category, floor(sum(CASE WHEN filled THEN impact ELSE 0 END) / sum(impact) * 1000.0 + 0.5) / 1000.0 AS score, count_if(filled)::BIGINT AS filled_fields, count(*) AS total_fields FROM fl GROUP BY site, category")
def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.category_scores(filled(spark, sf_dir))


@query(f"WITH {SQL_FILLED} SELECT site, floor(sum(CASE WHEN filled THEN impact ELSE 0 END) / sum(impact) * 1000.0 + 0.5) / 1000.0 AS score FROM fl WHERE askable GROUP BY site")
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.overall_score(filled(spark, sf_dir))


@query(f"WITH {SQL_FILLED} SELECT site, path, place FROM fl WHERE NOT filled")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing(filled(spark, sf_dir))


@query(f"""
WITH {SQL_FILLED}, kn AS (SELECT site, list(path) AS known FROM fl WHERE filled GROUP BY site),
p AS (SELECT fl.*, impact * CASE WHEN list_has_any(substitutes, coalesce(known, [])) THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END / cost AS priority FROM fl LEFT JOIN kn USING (site) WHERE askable AND NOT filled),
o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY priority DESC, path) AS pl FROM p),
a AS (SELECT site, coalesce(grp, replace(path, '.', '-')) AS id, min(pl) AS first, floor(sum(priority) * 1000.0 + 0.5) / 1000.0 AS priority, array_to_string(list(path ORDER BY pl), '|') AS fills FROM o GROUP BY 1, 2),
c AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY site ORDER BY first) <= 6)
SELECT site, id, fills, priority, row_number() OVER (PARTITION BY site ORDER BY priority DESC, first)::INT AS rank FROM c""")
def followup_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.questions(filled(spark, sf_dir))


# --- the library ---

SQL_SUMMARIES = """
su AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN ' ' ELSE c_name END AS company_name, 'https://www.c' || c_custkey || '.example.com/' AS source_url, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS industry,
  'NATION_' || c_nationkey AS location, (c_custkey * 37 % 101) / 100.0::DOUBLE AS completeness, (c_custkey % 4)::INT AS attention_count, (c_custkey % 3)::INT AS conflict_count, (c_custkey % 9)::INT AS offerings_count,
  coalesce(n, 0) AS people_count, coalesce(u, 0) AS testimonials_count, coalesce(kw, []) AS keywords, a AS created_at, b AS updated_at
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count_if(o_orderpriority = '1-URGENT')::BIGINT AS u, list_sort(list(DISTINCT o_orderpriority)) AS kw, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1) ON o_custkey = c_custkey),
sn AS (SELECT *, coalesce(nullif(trim(company_name), ''), 'c' || id || '.example.com') AS name, lower(concat_ws(' ', nullif(company_name, ''), industry, location, 'c' || id || '.example.com', array_to_string(keywords, ' '))) AS hay FROM su)"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their orders as summaries of companies."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"), F.array_sort(F.collect_set("o_orderpriority")).alias("kw"), F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")
    )
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == key, "left").select(
        key.alias("id"), F.when(key % 10 == 0, " ").otherwise(F.col("c_name")).alias("company_name"), F.format_string("https://www.c%d.example.com/", key).alias("source_url"), F.when(key % 7 > 0, F.col("c_mktsegment")).alias("industry"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("location"), (key * 37 % 101 / F.lit(100.0)).alias("completeness"), (key % 4).cast("int").alias("attention_count"), (key % 3).cast("int").alias("conflict_count"),
        (key % 9).cast("int").alias("offerings_count"), F.coalesce("n", F.lit(0)).alias("people_count"), F.coalesce("u", F.lit(0)).alias("testimonials_count"), F.coalesce("kw", F.array().cast("array<string>")).alias("keywords"),
        F.col("a").alias("created_at"), F.col("b").alias("updated_at"),
    )


@query(f"WITH {SQL_SUMMARIES} SELECT id, name, industry, location, completeness, people_count, offerings_count, testimonials_count, attention_count, conflict_count, array_to_string(keywords, '|') AS keywords, strftime(updated_at, '%Y-%m-%d') AS updated FROM sn")
def kb_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return summaries(spark, sf_dir).select(
        "id", library.display_name(c("company_name"), c("source_url")).alias("name"), "industry", "location", "completeness", "people_count", "offerings_count", "testimonials_count", "attention_count", "conflict_count",
        F.array_join("keywords", "|").alias("keywords"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"),
    )


@query("""
WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'City' || c_nationkey WHEN c_custkey % 3 = 1 THEN ' ' END AS city, CASE WHEN c_custkey % 5 < 2 THEN 'R' || c_nationkey END AS region,
  CASE WHEN c_custkey % 4 > 0 THEN c_custkey || ' Main St' END AS formatted, CASE WHEN c_custkey % 2 = 0 THEN [c_mktsegment] ELSE [] END AS areas FROM customer)
SELECT c_custkey, coalesce(nullif(concat_ws(', ', nullif(trim(city), ''), nullif(trim(region), '')), ''), formatted, areas[1]) AS location FROM a""")
def location_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    nation = F.col("c_nationkey").cast("string")
    city = F.when(key % 3 == 0, F.concat(F.lit("City"), nation)).when(key % 3 == 1, " ")
    areas = F.when(key % 2 == 0, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>"))
    line = library.location_line(city, F.when(key % 5 < 2, F.concat(F.lit("R"), nation)), F.when(key % 4 > 0, F.concat(key.cast("string"), F.lit(" Main St"))), areas)
    return table(spark, sf_dir, "customer").select("c_custkey", line.alias("location"))


@query("""
WITH w AS (SELECT c_custkey, [c_mktsegment, ' ' || lower(c_mktsegment) || ' ', 'NATION_' || c_nationkey, '', 'nation_' || c_nationkey % 5, c_name, NULL] AS l FROM customer),
x AS (SELECT c_custkey, trim(unnest(l)) AS t, generate_subscripts(l, 1) AS i FROM w),
f AS (SELECT * FROM x WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY c_custkey, lower(t) ORDER BY i) = 1)
SELECT c_custkey, array_to_string(list(t ORDER BY i), '|') AS keywords FROM f GROUP BY c_custkey""")
def keyword_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = lambda c: c.cast("string")
    first = F.array("c_mktsegment", F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" ")), F.concat(F.lit("NATION_"), nation(F.col("c_nationkey"))))
    second = F.array(F.lit(""), F.concat(F.lit("nation_"), nation(F.col("c_nationkey") % 5)), F.col("c_name"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(library.keywords(first, second), "|").alias("keywords"))


@query(f"WITH {SQL_SUMMARIES} SELECT id, name FROM sn WHERE contains(hay, 'nation_1') AND contains(hay, 'auto')")
def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = library.filtered(summaries(spark, sf_dir), NOW, search="Nation_1  AUTO")
    return found.select("id", library.display_name(F.col("company_name"), F.col("source_url")).alias("name"))


@query(f"""WITH {SQL_SUMMARIES} SELECT id, completeness FROM sn WHERE coalesce(industry, 'Industry not found') IN ('Industry not found', 'BUILDING') AND completeness >= 0.4 AND completeness <= 0.7
  AND (conflict_count > 0 OR attention_count > 0) AND testimonials_count > 0 AND (epoch_us(TIMESTAMP '2001-09-01') - epoch_us(updated_at)) / 86400000000.0 <= 300""")
def library_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = library.filtered(summaries(spark, sf_dir), NOW, industries=[library.UNKNOWN_INDUSTRY, "BUILDING"], bands=["medium"], review=["conflicts", "attention"], content=["testimonials"], within_days=300)
    return found.select("id", "completeness")


@query(f"WITH {SQL_SUMMARIES} SELECT id, name, completeness, row_number() OVER (ORDER BY completeness DESC, lower(name), name, id)::INT AS place FROM sn")
def library_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's place in the list sorted by completeness.

    The order is dealt in written ranges; a place is the row's place in its range
    after the rows of the ranges before, so no task sorts the whole list.
    """
    name = library.display_name(F.col("company_name"), F.col("source_url"))
    rows = summaries(spark, sf_dir).select("id", name.alias("name"), "completeness").withColumn("low", F.lower("name"))
    order = [F.desc("completeness"), F.asc("low"), F.asc("name"), F.asc("id")]
    ranges = cutter(spark, "sorted")(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    # one row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = ranges.withColumn("k", F.row_number().over(Window.partitionBy("range").orderBy(*order))).join(sizes, "range")
    return placed.select("id", "name", "completeness", (F.col("before") + F.col("k")).cast("int").alias("place"))


@query(f"WITH {SQL_SUMMARIES} SELECT CASE WHEN completeness < 0.4 THEN 'low' WHEN completeness <= 0.7 THEN 'medium' ELSE 'high' END AS band, count(*) AS n FROM su GROUP BY 1")
def band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(spark, sf_dir).groupBy(library.band(F.col("completeness")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_SUMMARIES} SELECT coalesce(industry, 'Industry not found') AS value, count(*) AS n FROM su GROUP BY 1")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.facets(summaries(spark, sf_dir))


@query("""
WITH s AS (SELECT o_orderkey, floor((epoch_us(TIMESTAMP '2001-09-01') - epoch_us(o_orderdate + INTERVAL (o_orderkey % 5000) MINUTE)) / 1000000.0 + 0.5)::BIGINT AS s FROM orders)
SELECT o_orderkey, CASE WHEN s < 60 THEN 'just now' WHEN s // 60 < 60 THEN s // 60 || 'm ago' WHEN s // 3600 < 24 THEN s // 3600 || 'h ago' WHEN s // 86400 = 1 THEN 'yesterday' WHEN s // 86400 < 30 THEN s // 86400 || 'd ago'
  WHEN s // 86400 < 360 THEN s // 86400 // 30 || 'mo ago' ELSE s // 86400 // 30 // 12 || 'y ago' END AS age FROM s""")
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    then = F.timestamp_add("MINUTE", (F.col("o_orderkey") % 5000).cast("int"), F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", library.relative_time(then, NOW).alias("age"))


@query(f"WITH {SQL_SUMMARIES} SELECT id FROM su WHERE list_has_any(keywords, ['1-URGENT', '5-LOW'])")
def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(spark, sf_dir).where(F.arrays_overlap("keywords", F.array(F.lit("1-URGENT"), F.lit("5-LOW")))).select("id")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%'")
def name_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_name").ilike("%RING%")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#4'")
def category_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_type = 'ECONOMY' and p_brand = 'Brand#4'").select("p_partkey", "p_name", "p_brand")


@query("SELECT user_id, max(ts) < TIMESTAMP '2024-01-30' AS is_stale FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30'")
def stale_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg((F.max("ts") < F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).alias("is_stale"))
    return last.where("is_stale")


@query(f"""
WITH f AS (SELECT c_nationkey AS org, ({_ARRAY([p for p, *_ in fields.FIELDS])})[1 + c_custkey % {len(fields.FIELDS)}] AS path, ({_ARRAY(_REVIEW_METHODS)})[1 + c_custkey % 6] AS method FROM customer),
g AS (SELECT org, path, count(*) AS n FROM f WHERE method IN ('ai-live', 'ai-mock') GROUP BY ALL)
SELECT org, path, n, row_number() OVER (PARTITION BY org ORDER BY n DESC, path)::INT AS rank FROM g QUALIFY rank <= 20""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("org"), pick([p for p, *_ in fields.FIELDS], key).alias("path"), pick(_REVIEW_METHODS, key).alias("method"))
    return library.review_queue(rows, 20)
