"""Version, store, scoring and progress queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbloom.operators import scoring, store, versions
from kbloom.plans.record_queries import pick
from kbloom.plans.registry import literal, query, table
from kbloom.sources import scratch
from kbloom.streaming import progress

_ARRAY = lambda xs: "[" + ", ".join(map(literal, xs)) + "]"
SQL_VERSIONS = "vs AS (SELECT o_custkey AS doc, o_orderkey, o_orderdate, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS version FROM orders)"


def saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as versions of their customer's document."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    return versions.numbered(rows, "doc", "o_orderdate", "o_orderkey")


@query(f"WITH {SQL_VERSIONS}, b AS (SELECT *, lag(o_orderdate) OVER (PARTITION BY doc ORDER BY version) AS p FROM vs) SELECT doc, version, coalesce(p IS NOT NULL AND o_orderdate <> p, false) AS rescraped FROM b")
def version_rescrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.rescraped(saves(spark, sf_dir), "doc", "o_orderdate").select("doc", "version", F.coalesce("rescraped", F.lit(False)).alias("rescraped"))


@query(f"WITH {SQL_VERSIONS} SELECT doc, max(version) AS version, arg_max(o_orderkey, version) AS o_orderkey, arg_max(o_orderstatus, version) AS o_orderstatus FROM vs GROUP BY doc")
def current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.current(saves(spark, sf_dir), "doc", "o_orderkey", "o_orderstatus")


@query("""
WITH h AS (SELECT o_custkey AS doc, count(*) AS last FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1)
SELECT o.o_custkey AS doc, o.o_orderkey, (coalesce(last, 0) + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_orderdate, o_orderkey))::INT AS version FROM orders o LEFT JOIN h ON h.doc = o.o_custkey WHERE o_orderdate >= TIMESTAMP '2000-01-01'""")
def version_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey", "o_orderdate")
    held = versions.numbered(rows.where("o_orderdate < timestamp_ntz'2000-01-01 00:00:00'"), "doc", "o_orderdate", "o_orderkey")
    return versions.allocate(held, rows.where("o_orderdate >= timestamp_ntz'2000-01-01 00:00:00'"), "doc", "o_orderdate", "o_orderkey").select("doc", "o_orderkey", "version")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as saved documents of their customers."""
    body = F.to_json(F.struct("o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.lit("org").alias("org"), F.col("o_custkey").cast("string").alias("doc"), F.col("o_orderdate").alias("saved_at"), body.alias("document"))


def _saved(spark: SparkSession, sf_dir: str) -> tuple[store.Store, DataFrame]:
    """A store with the orders of two saves, and between them the removal of some customers."""
    held = store.Store(spark, scratch.Tables(spark, "store").base)
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    held.save(_orders(spark, sf_dir).where(F.col("saved_at") < cut))
    gone = held.remove(table(spark, sf_dir, "customer").where("c_custkey % 10 = 3").select(F.lit("org").alias("org"), F.col("c_custkey").cast("string").alias("doc")))
    held.save(_orders(spark, sf_dir).where(F.col("saved_at") >= cut))
    return held, gone


@query("""
WITH o AS (SELECT o_custkey::VARCHAR AS doc, o_orderkey, o_orderdate, o_orderdate < TIMESTAMP '2000-01-01' AS early FROM orders)
SELECT doc, o_orderkey, row_number() OVER (PARTITION BY doc ORDER BY o_orderdate, '{"o_orderkey":' || o_orderkey || '}')::INT AS version FROM o WHERE NOT (early AND doc::BIGINT % 10 = 3)""")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions in a store after two saves and a removal; a removed document that returns starts at 1."""
    held, _ = _saved(spark, sf_dir)
    return held.versions().select("doc", F.get_json_object("document", "$.o_orderkey").cast("long").alias("o_orderkey"), "version")


@query("SELECT c_custkey::VARCHAR AS doc, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01') AS existed FROM customer WHERE c_custkey % 10 = 3")
def store_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents asked to be removed, and whether they were there."""
    return _saved(spark, sf_dir)[1].select("doc", "existed")


_LAST_TWO = f"""{SQL_VERSIONS},
m AS (SELECT doc, max(version) AS top FROM vs GROUP BY doc HAVING max(version) >= 2),
li AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag || l_linestatus || floor(l_quantity / 10)::INT)) AS ln FROM lineitem GROUP BY 1),
f AS (SELECT vs.doc, version = top AS is_new, unnest(['status', 'priority', 'lines']) AS path, unnest([[o_orderstatus], CASE WHEN o_orderpriority <> '5-LOW' THEN [o_orderpriority] ELSE [] END, coalesce(ln, [])]) AS lines
      FROM vs JOIN m USING (doc) LEFT JOIN li ON l_orderkey = o_orderkey WHERE version >= top - 1),
d AS (SELECT doc, path, o.lines AS old, n.lines AS "new", CASE WHEN len(o.lines) = 0 AND len(n.lines) = 0 THEN 'unchanged' WHEN len(o.lines) = 0 THEN 'added' WHEN len(n.lines) = 0 THEN 'removed' WHEN o.lines = n.lines THEN 'unchanged' ELSE 'changed' END AS kind
      FROM (SELECT * FROM f WHERE NOT is_new) o JOIN (SELECT * FROM f WHERE is_new) n USING (doc, path))"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two versions of each document, field by field."""
    held = saves(spark, sf_dir)
    top = held.groupBy("doc").agg(F.max("version").alias("top")).where("top >= 2")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus", F.floor(F.col("l_quantity") / 10).cast("int").cast("string")).alias("x")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("x")).alias("ln"))
    both = held.join(top, "doc").where("version >= top - 1").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    none = F.array().cast("array<string>")
    fields = F.array(
        F.struct(F.lit("status").alias("path"), F.array("o_orderstatus").alias("lines")),
        F.struct(F.lit("priority").alias("path"), F.when(F.col("o_orderpriority") != "5-LOW", F.array("o_orderpriority")).otherwise(none).alias("lines")),
        F.struct(F.lit("lines").alias("path"), F.coalesce("ln", none).alias("lines")),
    )
    each = both.select("doc", (F.col("version") == F.col("top")).alias("is_new"), F.inline(fields))
    return versions.diff(each.where("not is_new"), each.where("is_new"))


@query(f"WITH {_LAST_TWO} SELECT doc, path, kind, array_to_string(old, '|') AS before, array_to_string(\"new\", '|') AS after FROM d")
def field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).select("doc", "path", "kind", F.array_join("old", "|").alias("before"), F.array_join("new", "|").alias("after"))


@query(f"WITH {_LAST_TWO} SELECT doc, count_if(kind = 'added')::BIGINT AS added, count_if(kind = 'removed')::BIGINT AS removed, count_if(kind = 'changed')::BIGINT AS changed, count_if(kind <> 'unchanged')::BIGINT AS total FROM d GROUP BY doc")
def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.counts(changes(spark, sf_dir))


@query(f"""WITH {_LAST_TWO} SELECT doc, x AS text, CASE WHEN list_contains(old, x) THEN 'same' ELSE 'added' END AS status FROM (SELECT doc, old, unnest("new") AS x FROM d WHERE path = 'lines')
UNION ALL SELECT doc, x, 'removed' FROM (SELECT doc, "new", unnest(old) AS x FROM d WHERE path = 'lines') WHERE NOT list_contains("new", x)""")
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir).where("path = 'lines'")
    return rows.select("doc", F.inline(versions.line_diff(F.col("old"), F.col("new"))))


@query(f"WITH {_LAST_TWO} SELECT doc, path, array_to_string(CASE WHEN path IN ('status', 'lines') THEN \"new\" ELSE old END, '|') AS lines FROM d")
def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.apply(changes(spark, sf_dir), ["status", "lines"]).select("doc", "path", F.array_join("lines", "|").alias("lines"))


@query("""
WITH l AS (SELECT user_id AS doc, event_id % 5 AS field, event_id AS seq, CASE WHEN event_type = 'error' THEN 'revert' ELSE 'set' END AS action, event_type || event_id AS value FROM events),
r AS (SELECT doc, field, max(seq) AS cleared FROM l WHERE action = 'revert' GROUP BY ALL)
SELECT doc, field, arg_max(value, seq) AS value, count(*) AS edits FROM l LEFT JOIN r USING (doc, field) WHERE action = 'set' AND (cleared IS NULL OR seq > cleared) GROUP BY doc, field""")
def edit_log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc"), (key % 5).alias("field"), key.alias("seq"), F.when(F.col("event_type") == "error", "revert").otherwise("set").alias("action"), F.concat("event_type", key.cast("string")).alias("value")
    )
    return versions.fold_edits(log)


# --- the store's views ---


@query("""
WITH k AS (SELECT c_custkey AS doc, c_nationkey AS company FROM customer), c AS (SELECT n_nationkey AS company, n_name AS name FROM nation),
v AS (SELECT o_custkey AS doc, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS version_id FROM orders GROUP BY 1),
w AS (SELECT doc, version_id, CASE WHEN version_id % 3 = 0 THEN 'Company ' || version_id END AS company_name, (version_id % 100) / 100.0::DOUBLE AS completeness FROM v),
lg AS (SELECT l_orderkey AS version_id, arg_min('logo' || l_partkey, l_linenumber * 100000000::BIGINT + l_partkey) AS logo_url FROM lineitem WHERE l_linenumber > 1 GROUP BY 1),
ad AS (SELECT l_orderkey AS version_id, arg_min('City' || l_suppkey, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END * 10000000000000 + l_linenumber * 100000000::BIGINT + l_suppkey) AS location FROM lineitem GROUP BY 1),
n1 AS (SELECT l_orderkey AS version_id, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), n2 AS (SELECT l_orderkey AS version_id, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY 1)
SELECT k.doc, w.version_id, coalesce(company_name, name) AS company_name, completeness, logo_url, location, coalesce(n1.n, 0) AS people_count, coalesce(n2.n, 0) AS offerings_count
FROM k JOIN c USING (company) LEFT JOIN w USING (doc) LEFT JOIN lg USING (version_id) LEFT JOIN ad USING (version_id) LEFT JOIN n1 USING (version_id) LEFT JOIN n2 USING (version_id)""")
def summary_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "version_id")
    current = orders.groupBy(F.col("o_custkey").alias("doc")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("version_id"))
    key = F.col("version_id")
    current = current.select("doc", "version_id", F.when(key % 3 == 0, F.concat(F.lit("Company "), key.cast("string"))).alias("company_name"), (key % 100 / F.lit(100.0)).alias("completeness"))
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.col("c_nationkey").alias("company"))
    companies = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("company"), F.col("n_name").alias("name"))
    logos = items.where("l_linenumber > 1").select("version_id", F.struct("l_linenumber", "l_partkey").alias("position"), F.concat(F.lit("logo"), F.col("l_partkey").cast("string")).alias("url"))
    addresses = items.select("version_id", (F.col("l_returnflag") == "R").alias("is_main"), F.struct("l_linenumber", "l_suppkey").alias("position"), F.concat(F.lit("City"), F.col("l_suppkey").cast("string")).alias("line"))
    parts = {"people_count": items.where("l_linestatus = 'O'"), "offerings_count": items.where("l_discount > 0.05")}
    out = store.summaries(documents, companies, current, logos, addresses, parts)
    return out.select("doc", "version_id", "company_name", "completeness", "logo_url", "location", "people_count", "offerings_count")


_PROVENANCE = ["scraped", "ai-live", "user-edited", "derived", "ai-mock"]


@query(f"""WITH {SQL_VERSIONS}, c AS (SELECT doc, max(version) AS version FROM vs GROUP BY doc),
f AS (SELECT doc, version, o_orderkey, ({_ARRAY(_PROVENANCE)})[1 + o_orderkey % 5] AS method, CASE WHEN o_orderkey % 11 = 0 THEN 'n' END AS note, (o_orderkey % 10) / 10.0::DOUBLE AS confidence FROM vs)
SELECT doc, version, method, note, confidence FROM f SEMI JOIN c USING (doc, version) WHERE method IN ('ai-live', 'ai-mock') OR note IS NOT NULL OR confidence < 0.5""")
def attention_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, key = saves(spark, sf_dir), F.col("o_orderkey")
    rows = held.select("doc", "version", pick(_PROVENANCE, key).alias("method"), F.when(key % 11 == 0, "n").alias("note"), (key % 10 / F.lit(10.0)).alias("confidence"))
    return store.attention(rows, held.groupBy("doc").agg(F.max("version").alias("version")))


@query("SELECT c_nationkey AS org, lower(trim(CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_mktsegment || '.COM' ELSE c_mktsegment || '.com ' END)) AS domain, arg_min(c_name, c_custkey) AS name, count(*) AS seen FROM customer GROUP BY 1, 2")
def resolve_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(".COM"))).otherwise(F.concat("c_mktsegment", F.lit(".com ")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("org"), domain.alias("domain"), F.col("c_name").alias("name"), F.col("c_custkey").alias("seq"))
    return store.resolve_company(rows)


@query("SELECT o_orderkey, o_orderkey % 25 AS org, c_nationkey::BIGINT AS parent_org FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 25 IS DISTINCT FROM c_nationkey")
def tenant_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 25).alias("org"), F.col("o_custkey").alias("c_custkey"))
    parents = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("org"))
    return store.strangers(children, parents, "c_custkey").select("o_orderkey", "org", "parent_org")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 40 = 3 AND s_suppkey % 3 <> 0)")
def rls_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that user 3 may edit; suppliers stand in for memberships."""
    key = F.col("s_suppkey")
    members = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("org"), (key % 40).alias("user"), F.when(key % 3 == 0, "viewer").otherwise("editor").alias("role"))
    rows = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "org")
    return store.visible(rows, members, 3, ("owner", "admin", "editor")).select("c_custkey", "c_name")


@query(r"""
WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN ' !! ' ELSE p_name || ' & ' || p_type END AS name FROM part),
r AS (SELECT p_partkey, substr(coalesce(nullif(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'workspace'), 1, 40) AS root FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY p_partkey) - 1 AS k FROM r)
SELECT p_partkey, CASE WHEN k = 0 THEN root ELSE root || '-' || k END AS slug FROM k""")
def org_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    names = table(spark, sf_dir, "part").select(key.alias("id"), F.when(key % 50 == 0, " !! ").otherwise(F.concat_ws(" & ", "p_name", "p_type")).alias("name"))
    return store.slugs(names).select(F.col("id").alias("p_partkey"), "slug")


# --- scoring ---

_TOKENS = "list_distinct(list_filter(string_split({}, ' '), lambda t: length(t) > 1 AND t NOT IN (" + ", ".join(map(literal, scoring.IGNORED)) + ")))"
_NORMAL = "trim(regexp_replace(regexp_replace(lower({}), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_PAIRS = f"""
e AS (SELECT p_partkey AS k, p_brand, p_size, {_NORMAL.format("p_name || ' Services, Inc'")} AS x FROM part WHERE p_partkey % 2 = 0),
g AS (SELECT p_partkey AS k, p_brand, p_size, {_NORMAL.format("'The ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' co' ELSE '''s' END")} AS x FROM part WHERE p_partkey % 2 = 1),
p AS (SELECT e.p_brand, e.k AS expected, g.k AS produced, e.x AS a, g.x AS b, {_TOKENS.format('e.x')} AS s, {_TOKENS.format('g.x')} AS t FROM e JOIN g USING (p_brand, p_size)),
h AS (SELECT * FROM p WHERE a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a) OR (least(len(s), len(t)) > 0 AND len(list_intersect(s, t)) / least(len(s), len(t)) >= 0.6)))"""


def pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    expected = part.where("p_partkey % 2 = 0").select(key.alias("expected"), "p_brand", "p_size", F.concat("p_name", F.lit(" Services, Inc")).alias("a"))
    produced = part.where("p_partkey % 2 = 1").select(key.alias("produced"), "p_brand", "p_size", F.concat(F.lit("The "), "p_name", F.when(key % 3 == 0, " co").otherwise("'s")).alias("b"))
    return expected, produced


@query(f"WITH {_PAIRS} SELECT p_brand, expected, produced FROM h")
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, produced = pairs(spark, sf_dir)
    names = scoring.fuzzy_names(expected, produced, ["p_brand", "p_size"])
    return expected.join(names, ["p_brand", "p_size", "a"]).join(produced, ["p_brand", "p_size", "b"]).select("p_brand", "expected", "produced")


@query(f"""WITH {_PAIRS}, n AS (SELECT p_brand, count(DISTINCT k) AS expected FROM e GROUP BY 1), o AS (SELECT p_brand, count(*) AS produced FROM g GROUP BY 1), m AS (SELECT p_brand, count(DISTINCT expected) AS matched FROM h GROUP BY 1)
SELECT p_brand AS field, coalesce(matched, 0) AS matched, expected, produced, floor(coalesce(matched, 0) / expected * 1000 + 0.5) / 1000 AS recall FROM n JOIN o USING (p_brand) LEFT JOIN m USING (p_brand)""")
def recall_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, produced = pairs(spark, sf_dir)
    zero = F.lit(0).cast("long")
    # an expected value is found if its name is alike one that was produced; the pairs aren't needed
    found = expected.join(scoring.fuzzy_names(expected, produced, ["p_brand", "p_size"]), ["p_brand", "p_size", "a"], "left_semi")
    hit = found.select("p_brand", "expected").distinct().select(F.col("p_brand").alias("field"), F.lit(1).cast("long").alias("matched"), zero.alias("expected"), zero.alias("produced"))
    want = expected.select(F.col("p_brand").alias("field"), zero.alias("matched"), F.lit(1).cast("long").alias("expected"), zero.alias("produced"))
    have = produced.select(F.col("p_brand").alias("field"), zero.alias("matched"), zero.alias("expected"), F.lit(1).cast("long").alias("produced"))
    return scoring.recall(hit.unionByName(want).unionByName(have))


# --- progress ---

SQL_PROGRESS = """
e AS (SELECT user_id AS run, event_id AS seq, event_type, ['crawl', 'extract', 'enrich'][1 + (event_id // 7) % 3] AS stage, '/' || event_id AS url, event_id % 9 AS n, 'W' || event_id % 8 AS message FROM events),
st AS (SELECT run, arg_max(stage, seq) AS stage, max(seq) AS seq FROM e WHERE event_type = 'signup' GROUP BY run),
dn AS (SELECT run, stage, max(seq) AS last, min(seq) AS first FROM e WHERE event_type = 'purchase' GROUP BY run, stage),
ps AS (SELECT run, url, row_number() OVER (PARTITION BY run ORDER BY seq DESC) AS k FROM e WHERE event_type = 'view')"""


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events as the crawl events of a run."""
    key, kind = F.col("event_id"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), key.alias("seq"), F.when(kind == "view", "page").when(kind == "click", "discovered").when(kind == "error", "warning").otherwise("stage").alias("kind"),
        pick(["crawl", "extract", "enrich"], F.floor(key / 7)).alias("stage"), F.when(kind == "signup", "start").otherwise("done").alias("status"), F.concat(F.lit("/"), key.cast("string")).alias("url"),
        (key % 9).alias("count"), F.concat(F.lit("W"), (key % 8).cast("string")).alias("message"),
    )


@query(f"""WITH {SQL_PROGRESS},
a AS (SELECT st.run, CASE WHEN last IS NULL OR last < st.seq THEN st.stage END AS stage FROM st LEFT JOIN dn ON dn.run = st.run AND dn.stage = st.stage),
c AS (SELECT run, array_to_string(list(stage ORDER BY first), '|') AS completed FROM dn GROUP BY run), p AS (SELECT run, array_to_string(list(url ORDER BY k), '|') AS pages FROM ps WHERE k <= 8 GROUP BY run),
w AS (SELECT run, count(DISTINCT message) AS n FROM e WHERE event_type = 'error' GROUP BY run),
s AS (SELECT run, coalesce(sum(CASE WHEN event_type = 'click' THEN n END), 0)::BIGINT AS discovered, count_if(event_type = 'view')::BIGINT AS fetched FROM e GROUP BY run)
SELECT s.run, a.stage, coalesce(completed, '') AS completed, discovered, fetched, coalesce(pages, '') AS pages, coalesce(w.n, 0) AS n_warnings FROM s LEFT JOIN a USING (run) LEFT JOIN c USING (run) LEFT JOIN p USING (run) LEFT JOIN w USING (run)""")
def progress_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.batch_fold(progress_events(spark, sf_dir))
