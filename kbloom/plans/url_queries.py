"""URL, link and crawl queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbloom.functions import urls
from kbloom.operators import crawl
from kbloom.plans.registry import literal, query, table

_LIST = lambda xs: "(" + ", ".join(map(literal, xs)) + ")"


# --- the same expressions in DuckDB's SQL ---


def sql_host(url: str) -> str:
    raw = rf"regexp_replace(regexp_replace(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')"
    return rf"nullif(regexp_replace(lower({raw}), '^www\.', ''), '')"


def sql_path(url: str) -> str:
    return rf"coalesce(nullif(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1), ''), '/')"


def sql_query(url: str) -> str:
    return rf"regexp_extract({url}, '^[^?#]*\?([^#]*)', 1)"


def sql_normal(url: str) -> str:
    host, path = sql_host(url), f"coalesce(nullif(regexp_replace({sql_path(url)}, '/+$', ''), ''), '/')"
    kept = f"list_filter(string_split({sql_query(url)}, '&'), lambda p: regexp_matches(p, '^[^=]*=.+') AND lower(string_split(p, '=')[1]) NOT IN {_LIST(urls.TRACKING)})"
    query_ = f"array_to_string(list_transform(list_sort(list_transform({kept}, lambda p, i: {{'k': string_split(p, '=')[1], 'i': i, 'p': p}})), lambda s: s.p), '&')"
    return f"lower(regexp_extract({url}, '^([a-zA-Z]+)://', 1)) || '://' || {host} || {path} || CASE WHEN {query_} = '' THEN '' ELSE '?' || {query_} END"


def sql_domain(host: str) -> str:
    labels = f"string_split({host}, '.')"
    two, three = f"array_to_string(({labels})[-2:], '.')", f"array_to_string(({labels})[-3:], '.')"
    return f"CASE WHEN len({labels}) > 2 AND {two} IN {_LIST(urls.TWO_LABEL_SUFFIXES)} THEN {three} ELSE {two} END"


def sql_class(url: str, what: str, anchor: str | None = None) -> str:
    """One field of the page class: role, priority or confidence."""
    path = f"lower({sql_path(url)})"
    pick = lambda role, priority, confidence: {"role": literal(role), "priority": str(priority), "confidence": f"{confidence}::DOUBLE"}[what]
    out = [f"WHEN {sql_host(url)} IS NULL THEN {pick('other', 0, 0.0)}", f"WHEN {path} = '/' THEN {pick('home', 100, 1.0)}", f"WHEN regexp_matches({path}, {literal(urls.LEGAL)}) THEN {pick('legal', 10, 0.85)}"]
    by_role = {}
    for role, priority, patterns in urls.ROLE_RULES:
        by_role[role] = priority
        out.append(f"WHEN regexp_matches({path}, {literal('|'.join(patterns))}) THEN {pick(role, priority, 0.9)}")
    if anchor:
        out += [f"WHEN coalesce(regexp_matches(lower({anchor}), {literal(p)}), false) THEN {pick(r, by_role[r] - 5, 0.5)}" for p, r in urls.ANCHOR_HINTS]
    depth = f"len(list_filter(string_split({path}, '/'), lambda s: s <> ''))"
    last = {"role": "'other'", "priority": f"CASE WHEN {depth} <= 1 THEN 45 ELSE 40 - {depth} END", "confidence": "0.2::DOUBLE"}[what]
    return f"CASE {' '.join(out)} ELSE {last} END"


@query(f"SELECT page_id, {sql_normal('url')} AS normalized FROM pages")
def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normalized"))


@query(f"SELECT page_id, {sql_domain(sql_host('url'))} AS domain FROM pages")
def registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.registrable_domain(urls.host_of(F.col("url"))).alias("domain"))


_SLUG = rf"lower(regexp_replace(regexp_replace({sql_path('url')} || CASE WHEN {sql_query('url')} = '' THEN '' ELSE '?' || {sql_query('url')} END, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'))"


@query(f"SELECT page_id, substr(coalesce(nullif({_SLUG}, ''), 'index'), 1, 80) AS slug, regexp_replace({sql_domain(sql_host('url'))}, '[^a-z0-9]+', '-', 'g') AS site FROM pages")
def page_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.page_slug(url).alias("slug"), urls.site_slug(url).alias("site"))


@query(f"SELECT page_id, NOT regexp_matches(lower({sql_path('url')}), {literal(urls.NOT_A_PAGE)}) AS html_like FROM pages")
def html_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.html_like(F.col("url")).alias("html_like"))


_LABEL = rf"trim(regexp_replace(regexp_replace(list_filter(string_split({sql_path('url')}, '/'), lambda s: s <> '')[-1], '\.[A-Za-z0-9_]+$', ''), '[-_]+', ' ', 'g'))"


@query(f"SELECT page_id, CASE WHEN coalesce({_LABEL}, '') = '' THEN 'the home page' ELSE 'the ' || upper(substr({_LABEL}, 1, 1)) || substr({_LABEL}, 2) || ' page' END AS label FROM pages")
def page_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.page_label(F.col("url")).alias("label"))


#: Paths and anchors that reach every role.
PATHS = [
    "", "/", "/about-us/", "/x/our-story", "/services/drilling", "/contact", "/shop/1", "/team/jo", "/en/staff-bios", "/reviews", "/pricing",
    "/faq", "/blog/", "/blog/a-post", "/2024/05/news", "/help/privacy-policy", "/well-drilling", "/a/b/c", "/p/1", "/p/2", "/Legal/x",
]
ANCHORS = ["", "About us", "Our Services", "Contact", "Staffing", "Meet the team", "Read reviews", "Get a quote", "FAQ", "News and articles", "Other"]
_MAPPED = f"SELECT s_suppkey, 'https://www.site' || (s_suppkey % 7) || '.com' || ({_LIST(PATHS).replace('(', '[', 1)[:-1]}])[1 + s_suppkey % {len(PATHS)}] AS url, ({_LIST(ANCHORS).replace('(', '[', 1)[:-1]}])[1 + (s_suppkey // 3) % {len(ANCHORS)}] AS anchor FROM supplier"


def mapped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as links: a URL and an anchor by key."""
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    key = F.col("s_suppkey")
    url = F.concat(F.lit("https://www.site"), (key % 7).cast("string"), F.lit(".com"), pick(PATHS, key))
    return table(spark, sf_dir, "supplier").select("s_suppkey", url.alias("url"), pick(ANCHORS, F.floor(key / 3)).alias("anchor"))


@query(f"WITH l AS ({_MAPPED}) SELECT s_suppkey, {sql_class('url', 'role', 'anchor')} AS role, ({sql_class('url', 'priority', 'anchor')})::INT AS priority, {sql_class('url', 'confidence', 'anchor')} AS confidence FROM l")
def classify_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped_links(spark, sf_dir).withColumn("c", urls.classify(F.col("url"), F.col("anchor"))).select("s_suppkey", "c.role", "c.priority", "c.confidence")


# --- links and crawling ---

#: Anchors of well-formed pages, in document order; all of them are in menus.
_ANCHORS = rf"""
a AS (SELECT page_id, url AS page, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS anchor,
             generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1), 1) - 1 AS pos FROM pages),
r AS (SELECT page_id, page, anchor, pos, regexp_extract(page, '^[a-zA-Z]+://[^/?#]*') || href AS target FROM a),
k AS (SELECT page_id, page, {sql_normal('target')} AS url, anchor, pos FROM r),
l AS (SELECT page_id, page, url, anchor, pos, 15 AS bonus FROM k WHERE NOT regexp_matches(lower({sql_path('url')}), {literal(urls.NOT_A_PAGE)})
      QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY length(anchor) DESC, pos) = 1)"""


@query(f"WITH {_ANCHORS} SELECT page_id, url, anchor, bonus::INT AS bonus FROM l")
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.links(table(spark, sf_dir, "pages")).select("page_id", "url", "anchor", "bonus")


@query(f"WITH {_ANCHORS} SELECT page_id, count(*) AS n_links FROM l WHERE {sql_domain(sql_host('url'))} = {sql_domain(sql_host('page'))} GROUP BY page_id")
def same_site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crawl.links(table(spark, sf_dir, "pages"))
    return found.where(urls.same_site(F.col("url"), F.col("page_url"))).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))


_SEEDS = f"""
WITH {_ANCHORS}, f AS (
  SELECT {sql_host('page')} AS site, url, ({sql_class('url', 'priority', 'anchor')} + bonus)::INT AS priority, page_id, pos FROM l),
u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY page_id, pos) = 1),
v AS (SELECT {sql_host('url')} AS site, {sql_normal('url')} AS url FROM pages)
SELECT site, url, priority, row_number() OVER (PARTITION BY site ORDER BY priority DESC, page_id, pos)::INT AS rank
FROM u ANTI JOIN v USING (site, url) QUALIFY row_number() OVER (PARTITION BY site ORDER BY priority DESC, page_id, pos) <= {crawl.BUDGET}"""


@query(_SEEDS)
def crawl_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next pages to fetch of each host: best priority, earliest found."""
    pages = table(spark, sf_dir, "pages")
    found = crawl.links(pages).withColumn("site", urls.host_of(F.col("page_url")))
    seen = pages.select(urls.host_of(F.col("url")).alias("site"), urls.normalize_url(F.col("url")).alias("url"))
    return crawl.frontier(found, seen).select("site", "url", "priority", "rank")


def crawled(spark: SparkSession, sf_dir: str) -> crawl.Crawl:
    """Every host crawled from its first page, with all its pages in the sitemap."""
    pages = table(spark, sf_dir, "pages")
    named = pages.select("page_id", urls.normalize_url(F.col("url")).alias("url"), urls.host_of(F.col("url")).alias("site")).where("url is not null")
    seeds = named.groupBy("site").agg(F.min_by("url", "page_id").alias("url"))
    web = named.select("url", F.col("url").alias("landed"), "page_id")
    listed = named.select("site", "url", F.col("page_id").alias("pos"))
    return crawl.walk(spark, seeds, web, crawl.links(pages), listed)


@query()
def crawl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that a crawl of each host reads, in order; links of read pages are followed."""
    return crawled(spark, sf_dir).pages()


@query()
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the crawl of each host found, asked for and left over."""
    return crawled(spark, sf_dir).summary()


@query(f"SELECT page_id, {sql_normal('url')} AS landed FROM pages QUALIFY row_number() OVER (PARTITION BY {sql_normal('url')} ORDER BY page_id) = 1")
def landed_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that were the first to land on their URL."""
    landed = table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("landed"))
    return landed.groupBy("landed").agg(F.min("page_id").alias("page_id")).select("page_id", "landed")


_HOSTS = "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN (s_suppkey * 37 % 256) || '.' || (s_suppkey * 11 % 256) || '.' || (s_suppkey % 256) || '.' || (s_suppkey * 3 % 256) WHEN 1 THEN '192.168.' || (s_suppkey % 300) || '.1' WHEN 2 THEN 'host' || s_suppkey || '.local' WHEN 3 THEN 'www.site' || s_suppkey || '.com' ELSE 'site' || s_suppkey END AS host FROM supplier"


def mapped_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.expr("""CASE s_suppkey % 5 WHEN 0 THEN concat_ws('.', s_suppkey * 37 % 256, s_suppkey * 11 % 256, s_suppkey % 256, s_suppkey * 3 % 256)
                  WHEN 1 THEN concat('192.168.', s_suppkey % 300, '.1') WHEN 2 THEN concat('host', s_suppkey, '.local')
                  WHEN 3 THEN concat('www.site', s_suppkey, '.com') ELSE concat('site', s_suppkey) END""").alias("host"),
    )


_BOUNDS = ", ".join(f"({a}, {b})" for a, b in map(urls.v4_bounds, urls.PRIVATE_V4))


@query(f"""
WITH h AS ({_HOSTS}), n AS (
  SELECT s_suppkey, host, CASE WHEN regexp_matches(host, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') THEN list_transform(string_split(host, '.'), lambda x: x::BIGINT) END AS o FROM h),
v AS (SELECT s_suppkey, host, CASE WHEN list_max(o) <= 255 THEN o[1] * 16777216 + o[2] * 65536 + o[3] * 256 + o[4] END AS ip FROM n)
SELECT s_suppkey, host, (EXISTS (SELECT 1 FROM (VALUES {_BOUNDS}) b(lo, hi) WHERE ip BETWEEN lo AND hi) OR host LIKE '%.local') AS blocked FROM v""")
def ssrf_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped_hosts(spark, sf_dir).select("s_suppkey", "host", urls.blocked_host(F.col("host")).alias("blocked"))


@query(f"""
WITH h AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'http://' WHEN s_suppkey % 3 = 1 THEN 'ftp://' ELSE '' END || host || CASE WHEN s_suppkey % 4 = 0 THEN '.' ELSE '/x' END AS u FROM ({_HOSTS}))
SELECT s_suppkey, (NOT starts_with(u, 'ftp://') AND contains(x, '.') AND length(x) <= 253 AND len(list_filter(string_split(x, '.'), lambda l: length(l) NOT BETWEEN 1 AND 63)) = 0) AS valid
FROM (SELECT s_suppkey, u, regexp_extract(u, '^(?:[a-z]+://)?([^/?#]*)', 1) AS x FROM h)""")
def website_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    scheme = F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'http://' WHEN 1 THEN 'ftp://' ELSE '' END")
    end = F.expr("CASE WHEN s_suppkey % 4 = 0 THEN '.' ELSE '/x' END")
    return mapped_hosts(spark, sf_dir).select("s_suppkey", urls.website_valid(F.concat(scheme, F.col("host"), end)).alias("valid"))


_PROFILES = ["linkedin.com/company/", "www.facebook.com/", "m.instagram.com/", "twitter.com/", "x.com/a/", "youtube.com/c/", "tiktok.com/@", "pinterest.com/", "yelp.com/biz/", "g.page/", "example.com/", "notlinkedin.com/"]
_PLATFORM = "CASE " + " ".join(f"WHEN regexp_matches(host, {literal(p)}) THEN {literal(n)}" for p, n in urls.SOCIAL_HOSTS) + " END"


@query(f"""
WITH u AS (SELECT c_custkey, 'https://' || ([{", ".join(map(literal, _PROFILES))}])[1 + c_custkey % {len(_PROFILES)}] || 'user' || c_custkey || CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '?utm_source=x' END AS url FROM customer),
n AS (SELECT c_custkey, {sql_normal('url')} AS url, {sql_host('url')} AS host FROM u)
SELECT c_custkey, {_PLATFORM} AS platform, url, string_split(url, '/')[-1] AS handle FROM n WHERE {_PLATFORM} IS NOT NULL AND NOT ends_with(host, 'g.page')""")
def social_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    base = F.element_at(F.array(*map(F.lit, _PROFILES)), (key % len(_PROFILES) + 1).cast("int"))
    url = F.concat(F.lit("https://"), base, F.lit("user"), key.cast("string"), F.when(key % 2 == 0, "/").otherwise("?utm_source=x"))
    normal = table(spark, sf_dir, "customer").select("c_custkey", urls.normalize_url(url).alias("url"))
    # a generator leaves out the other links; a filter would work out each profile a second time
    return normal.select("c_custkey", F.inline(F.array_compact(F.array(urls.social_profile(F.col("url"), F.lit("g.page"))))))


_RANKED = ["robots-disallow", "bot-challenge", "redirect-offsite", "non-html", "js-rendered", "fetch-failed", "empty-body"]
_CODES = [*_RANKED[::-1], "widget-detected", "budget-exceeded"]


@query(f"""
WITH w AS (SELECT user_id, event_id, ([{", ".join(map(literal, _CODES))}])[1 + (event_id * 7 + user_id) % {len(_CODES)}] AS code FROM events WHERE event_type = 'error')
SELECT user_id, arg_min(code, coalesce(list_position([{", ".join(map(literal, _RANKED))}], code), 99) ::BIGINT * 100000000 + event_id) AS code,
       min(coalesce(list_position([{", ".join(map(literal, _RANKED))}], code), 99))::INT AS rank FROM w GROUP BY user_id""")
def failure_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warning that explains a failed run best: by rank, then the first."""
    code = F.element_at(F.array(*map(F.lit, _CODES)), ((F.col("event_id") * 7 + F.col("user_id")) % len(_CODES) + 1).cast("int"))
    warnings = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "event_id", code.alias("code"))
    return crawl.failure(warnings, "user_id", "event_id", _RANKED).select("user_id", "code", "rank")
