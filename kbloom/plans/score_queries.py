"""Queries that score extracted values against expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbloom.operators import documents, scoring
from kbloom.operators.documents import member, obj, objects, quoted
from kbloom.plans.registry import literal, query, table
from kbloom.plans.store_queries import pairs

_N = len(scoring.SCORED)


# --- the same comparisons in DuckDB's SQL ---


def _part(value: str) -> str:
    """A value's normal form and tokens."""
    normal = f"trim(regexp_replace(regexp_replace(lower({value}), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    tokens = f"list_distinct(list_filter(string_split({normal}, ' '), lambda t: length(t) > 1 AND t NOT IN ({', '.join(map(literal, scoring.IGNORED))})))"
    return f"{{'x': {normal}, 's': {tokens}}}"


def _equal(a: str, b: str) -> str:
    near = f"coalesce(len(list_intersect({a}.s, {b}.s)) / nullif(least(len({a}.s), len({b}.s)), 0) >= 0.6, false)"
    return f"({a}.x <> '' AND {b}.x <> '' AND (contains({a}.x, {b}.x) OR contains({b}.x, {a}.x) OR {near}))"


def _fuzzy(a: str, b: str) -> str:
    return f"list_contains(list_transform([{{'a': {_part(a)}, 'b': {_part(b)}}}], lambda p: {_equal('p.a', 'p.b')}), true)"


def _greedy(want: str, have: str) -> str:
    """How many of ``have`` a fold over ``want`` takes, each the first that is equal and free."""
    parts = lambda xs: f"list_transform({xs}, lambda v: {_part('v')})"
    at = f"list_position(list_transform(a.f, lambda h: {_equal('q.w', 'h')}), true)"
    step = f"CASE WHEN {at} > 0 THEN {{'w': a.w, 'f': list_concat(a.f[1:{at} - 1], a.f[{at} + 1:])}} ELSE a END"
    rows = f"list_prepend({{'w': {_part(literal(''))}, 'f': {parts(have)}}}, list_transform({parts(want)}, lambda w: {{'w': w, 'f': {parts(have)}}}))"
    return f"len({have}) - len(list_reduce({rows}, lambda a, q: {step}).f)"


_NAMES = (
    "SELECT p_partkey, p_brand, p_size, p_partkey % 2 = 0 AS want, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' Services, Inc' "
    "ELSE 'The ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' co' ELSE '''s' END END AS v FROM part"
)


@query(f"""
WITH n AS ({_NAMES}), l AS (SELECT p_brand, p_size, list(v ORDER BY p_partkey) FILTER (want) AS e, list(v ORDER BY p_partkey) FILTER (NOT want) AS g FROM n GROUP BY ALL)
SELECT p_brand AS site, p_size::VARCHAR AS field, ({_greedy('e', 'g')})::BIGINT AS matched, len(e)::BIGINT AS expected, len(g)::BIGINT AS produced FROM l WHERE len(e) > 0 AND len(g) > 0""")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, produced = pairs(spark, sf_dir)
    listed = lambda key, text: F.transform(F.array_sort(F.collect_list(F.struct(key, text))), lambda x: x[text])
    e = expected.groupBy("p_brand", "p_size").agg(listed("expected", "a").alias("want"))
    g = produced.groupBy("p_brand", "p_size").agg(listed("produced", "b").alias("have"))
    rows = e.join(g, ["p_brand", "p_size"]).select(F.col("p_brand").alias("site"), F.col("p_size").cast("string").alias("field"), F.col("want").alias("expected"), F.col("have").alias("produced"))
    return scoring.greedy(rows)


def _value(slot: Column) -> Column:
    """What a part says for the field of its slot; even keys are expected values."""
    key, dash = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit("-"))
    text = F.when(F.col("want"), F.concat("p_name", F.lit(" Services, Inc"))).otherwise(F.concat(F.lit("The "), "p_name", F.when(key % 3 == 0, " co").otherwise("'s")))
    url = F.when(F.col("want"), F.concat(F.lit("https://www."), dash, F.lit(".com/"))).otherwise(F.concat(F.lit("http://"), dash, F.lit(".com")))
    forms = {"url": url, "profiles": url, "number": (1990 + F.floor(key / 2) % 3).cast("string"), "colors": F.concat(F.lit("#"), F.substring(F.md5("p_name"), 1, 2), F.lit("0000"))}
    out = text
    for k, (_, kind, *_rest) in enumerate(scoring.SCORED):
        if kind in forms:
            out = F.when(slot == k, forms[kind]).otherwise(out)
    return out


def _records(xs: Column, attribute: str) -> Column:
    return objects(F.transform(xs, lambda x: obj(member(attribute, quoted(x)))))


def _expected(kind: str, xs: Column) -> Column:
    first = F.get(xs, F.lit(0))
    if kind == "number":
        return F.coalesce(first, F.lit("null"))
    if kind in ("url", "text"):
        return quoted(first)
    if kind == "profiles":
        return F.when(first.isNull(), F.lit("{}")).otherwise(obj(member("x", quoted(first))))
    return _records(xs, "name") if kind == "records" else documents.strings(xs)


def _produced(name: str, kind: str, attribute: str | None, xs: Column) -> Column:
    if name == "mainAddress":
        value = obj(member("formatted", quoted(F.get(xs, F.lit(0)))))
    elif name == "logoUrl":
        value = _records(xs, "url")
    elif kind == "profiles":
        value = objects(F.transform(xs, lambda x: obj(F.lit('"platform":"x"'), member("url", quoted(x)))))
    elif kind in ("url", "text", "number"):
        value = _expected(kind, xs)
    else:
        value = _records(xs, attribute) if attribute else documents.strings(xs)
    return obj(member("value", value))


def scored_sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Brands as sites: JSON documents of parts of odd key, golden profiles of those of even key, dealt to the fields by size."""
    slot = F.col("p_size") % _N
    each = table(spark, sf_dir, "part").withColumn("want", F.col("p_partkey") % 2 == 0).select("p_brand", "p_partkey", "want", slot.alias("k"), _value(slot).alias("v"))
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.struct("p_partkey", "v")))), lambda x: x["v"]).alias(f"f{k}") for k in range(_N)]
    held = each.groupBy("p_brand", "want").agg(*lists)
    golden: dict[str, list[Column]] = {}
    made: dict[str, list[tuple[str, Column]]] = {}
    for k, (name, kind, wanted, path, attribute) in enumerate(scoring.SCORED):
        head, _, rest = wanted.partition(".")
        golden.setdefault(head, []).append(member(rest, _expected(kind, F.col(f"f{k}"))))
        head, _, rest = path.split(".value")[0].partition(".")
        made.setdefault(head, []).append((rest, _produced(name, kind, attribute, F.col(f"f{k}"))))
    profile = obj(*[member(head, obj(*members)) for head, members in golden.items()])
    document = obj(*[member(head, members[0][1] if members[0][0] == "" else obj(*[member(n, b) for n, b in members])) for head, members in made.items()])
    return held.where("not want").select(F.col("p_brand").alias("site"), document.alias("document")), held.where("want").select(F.col("p_brand").alias("site"), profile.alias("profile"))


def _slots(*kinds: str) -> str:
    return "(" + ", ".join(str(k) for k, f in enumerate(scoring.SCORED) if f[1] in kinds) + ")"


def _bare(value: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({value}), '^https?://', ''), '^www\.', ''), '/+$', '')"


_SCORES = f"""
n0 AS ({_NAMES}),
n AS (SELECT p_brand, p_partkey, want, p_size % {_N} AS k, CASE WHEN p_size % {_N} IN {_slots('url', 'profiles')} THEN CASE WHEN want THEN 'https://www.' || replace(p_name, ' ', '-') || '.com/' ELSE 'http://' || replace(p_name, ' ', '-') || '.com' END
  WHEN p_size % {_N} IN {_slots('number')} THEN (1990 + p_partkey // 2 % 3)::VARCHAR WHEN p_size % {_N} IN {_slots('colors')} THEN '#' || substr(md5(p_name), 1, 2) || '0000' ELSE v END AS v FROM n0),
f AS (SELECT unnest(range({_N})) AS k, unnest([{', '.join(literal(x[0]) for x in scoring.SCORED)}]) AS field),
g AS (SELECT p_brand, k, list(CASE WHEN k IN {_slots('profiles')} THEN 'x ' || v ELSE v END ORDER BY p_partkey) FILTER (want) AS e, list(CASE WHEN k IN {_slots('profiles')} THEN 'x ' || v ELSE v END ORDER BY p_partkey) FILTER (NOT want) AS g FROM n GROUP BY ALL),
l AS (SELECT b.p_brand AS site, field, f.k, CASE WHEN f.k IN {_slots('url', 'text', 'number', 'profiles')} THEN coalesce(e, [])[1:1] ELSE coalesce(e, []) END AS e, CASE WHEN f.k IN {_slots('url', 'text', 'number')} AND field <> 'logoUrl' THEN coalesce(g, [])[1:1] ELSE coalesce(g, []) END AS g0
      FROM (SELECT DISTINCT p_brand FROM n WHERE want) b CROSS JOIN f LEFT JOIN g ON g.p_brand = b.p_brand AND g.k = f.k),
m AS (SELECT site, field, k, e, CASE WHEN field = 'logoUrl' THEN g0[1:1] ELSE g0 END AS g FROM l),
sc AS (SELECT site, field, (CASE WHEN k IN {_slots('set', 'profiles', 'records')} THEN {_greedy('e', 'g')} WHEN k IN {_slots('colors')} THEN len(list_filter(e, lambda x: list_contains(g, x)))
  WHEN len(e) = 0 OR len(g) = 0 THEN 0 WHEN k IN {_slots('number')} THEN (e[1] = g[1])::INT WHEN k IN {_slots('url')} THEN ({_bare('e[1]')} = {_bare('g[1]')} OR {_fuzzy(_bare('e[1]'), _bare('g[1]'))})::INT
  ELSE {_fuzzy('e[1]', 'g[1]')}::INT END)::BIGINT AS matched, len(e)::BIGINT AS expected, len(g)::BIGINT AS produced FROM m)"""


@query(f"WITH {_SCORES} SELECT * FROM sc")
def site_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site's 23 fields against its golden profile, each by its kind."""
    return scoring.site_scores(*scored_sites(spark, sf_dir))


@query(f"WITH {_SCORES} SELECT site, sum(matched)::BIGINT AS matched, sum(expected)::BIGINT AS expected, sum(produced)::BIGINT AS produced, CASE WHEN sum(expected) = 0 THEN 1.0::DOUBLE ELSE sum(matched)::BIGINT / sum(expected)::BIGINT END AS recall FROM sc GROUP BY site")
def site_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each site over all its fields."""
    return scoring.site_totals(scoring.site_scores(*scored_sites(spark, sf_dir)))
