"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from kbloom.llm.url_filters import RULES

_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_HOST = _AZ.format("regexp_extract(regexp_extract({0}, '(?s)^.*?://(.*)$', 1), '^[^/?#]*')")
_PATH = "regexp_extract(regexp_extract({0}, '(?s)^.*?://(.*)$', 1), '^[^/?#]*([^?#]*)', 1)"
_KEPT = "array_to_string(list_sort(list_filter(string_split(regexp_extract({0}, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&')"
_NODE = f"CASE WHEN {_HOST} <> '' THEN regexp_replace({_HOST}, '^www\\.', '') || regexp_replace(regexp_replace({_PATH}, '\\.html?$', ''), '/+$', '') || CASE WHEN {_KEPT} <> '' THEN '?' || {_KEPT} ELSE '' END END"


def _attr(name: str) -> str:
    """An attribute's value by string functions: what follows its name and an equals sign."""
    after = f"ltrim(regexp_extract(body, '(?is)\\s{name}\\s*=(.*)$', 1))"
    value = f"CASE WHEN {after}[1] = chr(34) THEN split_part({after}, chr(34), 2) WHEN {after}[1] = chr(39) THEN split_part({after}, chr(39), 2) ELSE string_split_regex({after}, '\\s')[1] END"
    out = f"trim({value})"
    for code, mark in (("&#47;", "/"), ("&#x2F;", "/"), ("&#38;", "&"), ("&amp;", "&")):
        out = f"replace({out}, '{code}', '{mark}')"
    return out


#: A path's dots resolved by a fold over its segments.
_DOTS = "array_to_string(list_reduce(list_prepend([''], list_transform(string_split({0}, '/')[2:], lambda q: [q])), lambda held, q: CASE WHEN q[1] = '..' THEN held[1:greatest(len(held) - 1, 1)] WHEN q[1] = '.' THEN held ELSE held || q END), '/')"
_ABSOLUTE = (
    "CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.\\-]*://') THEN t WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.\\-]*:') THEN NULL"
    " WHEN starts_with(t, '//') THEN split_part(base, '//', 1) || t WHEN t[1] IN ('?', '#') THEN origin || bpath || t"
    f" WHEN t[1] = '/' THEN origin || {_DOTS.format('tpath')} || tail ELSE origin || {_DOTS.format('(folder || tpath)')} || tail END"
)

_FITS = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {{'rule': '{r}', 'allow': {str(r.allow).lower()}}}"
    for r in sorted(RULES, key=lambda r: -len(str(r)))
)

#: Tags are cut out by splitting at angle brackets; classes are reached by a recursive walk over the declared links.
OP3_SQL = f"""
WITH RECURSIVE p AS (SELECT row_number() OVER () AS k, page_id, url, html, coalesce({_HOST.format('url')}, '') AS host, coalesce({_PATH.format('url')}, '') AS path, {_NODE.format('url')} AS node FROM pages),
m AS (SELECT *, CASE {_FITS} END AS m FROM p),
c AS (SELECT k, url, node, unnest(string_split(regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script|<style.*?</style', '', 'g'), '<')) AS s FROM p WHERE contains(lower(html), 'canonical') OR contains(lower(html), 'refresh')),
b AS (SELECT k, url, node, lower(s[1:4]) AS tag, split_part(s[5:], '>', 1) AS body FROM c WHERE lower(s[1:4]) IN ('link', 'meta', 'base')),
o AS (SELECT k, first({_attr('href')}) AS base FROM b WHERE tag = 'base' GROUP BY k),
u AS (SELECT k, node, url, CASE WHEN tag = 'link' AND list_contains(string_split_regex(lower({_attr('rel')}), '\\s+'), 'canonical') THEN {_attr('href')} WHEN tag = 'meta' AND lower({_attr('http-equiv')}) = 'refresh' THEN trim(split_part(regexp_replace({_attr('content')}, '(?i)url\\s*=\\s*', chr(1)), chr(1), 2), chr(34) || chr(39) || ' ') END AS t FROM b),
v AS (SELECT node, t, CASE WHEN contains(base, '://') THEN base ELSE url END AS base FROM u LEFT JOIN o USING (k) WHERE t <> ''),
w AS (SELECT *, string_split_regex(base, '[?#]')[1] AS bare, string_split_regex(t, '[?#]')[1] AS tpath FROM v),
x AS (SELECT *, t[len(tpath) + 1:] AS tail, array_to_string(string_split(bare, '/')[1:3], '/') AS origin, bare[len(array_to_string(string_split(bare, '/')[1:3], '/')) + 1:] AS bpath FROM w),
y AS (SELECT *, '/' || array_to_string(list_filter(string_split(bpath, '/')[2:], lambda q, i: i < len(string_split(bpath, '/')) - 1), '/') || CASE WHEN len(string_split(bpath, '/')) > 2 THEN '/' ELSE '' END AS folder FROM x),
a AS (SELECT node AS x, {_ABSOLUTE} AS u FROM y),
e AS (SELECT x, {_NODE.format('u')} AS y, coalesce({_HOST.format('u')}, '') AS host, coalesce({_PATH.format('u')}, '') AS path FROM a WHERE x IS NOT NULL AND u IS NOT NULL),
s AS (SELECT x, y FROM e WHERE y IS NOT NULL UNION SELECT y, x FROM e WHERE y IS NOT NULL),
r(x, y) AS (SELECT DISTINCT node, node FROM p WHERE node IS NOT NULL UNION SELECT r.x, s.y FROM r JOIN s ON s.x = r.y),
j AS (SELECT node, m FROM m UNION ALL SELECT y, CASE {_FITS} END FROM e),
k AS (SELECT r.x AS node, count_if(j.m.allow) AS allows, count_if(NOT j.m.allow) AS blocks FROM r JOIN j ON j.node = r.y GROUP BY r.x)
SELECT page_id, host, path, m.m.rule AS rule, CASE WHEN coalesce(m.m.allow, NOT coalesce(allows = 0 AND blocks > 0, false)) THEN 'allow' ELSE 'block' END AS verdict FROM m LEFT JOIN k USING (node)
"""

_WORDS = f"regexp_extract_all({_AZ.format('coalesce(text, chr(32))')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT k, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g))),
h AS (SELECT DISTINCT k, i, x.n, item_id FROM x JOIN g USING (n, g)),
c AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM h) GROUP BY k),
s AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN c USING (k) LEFT JOIN s USING (k)
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS lo FROM x GROUP BY h),
c AS (SELECT DISTINCT doc_id, p FROM (SELECT x.doc_id, unnest(range(i, i + 50)) AS p FROM x JOIN f USING (h) WHERE lo < x.doc_id)),
l AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS kept FROM l ANTI JOIN c USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
