"""Fuzzy comparison and recall of extracted values against expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbloom.functions.dialect import let

# Tokens that don't tell two values apart.
IGNORED = "the a an and of in for llc inc co company services service solutions solution group com www https http".split()


def normal(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(value), "['’]", ""), "[^a-z0-9]+", " "))


def tokens(value: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal(value), " "), lambda t: (F.length(t) > 1) & ~t.isin(IGNORED)))


def parsed(value: Column) -> Column:
    """struct(x, s): a value in normal form and its tokens."""
    return F.struct(normal(value).alias("x"), tokens(value).alias("s"))


def alike(a: Column, b: Column) -> Column:
    """`fuzzy_equal` of two parsed values; null if either value is."""
    near = F.size(F.array_intersect(a["s"], b["s"])) / F.nullif(F.least(F.size(a["s"]), F.size(b["s"])), F.lit(0)) >= 0.6
    return (a["x"] != "") & (b["x"] != "") & (F.contains(a["x"], b["x"]) | F.contains(b["x"], a["x"]) | F.coalesce(near, F.lit(False)))


def fuzzy_equal(a: Column, b: Column) -> Column:
    """Equal, one within the other, or 0.6 of the smaller set of tokens shared."""
    return F.coalesce(alike(parsed(a), parsed(b)), F.lit(False))


def fuzzy_names(expected: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): names ``expected(keys, a)`` and ``produced(keys, b)`` of equal keys that are fuzzily equal.

    Each distinct name of a key is parsed once and compared once with each of the
    other side, however many rows have it.
    """
    a = expected.select(*keys, "a").distinct().withColumn("pa", parsed(F.col("a")))
    b = produced.select(*keys, "b").distinct().withColumn("pb", parsed(F.col("b")))
    return a.join(b, keys).where(alike(F.col("pa"), F.col("pb"))).select(*keys, "a", "b")


def recall(scores: DataFrame) -> DataFrame:
    """Matched, expected, produced and recall over ``scores(field, ...)``."""
    summed = scores.groupBy("field").agg(*[F.sum(c).alias(c) for c in ("matched", "expected", "produced")])
    return summed.withColumn("recall", F.floor(F.col("matched") / F.nullif(F.col("expected"), F.lit(0)) * 1000 + 0.5) / 1000)


def greedy(rows: DataFrame) -> DataFrame:
    """One-to-one matches of a field's values: each expected one, in order,
    takes the first produced one that is fuzzily equal and still free.

    ``rows(site, field, expected, produced)`` with two arrays: one field of one
    site, a short list each.  A fold over the expected values carries those that
    are free.
    """

    def step(held: Column, want: Column) -> Column:
        k = F.array_position(F.transform(held, lambda h: alike(want, h)), True).cast("int")
        return let(k, lambda k: F.when(k > 0, F.concat(F.slice(held, F.lit(1), k - 1), F.slice(held, k + 1, F.size(held)))).otherwise(held))

    free = F.aggregate("want", F.col("have"), step)
    held = rows.withColumns({"want": F.transform("expected", parsed), "have": F.transform("produced", parsed)})
    matched = (F.size("have") - F.size(free)).cast("long")
    return held.select("site", "field", matched.alias("matched"), F.size("expected").cast("long").alias("expected"), F.size("produced").cast("long").alias("produced"))


# What is scored, (field, kind, path in the golden profile, path in the document, attribute of its records).
SCORED = [
    ("website", "url", "exact.website", "foundation.website", None),
    ("industry", "text", "exact.industry", "foundation.industry", None),
    ("companyRole", "text", "exact.companyRole", "foundation.companyRole", None),
    ("yearFounded", "number", "exact.yearFounded", "foundation.yearFounded", None),
    ("legalEntityType", "text", "exact.legalEntityType", "foundation.legalEntityType", None),
    ("employeeCount", "number", "exact.employeeCount", "foundation.employeeCount", None),
    ("revenue", "text", "exact.revenue", "foundation.revenue", None),
    ("mainAddress", "text", "exact.mainAddress", "foundation.mainAddress.value.formatted", None),
    ("logoUrl", "url", "exact.logoUrl", "branding.logos.value[0].url", None),
    ("socials", "profiles", "exact.socials", "onlinePresence.profiles", None),
    ("serviceLocations", "set", "sets.serviceLocations", "foundation.serviceLocations", None),
    ("otherLocations", "set", "sets.otherLocations", "foundation.otherLocations", "formatted"),
    ("altNames", "set", "sets.altNames", "foundation.altNames", None),
    ("buyers", "set", "sets.buyers", "market.buyers", None),
    ("industryGroupings", "set", "sets.industryGroupings", "market.industryGroupings", None),
    ("channels", "set", "sets.channels", "market.channels", None),
    ("funnels", "set", "sets.funnels", "market.funnels", None),
    ("ctas", "set", "sets.ctas", "market.ctas", None),
    ("suppliers", "set", "sets.suppliers", "market.suppliersPartners", None),
    ("fonts", "set", "sets.fonts", "branding.fonts", None),
    ("colors", "colors", "sets.colors", "branding.colors", "hex"),
    ("people", "records", "records.people", "people", "name"),
    ("offerings", "records", "records.offerings", "offerings", "name"),
]
#: Fields that a model fills: an extraction alone scores little there.
ENRICHED = ["industry", "companyRole", "buyers", "serviceLocations"]
_ONE = ("url", "text", "number")


def same_url(a: Column, b: Column) -> Column:
    """Equal but for scheme, www and closing slashes, or fuzzily equal."""
    bare = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(v), "^https?://", ""), r"^www\.", ""), "/+$", "")
    return (bare(a) == bare(b)) | fuzzy_equal(bare(a), bare(b))


def _listed(text: Column, attribute: str | None) -> Column:
    """A JSON array as strings: its elements, or one attribute of each; strings stand for themselves."""
    parsed = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    plain = lambda v: F.try_variant_get(v, "$", "string")
    one = plain if attribute is None else lambda v: F.coalesce(F.when(F.schema_of_variant(v) == "STRING", plain(v)), F.try_variant_get(v, f"$.{attribute}", "string"))
    return F.array_compact(F.transform(parsed, one))


def _values(document: Column, profile: Column, field: tuple) -> tuple[Column, Column]:
    """Expected and produced values of a field, as lists."""
    _, kind, wanted, path, attribute = field
    want = F.get_json_object(profile, f"$.{wanted}")
    have = F.get_json_object(document, f"$.{path}" if ".value" in path else f"$.{path}.value")
    if kind in _ONE:
        lists = [F.array_compact(F.array(F.nullif(x, F.lit("")))) for x in (want, have)]
    elif kind == "profiles":
        lists = [
            F.transform(F.map_entries(F.from_json(want, "map<string,string>")), lambda e: F.concat_ws(" ", e["key"], e["value"])),
            F.transform(F.from_json(have, "array<struct<platform: string, url: string>>"), lambda p: F.concat_ws(" ", p["platform"], p["url"])),
        ]
    else:
        lists = [_listed(want, "name" if kind == "records" else None), _listed(have, attribute)]
    return tuple(F.coalesce(x, F.array().cast("array<string>")) for x in lists)


def site_fields(documents: DataFrame, golden: DataFrame) -> DataFrame:
    """(site, field, kind, expected, produced): both sides' values of the 23 scored fields.

    ``documents(site, document)`` and ``golden(site, profile)``, both JSON.  Only
    sites with a profile are scored; one without a document produced nothing.
    """
    both = golden.join(documents, "site", "left")
    each = [F.struct(F.lit(f[0]).alias("field"), F.lit(f[1]).alias("kind"), *[v.alias(n) for n, v in zip(("expected", "produced"), _values(F.col("document"), F.col("profile"), f), strict=True)]) for f in SCORED]
    return both.select("site", F.inline(F.array(*each)))


def site_scores(documents: DataFrame, golden: DataFrame) -> DataFrame:
    """(site, field, matched, expected, produced) by the field's kind.

    A text is compared fuzzily, a URL without scheme and www, a number and a
    colour exactly; sets, profiles and records are matched one to one.
    """
    rows = site_fields(documents, golden)
    sets = greedy(rows.where(F.col("kind").isin("set", "profiles", "records")))
    a, b = F.get("expected", F.lit(0)), F.get("produced", F.lit(0))
    one = F.when(F.col("kind") == "number", a == b).when(F.col("kind") == "url", same_url(a, b)).otherwise(fuzzy_equal(a, b))
    colours = F.size(F.filter("expected", lambda x: F.array_contains(F.transform("produced", F.lower), F.lower(x))))
    matched = F.when(F.col("kind") == "colors", colours).otherwise(F.coalesce(one, F.lit(False)).cast("int"))
    rest = rows.where(~F.col("kind").isin("set", "profiles", "records"))
    return sets.unionByName(rest.select("site", "field", matched.cast("long").alias("matched"), F.size("expected").cast("long").alias("expected"), F.size("produced").cast("long").alias("produced")))


def site_totals(scores: DataFrame) -> DataFrame:
    """(site, matched, expected, produced, recall); what expects nothing is recalled whole."""
    summed = scores.groupBy("site").agg(*[F.sum(c).alias(c) for c in ("matched", "expected", "produced")])
    return summed.withColumn("recall", F.when(F.col("expected") == 0, 1.0).otherwise(F.col("matched") / F.col("expected")))
