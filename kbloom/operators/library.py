"""The library of companies: summaries, search, filters, facets and sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbloom.functions.urls import host_of

UNKNOWN_INDUSTRY = "Industry not found"
KEYWORDS = 12


def display_name(name: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), host_of(url))


def band(completeness: Column) -> Column:
    return F.when(completeness < 0.4, "low").when(completeness <= 0.7, "medium").otherwise("high")


def location_line(city: Column, region: Column, formatted: Column, areas: Column) -> Column:
    """City and region, else the whole address, else the first area served."""
    pair = F.concat_ws(", ", F.nullif(F.trim(city), F.lit("")), F.nullif(F.trim(region), F.lit("")))
    return F.coalesce(F.nullif(pair, F.lit("")), formatted, F.get(areas, F.lit(0)))


def keywords(*lists: Column) -> Column:
    """Terms of all lists, each once in its first spelling, ignoring case."""
    terms = F.filter(F.transform(F.concat(*lists), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    placed = F.transform(terms, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x")))
    firsts = F.aggregate(
        F.array_sort(placed),
        F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<struct<i:int,x:string>>").alias("out")),
        lambda a, p: F.struct(p["k"].alias("last"), F.when(a["last"].eqNullSafe(p["k"]), a["out"]).otherwise(F.array_append(a["out"], F.struct(p["i"].alias("i"), p["x"].alias("x")))).alias("out")),
    )["out"]
    return F.transform(F.array_sort(firsts), lambda p: p["x"])


def haystack(name: Column, industry: Column, location: Column, url: Column, words: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (name, industry, location, host_of(url))], F.array_join(words, " ")))


def matches(hay: Column, search: str) -> Column:
    """Every word of the search is a substring."""
    out = F.lit(True)
    for token in search.lower().split():
        out = out & F.contains(hay, F.lit(token))
    return out


def age_days(then: Column, now: str) -> Column:
    """Days since an NTZ timestamp; infinite for null."""
    return F.coalesce(F.timestamp_diff("MICROSECOND", then, F.lit(now).cast("timestamp_ntz")) / F.lit(86_400_000_000.0), F.lit(float("inf")))


def filtered(rows: DataFrame, now: str, search: str = "", industries=(), bands=(), review=(), content=(), within_days: float | None = None) -> DataFrame:
    """Summaries that pass all filters; values of one filter are alternatives.

    ``rows`` has company_name, industry, location, source_url, keywords,
    completeness, attention_count, conflict_count, people_count,
    offerings_count, testimonials_count and updated_at.
    """
    test = matches(haystack(F.col("company_name"), F.col("industry"), F.col("location"), F.col("source_url"), F.col("keywords")), search)
    if industries:
        test = test & F.coalesce("industry", F.lit(UNKNOWN_INDUSTRY)).isin(*industries)
    if bands:
        test = test & band(F.col("completeness")).isin(*bands)
    for chosen, columns in ((review, {"conflicts": "conflict_count", "attention": "attention_count"}), (content, {"testimonials": "testimonials_count", "offerings": "offerings_count", "people": "people_count"})):
        if chosen:
            some = F.lit(False)
            for flag in chosen:
                some = some | (F.col(columns[flag]) > 0)
            test = test & some
    if within_days is not None:
        test = test & (age_days(F.col("updated_at"), now) <= within_days)
    return rows.where(test)


def facets(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("industry", F.lit(UNKNOWN_INDUSTRY)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


SORT_KEYS = {"updated": "updated_at", "created": "created_at", "completeness": "completeness", "offerings": "offerings_count", "people": "people_count", "proof": "testimonials_count"}


def sort(rows: DataFrame, key: str, descending: bool) -> DataFrame:
    """Rows in order; equal ones by name, ascending whatever the direction."""
    name = display_name(F.col("company_name"), F.col("source_url"))
    by = F.lower(name) if key == "name" else F.col(SORT_KEYS[key])
    return rows.orderBy(by.desc() if descending else by.asc(), F.lower(name), name, "id")


def relative_time(then: Column, now: str) -> Column:
    seconds = F.floor(F.timestamp_diff("MICROSECOND", then, F.lit(now).cast("timestamp_ntz")) / F.lit(1_000_000.0) + F.lit(0.5))
    minutes, hours, days = F.floor(seconds / 60), F.floor(seconds / 3600), F.floor(seconds / 86400)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return (
        F.when(then.isNull(), "unknown").when(seconds < 60, "just now").when(minutes < 60, text(minutes, "m ago")).when(hours < 24, text(hours, "h ago"))
        .when(days == 1, "yesterday").when(days < 30, text(days, "d ago")).when(days < 360, text(F.floor(days / 30), "mo ago")).otherwise(text(F.floor(F.floor(days / 30) / 12), "y ago"))
    )


def review_queue(fields: DataFrame, most: int) -> DataFrame:
    """The paths that models filled most often."""
    each = fields.where(F.col("method").isin("ai-live", "ai-mock")).groupBy("org", "path").agg(F.count(F.lit(1)).alias("n"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("org").orderBy(F.desc("n"), "path"))).where(F.col("rank") <= most)
