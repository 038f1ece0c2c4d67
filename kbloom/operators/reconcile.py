"""Reconciliation of competing claims into fields.

Claims are (site, path, seq, value, method, role, confidence, url, note); seq is
the order of arrival, which breaks every tie.  Scalars and lists are grouped
aggregations with map-side combination, first by value, so that a value that
many pages repeat costs one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbloom.functions import fields
from kbloom.functions.dialect import half_up, squash


def ranked(claims: DataFrame) -> DataFrame:
    """Claims with tier and score."""
    return claims.withColumn("tier", fields.tier(F.col("method"))).withColumn("score", fields.score(F.col("confidence"), F.col("role")))


def scalar_fields(claims: DataFrame) -> DataFrame:
    """One field for each site and path, its source URLs as an array too.

    The highest tier wins, then the best score, then the first claim.  More than
    one value within the top tier is a conflict: it is noted and the confidence
    is 0.45 at most.  Returns value, method, confidence, urls, note, n_values
    and the candidates in order.
    """
    order = F.struct((-F.col("score")).alias("s"), F.col("seq"))
    keyed = ranked(claims).withColumn("key", F.lower(F.trim(F.col("value"))))
    by_url = keyed.groupBy("site", "path", "tier", "key", "url").agg(F.min(F.struct(order.alias("o"), "value", "method", "confidence", "note")).alias("b"))
    by_value = by_url.groupBy("site", "path", "tier", "key").agg(
        F.min("b").alias("b"), F.transform(F.array_sort(F.collect_list(F.struct(F.col("b.o").alias("o"), "url"))), lambda x: x["url"]).alias("urls")
    )
    held = by_value.groupBy("site", "path").agg(F.max("tier").alias("top"), F.array_sort(F.collect_list(F.struct((-F.col("tier")).alias("t"), F.col("b.o").alias("o"), "b", "urls"))).alias("all"))
    same = held.withColumn("same", F.filter("all", lambda x: x["t"] == -F.col("top")))
    first, n = F.get("same", F.lit(0)), F.size("same")
    others = F.array_join(F.transform(F.slice("same", 2, F.size("same")), lambda x: F.lower(F.trim(x["b"]["value"]))), ", ")
    return same.select(
        "site", "path", first["b"]["value"].alias("value"), fields.origin(first["b"]["method"]).alias("method"),
        F.when(n > 1, F.least(first["b"]["confidence"], F.lit(0.45))).otherwise(first["b"]["confidence"]).alias("confidence"),
        first["urls"].alias("url_list"), F.array_join(first["urls"], "|").alias("urls"),
        F.when(n > 1, F.concat(F.lit("We found "), n.cast("string"), F.lit(" different values: "), others)).otherwise(first["b"]["note"]).alias("note"),
        n.cast("long").alias("n_values"), F.transform("same", lambda x: F.struct(x["b"]["value"].alias("value"), x["b"]["confidence"].alias("confidence"), F.get(x["urls"], F.lit(0)).alias("url"))).alias("candidates"),
    )


def scalars(claims: DataFrame) -> DataFrame:
    """`scalar_fields` with urls as lines only."""
    return scalar_fields(claims).drop("url_list")


def conflicts(claims: DataFrame) -> DataFrame:
    """The candidates of each contested field, the best first."""
    return scalars(claims).where("n_values > 1").select("site", "path", F.posexplode("candidates").alias("place", "c")).select("site", "path", "place", "c.value", "c.confidence", "c.url")


def list_fields(claims: DataFrame) -> DataFrame:
    """String lists as arrays: spellings of one item are merged, the best scored one stays.

    Items are in order of first appearance; the confidence is their mean.
    """
    keyed = ranked(claims).withColumn("item", squash(F.col("value"))).where("item <> ''").withColumn("key", F.lower("item"))
    best = F.max_by(F.struct("item", "confidence", "method", "tier", "url"), F.struct("score", (-F.col("seq")).alias("s"))).alias("b")
    items = keyed.groupBy("site", "path", "key").agg(best, F.min("seq").alias("first"))
    held = items.groupBy("site", "path").agg(F.array_sort(F.collect_list(F.struct("first", "b"))).alias("i"))
    top = F.min_by(F.col("b.method"), F.struct((-F.col("b.tier")).alias("t"), "first"))
    extra = items.groupBy("site", "path").agg(top.alias("method"))
    total = F.aggregate("i", F.lit(0.0), lambda a, x: a + x["b"]["confidence"])
    return held.join(extra, ["site", "path"]).select(
        "site", "path", F.transform("i", lambda x: x["b"]["item"]).alias("items"), fields.origin(F.col("method")).alias("method"),
        half_up(total / F.size("i"), 3).alias("confidence"), F.array_distinct(F.transform("i", lambda x: x["b"]["url"])).alias("urls"),
    )


def lists(claims: DataFrame) -> DataFrame:
    """`list_fields` with items and urls as lines."""
    return list_fields(claims).withColumns({c: F.array_join(c, "|") for c in ("items", "urls")})


def gap(first: Column, second: Column) -> Column:
    """The first value, or the second where that is missing or empty."""
    missing = first.isNull() | (first.cast("string") == "")
    return F.when(missing, second).otherwise(first)


def merged_records(claims: DataFrame, attributes: list[str], fill: Callable[[Column, Column], Column] = gap) -> DataFrame:
    """Records of one key merged in order of arrival; ``fill`` gives an attribute what it lacks.

    A claim that outranks the record's base takes its place and inherits what it
    lacks; any other fills gaps only.  That is a fold and not a choice of the
    first non-null value by rank, so a key's claims meet in one array: they are
    the mentions of one record on one site's pages.  Empty strings are gaps.
    """
    each = ranked(claims)
    row = F.struct("seq", "tier", "score", "confidence", "method", "url", *attributes)
    held = each.groupBy("site", "path", "key").agg(F.sort_array(F.collect_list(row)).alias("c") if fill is gap else F.array_sort(F.collect_list(row), lambda a, b: (a["seq"] - b["seq"]).cast("int")).alias("c"))

    def step(base: Column, new: Column) -> Column:
        wins = (new["tier"] > base["tier"]) | ((new["tier"] == base["tier"]) & (new["score"] > base["score"]))
        pick = lambda name: F.when(wins, new[name]).otherwise(base[name]).alias(name)
        return F.struct(
            base["seq"].alias("seq"), pick("tier"), pick("score"), pick("confidence"), pick("method"), pick("url"),
            *[F.when(wins, fill(new[a], base[a])).otherwise(fill(base[a], new[a])).alias(a) for a in attributes],
        )

    merged = F.aggregate(F.slice("c", 2, F.size("c")), F.get("c", F.lit(0)), step)
    out = held.select("site", "path", "key", merged.alias("r"), F.array_distinct(F.transform("c", lambda x: x["url"])).alias("urls"))
    return out.select("site", "path", "key", *[F.col(f"r.{a}").alias(a) for a in attributes], "r.confidence", "r.tier", F.col("r.method").alias("claimed"), "r.seq", "r.url", "urls")


def fold_records(claims: DataFrame, attributes: list[str]) -> DataFrame:
    """`merged_records` with their method, and how many pages mention each."""
    out = merged_records(claims, attributes)
    return out.select("site", "path", "key", *attributes, "confidence", fields.origin(F.col("claimed")).alias("method"), F.size("urls").cast("long").alias("n_urls"))
