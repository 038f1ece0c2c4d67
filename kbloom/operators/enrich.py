"""Generated values beside extracted ones: what may replace or extend what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbloom.functions.dialect import half_up, squash

# Fields that generated prose may take over from a weak seed.
GENERATED = ["foundation.overview", "positioning.pitch", "positioning.foundingStory", "market.customerNeeds", "market.idealPersona"]
SEED = 0.6
# Fields that a template copy starts without.
CLEARED = [
    "foundation.overview", "foundation.website", "foundation.yearFounded", "foundation.legalEntityType", "foundation.employeeCount", "foundation.revenue",
    "foundation.mainAddress", "foundation.otherLocations", "foundation.serviceLocations", "foundation.altNames", "foundation.phone", "foundation.email",
    "positioning.foundingStory", "onlinePresence.profiles", "people", "proof.testimonials", "proof.aggregateRatings", "proof.caseStudies", "proof.certifications",
    "proof.memberships", "proof.awards", "proof.pressMentions", "proof.trustStats", "proof.clientLogos", "contentIntelligence.posts", "contentIntelligence.cadence",
    "contentIntelligence.taxonomy", "contentIntelligence.headlinePatterns",
]
CLEARED_NOTE = "Cleared when this template was created."


def filled(value: Column) -> Column:
    return value.isNotNull() & (F.trim(value) != "")


def takes(path: Column, value: Column, confidence: Column, new_value: Column, new_confidence: Column) -> Column:
    """Whether a generated value is taken: into a gap, or over a weaker seed."""
    weak = path.isin(GENERATED) & (confidence < SEED) & (new_confidence > confidence)
    return F.coalesce(filled(new_value) & (~filled(value) | weak), F.lit(False))


def apply_generated(held: DataFrame, made: DataFrame, method: str) -> DataFrame:
    """Fields ``(doc, path, value, method, confidence)`` after generated ones."""
    new = made.select("doc", "path", F.col("value").alias("new_value"), F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0)).alias("new_confidence"))
    both = held.join(new, ["doc", "path"], "left").withColumn("taken", takes(F.col("path"), F.col("value"), F.col("confidence"), F.col("new_value"), F.col("new_confidence")))
    pick = lambda a, b: F.when(F.col("taken"), b).otherwise(F.col(a)).alias(a)
    return both.select("doc", "path", pick("value", F.col("new_value")), pick("method", F.lit(method)), pick("confidence", F.col("new_confidence")), "taken")


def extend_list(held: Column, made: Column) -> Column:
    """A list with the generated items it lacks, ignoring case, at its end."""
    clean = F.filter(F.transform(made, lambda x: squash(x)), lambda x: x != "")
    start = F.struct(F.coalesce(held, F.array().cast("array<string>")).alias("items"), F.transform(F.coalesce(held, F.array().cast("array<string>")), lambda x: F.lower(x)).alias("seen"))
    step = lambda a, x: F.when(F.array_contains(a["seen"], F.lower(x)), a).otherwise(F.struct(F.array_append(a["items"], x).alias("items"), F.array_append(a["seen"], F.lower(x)).alias("seen")))
    return F.aggregate(F.coalesce(clean, F.array().cast("array<string>")), start, step)["items"]


def price_matches(stated: Column, returned: Column) -> Column:
    bare = lambda c: F.regexp_replace(F.lower(c), r"[\s,]", "")
    return F.contains(bare(stated), bare(returned)) | F.contains(bare(returned), bare(stated))


def consolidate(made: DataFrame, candidates: DataFrame) -> DataFrame:
    """Generated offerings tied to the candidates they name by index.

    ``made(doc, item, name, pricing, indexes)`` and ``candidates(doc, index,
    pricing, url)``.  Offerings without a valid index go; a price stays only if
    a candidate states it, else the first stated one is taken.
    """
    named = made.select("doc", "item", "name", F.col("pricing").alias("asked"), F.posexplode("indexes").alias("pos", "index"))
    tied = named.join(candidates, ["doc", "index"])
    rows = tied.groupBy("doc", "item").agg(
        F.first("name").alias("name"), F.first("asked").alias("asked"), F.array_sort(F.collect_list(F.struct("pos", "pricing", "url", "index"))).alias("c"),
    )
    stated = F.filter(F.transform("c", lambda x: x["pricing"]), lambda p: F.coalesce(p != "", F.lit(False)))
    good = F.coalesce(F.exists(stated, lambda p: price_matches(p, F.col("asked"))), F.lit(False))
    links = F.filter(F.transform("c", lambda x: x["url"]), lambda u: u.isNotNull())
    return rows.select("doc", "item", "name", F.when(good, F.col("asked")).otherwise(F.get(stated, F.lit(0))).alias("pricing"), F.get(links, F.lit(0)).alias("url"), F.size("c").cast("long").alias("n_sources"))


def merge_records(held: DataFrame, made: DataFrame) -> DataFrame:
    """Extracted records and the generated ones of other keys, each key once.

    ``(doc, key, seq, value, confidence)``; records without a key are left out of
    the generated ones.
    """
    new = made.where("key <> ''").groupBy("doc", "key").agg(F.min_by(F.struct("seq", "value", "confidence"), "seq").alias("r")).select("doc", "key", "r.*")
    added = new.join(held.select("doc", "key"), ["doc", "key"], "left_anti")
    return held.select("doc", "key", "seq", "value", "confidence", F.lit(False).alias("made")).unionByName(added.withColumn("made", F.lit(True)))


def mean_confidence(records: DataFrame) -> DataFrame:
    return records.groupBy("doc").agg(half_up(F.avg("confidence"), 3).alias("confidence"), F.count(F.lit(1)).alias("n"))


def as_template(held: DataFrame) -> DataFrame:
    """Fields of a template copy: named anew, what is one company's is cleared."""
    cleared = F.col("path").isin(CLEARED)
    name = F.when(filled(F.col("value")), F.concat("value", F.lit(" (template)"))).otherwise("Untitled template")
    is_name = F.col("path") == "companyName"
    return held.select(
        "doc", "path", F.when(cleared, F.lit(None)).when(is_name, name).otherwise(F.col("value")).alias("value"), F.when(cleared, "not-found").when(is_name, "user-edited").otherwise(F.col("method")).alias("method"),
        F.when(cleared, 0.0).when(is_name, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.when(cleared, CLEARED_NOTE).alias("note"),
    )
