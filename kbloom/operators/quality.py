"""Completeness scores, missing fields and follow-up questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbloom.functions import fields
from kbloom.functions.dialect import half_up


def category_scores(filled: DataFrame) -> DataFrame:
    """Share of a category's impact that is filled.

    ``filled(site, path, filled, ...)`` has a row for each site and field, with
    the columns of the field table.
    """
    earned = F.sum(F.when(F.col("filled"), F.col("impact")).otherwise(0))
    return filled.groupBy("site", "category").agg(half_up(earned / F.sum("impact"), 3).alias("score"), F.count_if("filled").alias("filled_fields"), F.count(F.lit(1)).alias("total_fields"))


def overall_score(filled: DataFrame) -> DataFrame:
    """Share of the askable impact that is filled."""
    asked = filled.where("askable")
    return asked.groupBy("site").agg(half_up(F.sum(F.when(F.col("filled"), F.col("impact")).otherwise(0)) / F.sum("impact"), 3).alias("score"))


def missing(filled: DataFrame) -> DataFrame:
    return filled.where("not filled").select("site", "path", "place")


def questions(filled: DataFrame, most: int = fields.MOST_QUESTIONS) -> DataFrame:
    """The gaps to ask about: impact by cost, less if a substitute is known.

    Fields of a group are one question with their summed priority.
    """
    known = filled.where("filled").groupBy("site").agg(F.collect_set("path").alias("known"))
    gaps = filled.where("askable and not filled").join(known, "site", "left")
    penalty = F.when(F.coalesce(F.arrays_overlap("substitutes", "known"), F.lit(False)), fields.SUBSTITUTE_PENALTY).otherwise(1.0)
    placed = gaps.withColumn("priority", F.col("impact") * penalty / F.col("cost")).withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("priority"), "path")))
    asked = placed.groupBy("site", F.coalesce("grp", F.translate("path", ".", "-")).alias("id")).agg(
        F.min("place").alias("first"), half_up(F.sum("priority"), 3).alias("priority"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]), "|").alias("fills")
    )
    chosen = asked.withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy("first"))).where(F.col("k") <= most)
    return chosen.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("priority"), "first"))).select("site", "id", "fills", "priority", "rank")


def attention(fields_: DataFrame, conflicts: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Fields to review in order: contested ones first, then by impact.

    ``fields_(site, path, place, impact, method, note, value, confidence)``;
    ``conflicts(site, path)`` are open; ``reviewed(site, path)`` are done.  A
    field is safe to accept unless it is contested or a model's.
    """
    open_ = conflicts.select("site", "path").distinct().withColumn("contested", F.lit(True))
    asked = fields_.where(fields.needs_review(F.col("method"), F.col("note"), F.col("value"), F.col("confidence"))).join(reviewed.select("site", "path"), ["site", "path"], "left_anti")
    each = asked.join(open_, ["site", "path"], "left").withColumn("contested", F.coalesce("contested", F.lit(False)))
    order = Window.partitionBy("site").orderBy(F.desc("contested"), F.desc("impact"), "place")
    return each.select("site", "path", "contested", (~F.col("contested") & ~F.col("method").isin("ai-live", "ai-mock")).alias("safe"), F.row_number().over(order).alias("rank"))
