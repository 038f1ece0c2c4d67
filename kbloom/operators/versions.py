"""Versions of documents: allocation, current version, rescrapes and diffs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(saves: DataFrame, doc: str, *order: str) -> DataFrame:
    """Saves with their version number, from 1 in order of arrival."""
    return saves.withColumn("version", F.row_number().over(Window.partitionBy(doc).orderBy(*order)))


def allocate(held: DataFrame, arrivals: DataFrame, doc: str, *order: str) -> DataFrame:
    """Arrivals with the version numbers that follow those a document has.

    ``held(doc, version)`` may lack a document; its first version is 1.
    """
    last = held.groupBy(doc).agg(F.max("version").alias("last"))
    placed = arrivals.withColumn("k", F.row_number().over(Window.partitionBy(doc).orderBy(*order)))
    return placed.join(last, doc, "left").withColumn("version", (F.coalesce("last", F.lit(0)) + F.col("k")).cast("int")).drop("last", "k")


def current(versions: DataFrame, doc: str, *columns: str) -> DataFrame:
    """The newest version of each document."""
    return versions.groupBy(doc).agg(F.max_by(F.struct("version", *columns), "version").alias("v")).select(doc, "v.*")


def rescraped(versions: DataFrame, doc: str, crawled: str) -> DataFrame:
    """Whether a version was crawled anew and not only edited."""
    before = F.lag(crawled).over(Window.partitionBy(doc).orderBy("version"))
    return versions.withColumn("rescraped", before.isNotNull() & (F.col(crawled) != before))


def change(before: Column, after: Column) -> Column:
    """What happened to a field shown as two lists of lines."""
    was, now = F.coalesce(F.size(before), F.lit(0)) > 0, F.coalesce(F.size(after), F.lit(0)) > 0
    return F.when(~was & ~now, "unchanged").when(~was, "added").when(~now, "removed").when(before == after, "unchanged").otherwise("changed")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Fields of two versions, ``(doc, path, lines)`` each, with the change."""
    b, a = before.select("doc", "path", F.col("lines").alias("old")), after.select("doc", "path", F.col("lines").alias("new"))
    return b.join(a, ["doc", "path"], "full_outer").withColumn("kind", change(F.col("old"), F.col("new")))


def counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("doc").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "changed")], F.count_if(F.col("kind") != "unchanged").alias("total"))


def line_diff(old: Column, new: Column) -> Column:
    """Lines of the new list as same or added, then removed ones of the old."""
    status = F.transform(new, lambda x: F.struct(x.alias("text"), F.when(F.array_contains(old, x), "same").otherwise("added").alias("status")))
    gone = F.transform(F.filter(old, lambda x: ~F.array_contains(new, x)), lambda x: F.struct(x.alias("text"), F.lit("removed").alias("status")))
    return F.concat(status, gone)


def apply(changes: DataFrame, accepted: list[str]) -> DataFrame:
    """The lines of each field after the accepted changes are taken."""
    return changes.withColumn("lines", F.when(F.col("path").isin(accepted), F.col("new")).otherwise(F.col("old")))


def fold_edits(log: DataFrame) -> DataFrame:
    """The last value of each field after SET and REVERT actions, in order.

    ``log(doc, field, seq, action, value)``: a revert clears what was set before
    it; fields that end cleared have no row.
    """
    last = log.where("action = 'revert'").groupBy("doc", "field").agg(F.max("seq").alias("cleared"))
    sets = log.where("action = 'set'").join(last, ["doc", "field"], "left").where(F.col("cleared").isNull() | (F.col("seq") > F.col("cleared")))
    return sets.groupBy("doc", "field").agg(F.max_by("value", "seq").alias("value"), F.count(F.lit(1)).alias("edits"))


def replay(log: DataFrame) -> DataFrame:
    """A whole editing session for each document, undo included.

    ``log(doc, seq, action, field, value)`` with the actions set, add, remove,
    accept, revert, undo and saved.  add and remove take items of a list field;
    accept marks a field reviewed; revert restores the original, which is empty;
    undo takes back the last remove; saved makes the draft the original.  A
    document's session is one person's clicks: it is folded as one group.
    """
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        original: dict = {}
        draft: dict = {}
        reviewed: set = set()
        removed: list = []
        for r in rows.sort_values("seq").itertuples():
            if r.action == "set":
                draft[r.field] = r.value
                reviewed.add(r.field)
            elif r.action == "add":
                draft[r.field] = [*draft.get(r.field, []), r.value]
            elif r.action == "remove" and r.value in draft.get(r.field, []):
                k = draft[r.field].index(r.value)
                removed.append((r.field, k, r.value))
                draft[r.field] = draft[r.field][:k] + draft[r.field][k + 1 :]
            elif r.action == "accept":
                reviewed.add(r.field)
            elif r.action == "revert":
                draft.pop(r.field, None)
                if r.field in original:
                    draft[r.field] = original[r.field]
                reviewed.discard(r.field)
            elif r.action == "undo" and removed:
                name, k, value = removed.pop()
                held = list(draft.get(name, []))
                draft[name] = [*held[:k], value, *held[k:]]
            elif r.action == "saved":
                original, removed = dict(draft), []
        names = set(draft) | set(original)
        dirty = sorted(n for n in names if draft.get(n) != original.get(n))
        return pd.DataFrame([(rows.doc.iloc[0], json.dumps(draft, sort_keys=True, ensure_ascii=False), "|".join(sorted(reviewed)), "|".join(dirty))], columns=["doc", "draft", "reviewed", "dirty"])

    return log.groupBy("doc").applyInPandas(fold, "doc long, draft string, reviewed string, dirty string")
