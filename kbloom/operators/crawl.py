"""Link harvest, crawl frontier and failure ranking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbloom.functions import urls
from kbloom.sources.scratch import Tables, small_batches

#: Pages that one site may cost, requests for each of them, and pages fetched at a time.
BUDGET, REQUESTS, WORKERS = 20, 2, 4


def _harvest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from urllib.parse import urljoin

    from kbloom.operators.dom import anchors

    for batch in batches:
        rows = []
        for page_id, url, html in zip(batch.page_id, batch.url, batch.html, strict=True):
            for pos, (href, text, place) in enumerate(anchors(html)):
                try:
                    target = urljoin(url or "", href)
                except ValueError:
                    continue
                rows.append((page_id, url, target, text, {"nav": 15, "footer": 8}.get(place, 0), pos))
        yield pd.DataFrame(rows, columns=["page_id", "page_url", "target", "anchor", "bonus", "pos"])


def links(pages: DataFrame) -> DataFrame:
    """One row for each page and linked page: the best placed, longest anchor.

    ``pages`` holds page_id, url and html.  Returns page_id, page_url, url,
    anchor, bonus (15 in a menu, 8 in a footer), pos, and ``first``, the place of
    the first link of that bonus.
    """
    raw = small_batches(pages.select("page_id", "url", "html")).mapInPandas(_harvest, "page_id long, page_url string, target string, anchor string, bonus int, pos int")
    found = raw.select("page_id", "page_url", urls.normalize_url(F.col("target")).alias("url"), "anchor", "bonus", "pos").where(urls.html_like(F.col("url")))
    best = F.min_by(F.struct("page_url", "anchor", "bonus", "pos"), F.struct(-F.col("bonus"), -F.length("anchor"), F.col("pos"))).alias("b")
    first = F.min_by("pos", F.struct(-F.col("bonus"), F.col("pos"))).alias("first")
    return found.groupBy("page_id", "url").agg(best, first).select("page_id", "b.page_url", "url", "b.anchor", "b.bonus", "b.pos", "first")


def frontier(found: DataFrame, seen: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The next ``budget`` pages of each site: highest priority, earliest found.

    ``found(site, url, anchor, bonus, page_id, pos)``; ``seen(site, url)`` are
    pages that were fetched already.
    """
    priority = (urls.classify(F.col("url"), F.col("anchor"))["priority"] + F.col("bonus")).alias("priority")
    first = found.groupBy("site", "url").agg(F.min_by(F.struct("anchor", "bonus", "page_id", "pos"), F.struct("page_id", "pos")).alias("f"))
    queue = first.select("site", "url", "f.*").select("site", "url", priority, "page_id", "pos").join(seen, ["site", "url"], "left_anti")
    order = Window.partitionBy("site").orderBy(F.desc("priority"), "page_id", "pos")
    return queue.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget)


def failure(warnings: DataFrame, run: str, seq: str, ranked: list[str]) -> DataFrame:
    """Per run the warning of the lowest rank, or else the first one."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ranked)), F.col("code")), F.lit(0)), F.lit(99)).cast("int")
    return warnings.withColumn("rank", rank).groupBy(run).agg(F.min_by("code", F.struct("rank", seq)).alias("code"), F.min("rank").alias("rank"))


# Roles worth a fetch before anything unclassified.
HIGH_VALUE = ["home", "about", "services", "contact", "products", "team", "testimonials", "pricing", "faq"]


def finish(found: DataFrame, seen: DataFrame, budget: int = BUDGET) -> DataFrame:
    """What a crawl under budget leaves behind: pages found and high-value ones.

    Takes what ``frontier`` takes; sites within budget have no row.
    """
    first = found.groupBy("site", "url").agg(F.min_by("anchor", F.struct("page_id", "pos")).alias("anchor"))
    left = first.join(seen.select("site", "url").distinct(), ["site", "url"], "left_anti")
    role = urls.classify(F.col("url"), F.col("anchor"))["role"]
    return left.groupBy("site").agg(F.count(F.lit(1)).alias("found"), F.count_if(role.isin(HIGH_VALUE)).alias("high_value")).where(F.col("found") > budget).withColumn("left_over", F.col("found") - budget)


_CANDIDATE = "site string, url string, role string, priority int, round int, rank int, place int, first int"


class Crawl:
    """What a crawl of many sites fetched, asked for and found.

    ``asked`` has every request in order (site, round, rank, url, role, page_id,
    landed, ok), ``found`` every page that was queued.
    """

    def __init__(self, asked: DataFrame, found: DataFrame, budget: int):
        self.asked, self.found, self.budget = asked, found, budget

    def pages(self) -> DataFrame:
        """(site, place, page_id, url, role) of the pages fetched, in order."""
        order = Window.partitionBy("site").orderBy("round", "rank")
        return self.asked.where("ok").select("site", F.row_number().over(order).alias("place"), "page_id", F.col("landed").alias("url"), "role")

    def summary(self) -> DataFrame:
        """(site, fetched, requests, discovered, left_over, high_value, warning) of each site.

        Pages are left over once the budget is spent; a site without a page that
        could be read says so.
        """
        counts = self.asked.groupBy("site").agg(F.count_if("ok").alias("fetched"), F.count(F.lit(1)).alias("requests"))
        known = self.found.select("site", "url").unionByName(self.asked.where("round = 0").select("site", "url")).unionByName(self.asked.where("ok").select("site", F.col("landed").alias("url")))
        known = known.distinct().groupBy("site").agg(F.count(F.lit(1)).alias("discovered"))
        left = self.found.join(self.asked.select("site", "url"), ["site", "url"], "left_anti").groupBy("site").agg(F.count(F.lit(1)).alias("queued"), F.count_if(F.col("role").isin(HIGH_VALUE)).alias("wanted"))
        spent = (F.col("fetched") >= self.budget) & (F.coalesce("queued", F.lit(0)) > 0)
        zero = F.lit(0).cast("long")
        warning = F.when(spent, "budget-exceeded").when(F.col("fetched") == 0, "empty-body")
        rows = counts.join(known, "site").join(left, "site", "left")
        return rows.select("site", "fetched", "requests", "discovered", F.when(spent, F.col("queued")).otherwise(zero).alias("left_over"), F.when(spent, F.col("wanted")).otherwise(zero).alias("high_value"), warning.alias("warning"))


def walk(spark: SparkSession, seeds: DataFrame, web: DataFrame, edges: DataFrame, listed: DataFrame | None = None, budget: int = BUDGET, workers: int = WORKERS) -> Crawl:
    """Crawl every site of ``seeds(site, url)`` at once, page by page in order of priority.

    ``web(url, landed, page_id)`` says where a request for a URL lands, and has no
    row for a page that can't be read; ``edges(page_id, url, anchor, bonus,
    first)`` are the links of a page, as `links` gives them; ``listed(site, url,
    pos)`` are pages of sitemaps.  URLs are in normal form.  A site's seed is read
    first and alone; then every round each site reads its best ``workers``
    candidates and queues the links of the pages it got.  A candidate has the
    priority of its class and place, of the same priority what was queued first
    goes first; it is queued once, as first met.  A request that fails or lands on
    a page already fetched costs a request and no page.  Sites leave the loop once
    their budget, their requests (twice the budget) or their queue is spent, so
    there are at most ``2 * budget`` rounds.

    State is two written tables, candidates and requests, that each round adds to.
    Sites with a null name or seed are left out.
    """
    tables = Tables(spark, "crawl")
    seeds = seeds.where("site is not null and url is not null").groupBy("site").agg(F.min("url").alias("url"))
    web = tables.save(web.where("url is not null").groupBy("url").agg(F.min_by(F.struct("landed", "page_id"), "page_id").alias("w")).select("url", "w.*"), "web")
    edges = tables.save(edges.select("page_id", "url", F.coalesce("anchor", F.lit("")).alias("anchor"), "bonus", "first"), "edges")
    origin = tables.save(seeds.select("site", F.col("url").alias("origin")), "seeds")

    def candidates(rows: DataFrame, round_: int) -> DataFrame:
        """``rows(site, url, anchor, bonus, rank, first)``, each page as first met."""
        order = F.struct("rank", (-F.col("bonus")).alias("b"), "first")
        once = rows.groupBy("site", "url").agg(F.min_by(F.struct("anchor", "bonus", "rank", "first"), order).alias("f")).select("site", "url", "f.*")
        kind = urls.classify(F.col("url"), F.col("anchor"))
        return once.select("site", "url", kind["role"].alias("role"), (kind["priority"] + F.col("bonus")).cast("int").alias("priority"), F.lit(round_).alias("round"), F.col("rank").cast("int").alias("rank"), (-F.col("bonus")).cast("int").alias("place"), F.col("first").cast("int").alias("first"))

    def judged(asked: DataFrame, before: DataFrame | None) -> DataFrame:
        """Requests with what they got: ``ok`` for the first that lands on a page."""
        got = asked.join(web, "url", "left").select("site", "round", "rank", "url", "role", "page_id", "landed")
        first = got.where("landed is not null").groupBy("site", "landed").agg(F.min("rank").alias("rank")).withColumn("ok", F.lit(True))
        if before is not None:
            first = first.join(before.where("ok").select("site", "landed"), ["site", "landed"], "left_anti")
        return got.join(first, ["site", "landed", "rank"], "left").select("site", "round", "rank", "url", "role", "page_id", "landed", F.coalesce("ok", F.lit(False)).alias("ok"))

    home = origin.select("site", F.col("origin").alias("url"), F.lit(0).alias("round"), F.lit(0).alias("rank"), F.lit("home").alias("role"))
    now = asked = tables.add(judged(home, None), "asked", 0)
    empty = spark.createDataFrame([], _CANDIDATE)
    if listed is not None:
        sitemap = listed.join(origin, "site").where(F.col("url").isNotNull() & (F.col("url") != F.col("origin")))
        empty = candidates(sitemap.select("site", "url", F.lit("").alias("anchor"), F.lit(0).alias("bonus"), F.lit(0).alias("rank"), F.col("pos").alias("first")), -1)
    found = tables.add(empty, "found", 0)
    for k in range(1, REQUESTS * budget + 1):
        met = now.where("ok").join(edges.withColumnRenamed("url", "target"), "page_id").join(origin, "site").where(urls.same_site(F.col("target"), F.col("origin")))
        met = met.select("site", F.col("target").alias("url"), "anchor", "bonus", "rank", "first")
        seen = found.select("site", "url").unionByName(origin.select("site", F.col("origin").alias("url"))).unionByName(asked.where("ok").select("site", F.col("landed").alias("url")))
        found = tables.add(candidates(met.join(seen, ["site", "url"], "left_anti"), k - 1), "found", k)
        spent = asked.groupBy("site").agg(F.count_if("ok").alias("fetched"), F.count(F.lit(1)).alias("requests"))
        room = F.least(budget - F.col("fetched"), REQUESTS * budget - F.col("requests"))
        queue = found.join(asked.select("site", "url"), ["site", "url"], "left_anti")
        order = Window.partitionBy("site").orderBy(F.desc("priority"), "round", "rank", "place", "first", "url")
        best = queue.select("site", "url", "role", F.row_number().over(order).alias("n")).where(F.col("n") <= workers)
        best = best.join(spent, "site").where(F.col("n") <= room).select("site", "url", F.lit(k).alias("round"), F.col("n").alias("rank"), "role")
        asked = tables.add(judged(best, asked), "asked", k)
        now = tables.part("asked", k)
        if now.isEmpty():
            break
    return Crawl(asked, found, budget)
