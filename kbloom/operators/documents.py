"""Documents from claims: a company's nested record, with provenance and quality.

Claims are reconciled to one field for each site and path, scalars, string lists
and record lists alike; the field table (`fields.FIELDS`) places each field in the
document.  A field is an envelope of value, method, confidence, source URLs and a
note if it has one; a field that nothing was found for says so.  What needs the
whole site is derived from its fields, and quality from the finished envelopes.

Everything is grouped by site and path first, and by site once, at the end: a
document is one row, of a site that was crawled under a budget of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbloom.functions import fields, urls
from kbloom.functions import text as T
from kbloom.functions.dialect import half_up
from kbloom.operators import extract, quality, reconcile
from kbloom.sources.scratch import Tables

# Paths of string lists, and the attributes that tell the records of a list apart.
STRING_LISTS = [
    "foundation.otherLocations", "foundation.serviceLocations", "foundation.altNames", "market.buyers", "market.industryGroupings",
    "market.channels", "market.funnels", "market.ctas", "market.suppliersPartners", "branding.fonts",
]
RECORD_KEYS = {
    "people": ("name",),
    "offerings": ("name",),
    "branding.logos": ("url",),
    "branding.colors": ("hex",),
    "onlinePresence.profiles": ("url",),
    "proof.testimonials": ("quote",),
    "proof.aggregateRatings": ("platform", "ratingValue"),
    "proof.caseStudies": ("title",),
    "proof.certifications": ("name",),
    "proof.memberships": ("name",),
    "proof.awards": ("name",),
    "proof.pressMentions": ("outlet",),
    "proof.trustStats": ("claim",),
    "proof.guarantees": ("text",),
    "proof.clientLogos": ("url",),
    "contentIntelligence.posts": ("url",),
    "contentIntelligence.faqs": ("question",),
    "contentIntelligence.glossary": ("term",),
    "contentIntelligence.seasonalSignals": ("label",),
    "contentIntelligence.themes": ("label",),
    "contentIntelligence.contentGaps": ("topic",),
    "contentIntelligence.headlinePatterns": ("pattern",),
}
#: Keys that are compared as they are, and those with rules of their own; others in lower case.
_EXACT = ["branding.logos", "branding.colors", "onlinePresence.profiles", "proof.aggregateRatings", "proof.clientLogos", "contentIntelligence.posts", "contentIntelligence.headlinePatterns"]
#: Scalar fields that are numbers.
NUMBERS = ["foundation.yearFounded", "foundation.employeeCount"]
# Channels that a linked profile stands for.
CHANNELS = {
    "linkedin": "LinkedIn", "facebook": "Facebook", "instagram": "Instagram", "x": "X (Twitter)", "youtube": "YouTube", "tiktok": "TikTok",
    "pinterest": "Pinterest", "yelp": "Yelp", "google-business": "Google Business Profile",
}
#: Order of a document's parts.
CATEGORIES = ["foundation", "positioning", "market", "branding", "onlinePresence", "people", "offerings", "proof", "contentIntelligence"]
VERSION = "1"
STALE_DAYS = 90

# --- JSON text ---


def quoted(text: Column) -> Column:
    """A string as JSON text; null as null."""
    whole = F.to_json(F.array(text))
    return F.coalesce(F.when(text.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2)), F.lit("null"))


def strings(array: Column) -> Column:
    return F.to_json(F.coalesce(array, F.array().cast("array<string>")))


def objects(array: Column) -> Column:
    """JSON texts as one JSON array."""
    return F.concat(F.lit("["), F.array_join(array, ","), F.lit("]"))


def member(name: str, text: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), text)


def obj(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def envelope(value: Column, method: Column, confidence: Column, sources: Column, note: Column) -> Column:
    """A field: ``value`` is JSON text, a missing note is left out."""
    return obj(member("value", F.coalesce(value, F.lit("null"))), member("method", quoted(method)), member("confidence", confidence.cast("string")), member("sourceUrls", strings(sources)), F.when(note.isNotNull(), member("note", quoted(note))))


NOT_FOUND = '{"value":null,"method":"not-found","confidence":0.0,"sourceUrls":[]}'


# --- claims to fields ---


def record_key(path: Column, value: Column) -> Column:
    """What tells a JSON record of a list from the others; null for none."""
    out = F.lit(None).cast("string")
    for name, parts in RECORD_KEYS.items():
        one = F.concat_ws("|", *[F.coalesce(F.get_json_object(value, f"$.{p}"), F.lit("")) for p in parts])
        one = one if name in _EXACT else T.offering_key(one) if name == "offerings" else T.quote_key(one) if name == "proof.testimonials" else F.trim(F.lower(one)) if name == "people" else F.lower(one)
        out = F.when(path == name, one).otherwise(out)
    return F.nullif(F.nullif(out, F.lit("")), F.lit("|"))


def _fill(first: Column, second: Column) -> Column:
    """A record with what it lacks from another; lists of strings are united."""

    def one(_: Column, a: Column, b: Column) -> Column:
        empty = a.isNull() | F.is_variant_null(a) | F.coalesce(F.try_variant_get(a, "$", "string") == "", F.lit(False))
        x, y = (F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<string>")) for v in (a, b))
        both = x.isNotNull() & y.isNotNull()
        return F.when(empty, F.coalesce(b, a)).when(both, F.parse_json(F.to_json(F.array_union(x, y)))).otherwise(a)

    return F.map_zip_with(first, second, one)


def _records(claims: DataFrame) -> DataFrame:
    each = claims.withColumn("value", F.when(F.ltrim("value").startswith("{"), F.col("value")).otherwise(F.to_json(F.struct(F.col("value").alias("url")))))
    each = each.withColumn("key", record_key(F.col("path"), F.col("value"))).where(F.col("key").isNotNull() & F.try_parse_json("value").isNotNull())
    each = each.withColumn("record", F.parse_json("value").cast("map<string,variant>"))
    merged = reconcile.merged_records(each, ["record"], _fill)
    mark = F.substring(F.sha2(F.concat_ws("|", F.col("site").cast("string"), "path", "key"), 256), 1, 12)
    body = F.to_json(F.map_filter("record", lambda k, _: ~k.isin("id", "method", "confidence", "sourceUrls")))
    text = obj(member("id", quoted(mark)), F.nullif(F.expr("substring(body, 2, length(body) - 2)"), F.lit("")), member("method", quoted(fields.origin(F.col("claimed")))), member("confidence", F.col("confidence").cast("string")), member("sourceUrls", strings(F.col("urls"))))
    rows = merged.withColumn("body", body).withColumn("text", text)
    best = F.min_by("claimed", F.struct((-F.col("tier")).alias("t"), "seq"))
    held = rows.groupBy("site", "path").agg(F.array_sort(F.collect_list(F.struct("seq", "text", "confidence", "url"))).alias("r"), best.alias("claimed"))
    total = F.aggregate("r", F.lit(0.0), lambda a, x: a + x["confidence"])
    return held.select(
        "site", "path", objects(F.transform("r", lambda x: x["text"])).alias("value"), fields.origin(F.col("claimed")).alias("method"), half_up(total / F.size("r"), 3).alias("confidence"),
        F.array_distinct(F.transform("r", lambda x: x["url"])).alias("urls"), F.lit(None).cast("string").alias("note"),
    )


def collect(claims: DataFrame) -> DataFrame:
    """(site, path, value, method, confidence, urls, note): claims reconciled by the kind of their path.

    ``claims(site, path, seq, value, method, role, confidence, url, note)``; seq is
    the order of arrival within a site.  Values of records are JSON objects, and a
    plain value is a record's url.  Paths that the field table doesn't have are
    left out, as are records without a key and null values.
    """
    known = claims.where(F.col("path").isin([p for p, *_ in fields.FIELDS]) & F.col("value").isNotNull())
    listed, recorded = F.col("path").isin(STRING_LISTS), F.col("path").isin(list(RECORD_KEYS))
    scalars = reconcile.scalar_fields(known.where(~listed & ~recorded))
    number = F.col("value").try_cast("long")
    value = F.when(F.col("path").isin(NUMBERS), F.coalesce(number.cast("string"), F.lit("null"))).when(F.col("path") == "foundation.mainAddress", obj(member("formatted", quoted(F.col("value"))))).otherwise(quoted(F.col("value")))
    out = scalars.select("site", "path", value.alias("value"), "method", "confidence", F.col("url_list").alias("urls"), "note")
    lists = reconcile.list_fields(known.where(listed)).select("site", "path", strings(F.col("items")).alias("value"), "method", "confidence", "urls", F.lit(None).cast("string").alias("note"))
    return out.unionByName(lists).unionByName(_records(known.where(recorded)))


# --- fields to documents ---


def wide(found: DataFrame, sites: DataFrame) -> DataFrame:
    """``sites`` with a struct of each path's field, named by its place in the field table."""
    field = F.struct("value", "method", "confidence", "urls", "note")
    every = [F.max_by(F.when(F.col("path") == path, field), F.col("path") == path).alias(f"f{k}") for k, (path, *_) in enumerate(fields.FIELDS)]
    return sites.join(found.groupBy("site").agg(*every), "site", "left")


def _place(path: str) -> str:
    return f"f{[p for p, *_ in fields.FIELDS].index(path)}"


_POST = "array<struct<title: string, url: string, publishedAt: string, category: string, excerpt: string>>"


def _dates(posts: Column) -> Column:
    return F.filter(F.transform(posts, lambda p: F.try_to_timestamp(p["publishedAt"]).cast("timestamp_ntz")), lambda d: d.isNotNull())


def _parsed(rows: DataFrame) -> DataFrame:
    """What derivations read of each site, parsed once."""
    value = lambda path: F.col(f"{_place(path)}.value")
    read = lambda path, kind: F.coalesce(F.from_json(value(path), kind), F.array().cast(kind))
    profiles = read("onlinePresence.profiles", "array<struct<platform: string, url: string>>")
    platform = lambda p: F.coalesce(p["platform"], urls.social_profile(urls.normalize_url(p["url"]), F.lit("-"))["platform"])
    website = value("foundation.website")
    return rows.select(
        "site", "origin", "now", "page_urls", (website.isNull() | website.isin("null", '""')).alias("no_website"), F.coalesce(~value("foundation.phone").isin("null", '""'), F.lit(False)).alias("phone"),
        read("contentIntelligence.posts", _POST).alias("posts"), read("offerings", "array<struct<id: string, name: string>>").alias("offers"),
        F.transform(profiles, platform).alias("platforms"), F.lower(F.array_join(read("market.funnels", "array<string>"), " ")).alias("funnels"),
    )


def derive(rows: DataFrame) -> DataFrame:
    """(site, path, value, ...): fields that follow from others of the site, by its row of `wide`.

    ``rows`` has origin, now and page_urls.  A site without a website has its
    origin; cadence, headline patterns, taxonomy and content gaps come from posts
    and offerings, channels from profiles, posts, funnels and the phone.  What
    would be empty has no row.
    """
    each = _parsed(rows)
    dates = _dates(F.col("posts"))
    titles = F.filter(F.transform("posts", lambda p: F.trim(F.coalesce(p["title"], F.lit("")))), lambda t: t != "")
    each = each.withColumns({
        "first": F.array_min(dates), "last": F.array_max(dates), "dated": F.size(dates), "titles": F.transform(titles, lambda t, i: F.struct(T.headline(t).alias("pattern"), t.alias("title"), i.alias("at"))),
        "kinds": F.slice(F.array_distinct(F.filter(F.transform("posts", lambda p: p["category"]), lambda c: c.isNotNull() & (c != ""))), 1, 30),
        "hay": F.lower(F.concat_ws(" ", F.transform("posts", lambda p: F.concat_ws(" ", p["title"], p["excerpt"])), "page_urls")),
        "channels": F.array_distinct(F.array_compact(F.concat(F.transform("platforms", lambda p: fields.by_key(CHANNELS, p)), F.array(
            F.when(F.size("posts") > 0, "Blog / organic search"), F.when(F.col("funnels").rlike("form|quote|booking|checkout|contact"), "Website"),
            F.when(F.col("phone") | F.col("funnels").rlike("phone|call"), "Phone"), F.when(F.col("funnels").rlike("newsletter|email"), "Email"),
        )))),
    })
    micros = lambda a, b: F.timestamp_diff("MICROSECOND", F.col(a), F.col(b))
    months, days = micros("first", "last") / F.lit(2630016000000.0), F.floor(micros("last", "now") / F.lit(86400000000.0))
    day = lambda c: F.coalesce(F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd"), F.lit('"')), F.lit("null"))
    cadence = obj(
        member("postsPerMonth", F.coalesce(half_up(F.col("dated") / F.greatest(F.lit(1.0), months), 2).cast("string"), F.lit("null"))), member("firstPublished", day("first")), member("lastPublished", day("last")),
        member("daysSinceLast", F.coalesce(F.greatest(F.lit(0), days).cast("string"), F.lit("null"))), member("isStale", F.coalesce((days > STALE_DAYS).cast("string"), F.lit("false"))),
    )
    groups = F.transform(F.array_distinct(F.transform("titles", lambda t: t["pattern"])), lambda p: F.struct(p.alias("pattern"), F.filter("titles", lambda t: t["pattern"] == p).alias("t")))
    kept = F.filter(groups, lambda g: (g["pattern"] != "other") | (F.size(g["t"]) >= 3))
    placed = F.array_sort(F.transform(kept, lambda g: F.struct((-F.size(g["t"])).alias("n"), g["t"][0]["at"].alias("at"), g["pattern"].alias("pattern"), g["t"].alias("t"))))
    shown = lambda g: obj(member("pattern", quoted(g["pattern"])), member("count", (-g["n"]).cast("string")), member("examples", strings(F.transform(F.slice(g["t"], 1, 3), lambda t: t["title"]))), F.lit('"method":"derived","confidence":0.7,"sourceUrls":[]'))
    uncovered = F.slice(F.filter("offers", lambda o: F.exists(T.significant(o["name"]), lambda w: ~F.contains(F.col("hay"), w))), 1, 10)
    reason = F.when(F.size("posts") == 0, "Listed as an offering, but the site has no articles at all").otherwise("Listed as an offering but has no dedicated page or article")
    gap = lambda o: obj(member("topic", quoted(o["name"])), member("reason", quoted(reason)), member("relatedOffering", quoted(o["id"])), F.lit('"method":"derived","confidence":0.6,"sourceUrls":[]'))
    made = [
        ("foundation.website", F.when(F.col("no_website"), quoted(F.col("origin"))), 0.95, F.array("origin")),
        ("contentIntelligence.cadence", F.when(F.size("posts") > 0, cadence), 0.75, None),
        ("contentIntelligence.headlinePatterns", objects(F.transform(placed, shown)), 0.7, None),
        ("contentIntelligence.taxonomy", F.when(F.size("kinds") > 0, obj(member("categories", strings(F.col("kinds"))), F.lit('"tags":[]'))), 0.8, None),
        ("contentIntelligence.contentGaps", objects(F.transform(uncovered, gap)), 0.6, None),
        ("market.channels", strings(F.col("channels")), 0.55, None),
    ]
    field = lambda path, value, confidence, sources: F.struct(F.lit(path).alias("path"), value.alias("value"), F.lit("derived").alias("method"), F.lit(confidence).alias("confidence"), (F.col("page_urls") if sources is None else sources).alias("urls"), F.lit(None).cast("string").alias("note"))
    return each.select("site", F.inline(F.array(*[field(*m) for m in made]))).where("value is not null and value <> '[]'")


def filled(rows: DataFrame) -> DataFrame:
    """(site, path, ..., filled): the field table beside each site of `wide`."""
    value = lambda k: F.col(f"f{k}.value")
    full = F.array(*[F.coalesce(~F.trim(value(k)).isin("null", "[]", '""') & ~value(k).rlike('^"\\\\s*"$'), F.lit(False)) for k in range(len(fields.FIELDS))])
    return rows.select("site", full.alias("full")).select("site", "full", F.inline(fields.rows())).withColumn("filled", F.get("full", F.col("place"))).drop("full")


def quality_of(rows: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(site, quality): scores, missing fields, conflicts and questions as JSON text."""
    full = filled(rows)
    order = fields.by_key({c: k for k, c in enumerate(CATEGORIES)}, F.col("category"))
    each = F.struct(order.alias("k"), obj(member("category", quoted(F.col("category"))), member("score", F.col("score").cast("string")), member("filledFields", F.col("filled_fields").cast("string")), member("totalFields", F.col("total_fields").cast("string"))).alias("t"))
    texts = lambda name: F.transform(F.array_sort(F.collect_list(name)), lambda x: x["t"])
    scores = quality.category_scores(full).groupBy("site").agg(objects(texts(each)).alias("scores"))
    gone = quality.missing(full).groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("missing"))
    ask = F.struct(F.col("rank").alias("k"), obj(member("id", quoted(F.col("id"))), member("fills", strings(F.split("fills", "\\|"))), member("priority", F.col("priority").cast("string")), F.lit('"answered":false')).alias("t"))
    asked = quality.questions(full).groupBy("site").agg(objects(texts(ask)).alias("questions"))
    one = F.transform("candidates", lambda c: obj(member("value", quoted(c["value"])), member("sourceUrl", quoted(c["url"])), member("confidence", c["confidence"].cast("string"))))
    clash = F.struct(F.col("path").alias("k"), obj(member("path", quoted(F.col("path"))), member("label", quoted(F.substring_index("path", ".", -1))), member("candidates", objects(one)), F.lit('"resolved":false')).alias("t"))
    open_ = conflicts.where("n_values > 1").groupBy("site").agg(objects(texts(clash)).alias("conflicts"))
    out = rows.select("site").join(quality.overall_score(full), "site").join(scores, "site").join(gone, "site", "left").join(asked, "site", "left").join(open_, "site", "left")
    none = F.lit("[]")
    text = obj(member("overallScore", F.col("score").cast("string")), member("categoryScores", F.col("scores")), member("missingFields", strings(F.col("missing"))), member("conflicts", F.coalesce("conflicts", none)), member("followUpQuestions", F.coalesce("questions", none)))
    return out.select("site", text.alias("quality"))


def scraped(pages: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """(site, scrape, page_urls): what was read of each site, as JSON text.

    ``pages(site, place, url, role, status, bytes, fetched_at)``; ``warnings(site,
    seq, code, message, url)``.
    """
    page = obj(member("url", quoted(F.col("url"))), member("role", quoted(F.col("role"))), member("status", F.coalesce(F.col("status").cast("string"), F.lit("null"))), member("bytes", F.coalesce(F.col("bytes").cast("string"), F.lit("null"))), member("fetchedAt", quoted(F.col("fetched_at"))))
    held = pages.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("place", "url", page.alias("t")))).alias("p"), F.min("fetched_at").alias("a"), F.max("fetched_at").alias("b"))
    if warnings is None:
        held = held.withColumn("w", F.array().cast("array<string>"))
    else:
        said = obj(member("code", quoted(F.col("code"))), member("message", quoted(F.col("message"))), member("url", quoted(F.col("url"))))
        held = held.join(warnings.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", said.alias("t")))), lambda x: x["t"]).alias("w")), "site", "left").withColumn("w", F.coalesce("w", F.array().cast("array<string>")))
    text = obj(member("startedAt", quoted(F.col("a"))), member("finishedAt", quoted(F.col("b"))), member("pages", objects(F.transform("p", lambda x: x["t"]))), F.lit('"robotsRespected":true'), member("warnings", objects(F.col("w"))), F.lit(f'"scraperVersion":"{VERSION}"'))
    return held.select("site", text.alias("scrape"), F.transform("p", lambda x: x["url"]).alias("page_urls"))


def assemble(rows: DataFrame) -> DataFrame:
    """(site, document) of `wide` rows that have origin, scrape and quality."""
    def text(k: int) -> Column:
        f = F.col(f"f{k}")
        return F.when(f.isNull(), F.lit(NOT_FOUND)).otherwise(envelope(f["value"], f["method"], f["confidence"], f["urls"], f["note"]))

    top, nested = [member("sourceUrl", quoted(F.col("origin"))), member("scrape", F.col("scrape"))], {}
    for k, (path, *_) in enumerate(fields.FIELDS):
        head, _, name = path.partition(".")
        if name:
            nested.setdefault(head, []).append(member(name, text(k)))
        else:
            nested[head] = member(head, text(k))
    for head, held in nested.items():
        top.append(held if isinstance(held, Column) else member(head, obj(*held)))
    return rows.select("site", obj(*top, member("quality", F.col("quality"))).alias("document"))


def from_claims(spark: SparkSession, claims: DataFrame, sites: DataFrame, pages: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """(site, document): claims, reconciled, placed, completed and judged.

    ``sites(site, origin, now)`` names the documents, also those without a claim;
    ``pages`` and ``warnings`` are as `scraped` takes them.
    """
    tables = Tables(spark, "documents")
    claims = tables.save(claims, "claims")
    found = tables.save(collect(claims), "fields")
    sites = tables.save(sites.join(scraped(pages, warnings), "site"), "sites")
    derived = tables.save(derive(wide(found, sites)), "derived")
    whole = found.join(derived.select("site", "path"), ["site", "path"], "left_anti").unionByName(derived)
    rows = tables.save(wide(whole, sites), "wide")
    known = claims.where(~F.col("path").isin(STRING_LISTS + list(RECORD_KEYS)) & F.col("value").isNotNull())
    return assemble(rows.join(quality_of(rows, reconcile.scalars(known)), "site"))


def build(spark: SparkSession, pages: DataFrame, sites: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """(site, document) from crawled pages: claims of every page, then `from_claims`.

    ``pages(site, place, page_id, url, role, html, status, bytes, fetched_at)``.
    """
    found = extract.claims(pages)
    named = found.join(pages.select("page_id", "site", "place", "url", "role"), "page_id")
    order = F.struct("place", "extractor", "seq")
    claims = named.select("site", "path", order.alias("o"), "value", "method", "role", "confidence", "url", F.lit(None).cast("string").alias("note"))
    # one number for the order of arrival
    number = F.col("o.place").cast("long") * F.lit(1 << 40) + F.col("o.extractor").cast("long") * F.lit(1 << 32) + F.col("o.seq").cast("long")
    return from_claims(spark, claims.withColumn("seq", number).drop("o"), sites, pages, warnings)
