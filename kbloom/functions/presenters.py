"""Fields as they are shown: records, composites, colours and facts, from JSON values.

A record becomes a card of title, subtitle, tags, body, details, url and image;
a composite becomes labelled details; facts are the filled plain fields as text.
All are column expressions over the JSON text of a field's value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbloom.functions import fields
from kbloom.functions.display import sentence_case

# Fixed values: (path, label, kind) of every field, in order.
LABELS = [
    ("companyName", "Company name", "text"),
    ("foundation.overview", "What the business does", "prose"),
    ("foundation.website", "Website", "link"),
    ("foundation.industry", "Industry", "text"),
    ("foundation.businessModel", "Who you sell to", "enum"),
    ("foundation.companyRole", "Type of business", "enum"),
    ("foundation.yearFounded", "Year founded", "number"),
    ("foundation.legalEntityType", "Legal entity", "text"),
    ("foundation.employeeCount", "Team size", "number"),
    ("foundation.revenue", "Revenue", "text"),
    ("foundation.mainAddress", "Main address", "composite"),
    ("foundation.otherLocations", "Other locations", "records"),
    ("foundation.serviceLocations", "Areas served", "chips"),
    ("foundation.altNames", "Also known as", "chips"),
    ("foundation.phone", "Phone", "text"),
    ("foundation.email", "Email", "text"),
    ("positioning.pitch", "Elevator pitch", "prose"),
    ("positioning.foundingStory", "Founding story", "prose"),
    ("market.buyers", "Who buys from you", "chips"),
    ("market.customerNeeds", "What customers need", "prose"),
    ("market.idealPersona", "Ideal customer", "prose"),
    ("market.industryGroupings", "Industry categories", "chips"),
    ("market.industryOutlook", "Industry outlook", "prose"),
    ("market.channels", "Where you find customers", "chips"),
    ("market.funnels", "How customers get in touch", "chips"),
    ("market.ctas", "Calls to action", "chips"),
    ("market.suppliersPartners", "Tools & partners", "chips"),
    ("branding.writingStyle", "Writing style", "composite"),
    ("branding.artStyle", "Visual style", "prose"),
    ("branding.fonts", "Fonts", "chips"),
    ("branding.colors", "Brand colours", "color"),
    ("branding.logos", "Logo", "link"),
    ("onlinePresence.profiles", "Social profiles", "records"),
    ("people", "Key people", "records"),
    ("offerings", "Products & services", "records"),
    ("proof.testimonials", "Testimonials", "records"),
    ("proof.aggregateRatings", "Review scores", "records"),
    ("proof.caseStudies", "Case studies", "records"),
    ("proof.certifications", "Licences & certifications", "records"),
    ("proof.memberships", "Memberships", "records"),
    ("proof.awards", "Awards", "records"),
    ("proof.pressMentions", "Press coverage", "records"),
    ("proof.trustStats", "Proof points", "records"),
    ("proof.guarantees", "Guarantees", "records"),
    ("proof.clientLogos", "Client logos", "records"),
    ("contentIntelligence.themes", "Content themes", "chips"),
    ("contentIntelligence.posts", "Articles & posts", "records"),
    ("contentIntelligence.taxonomy", "Blog categories & tags", "composite"),
    ("contentIntelligence.cadence", "Publishing cadence", "composite"),
    ("contentIntelligence.headlinePatterns", "Headline patterns", "records"),
    ("contentIntelligence.faqs", "Frequently asked questions", "records"),
    ("contentIntelligence.glossary", "Industry terms", "records"),
    ("contentIntelligence.seasonalSignals", "Seasonal offers", "records"),
    ("contentIntelligence.contentGaps", "Content gaps", "records"),
]
# Names of enumerated values that aren't their words.
ENUM_LABELS = {
    "b2b": "Businesses (B2B)", "b2c": "Consumers (B2C)", "b2b2c": "Businesses and their customers (B2B2C)", "b2g": "Government (B2G)", "linkedin": "LinkedIn", "facebook": "Facebook",
    "instagram": "Instagram", "x": "X (Twitter)", "youtube": "YouTube", "tiktok": "TikTok", "pinterest": "Pinterest", "yelp": "Yelp", "google-business": "Google Business Profile",
    "how-to": "How-to", "faq": "FAQ", "cta": "CTA",
}
# How a text speaks to its reader.
READERS = {"second-person": "“you”", "third-person": "“our customers”"}
EITHER_READER = "a mix of “you” and “our customers”"

Get = Callable[[Column], Column]


def enum_label(value: Column) -> Column:
    return F.coalesce(fields.by_key(ENUM_LABELS, value), sentence_case(value))


def rounded(number: Column) -> Column:
    """A whole number as it is, any other with one digit."""
    value = number.try_cast("double")
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.replace(F.format_number(value, 1), F.lit(","), F.lit("")))


def text(name: str) -> Get:
    return lambda r: F.nullif(F.trim(F.get_json_object(r, f"$.{name}")), F.lit(""))


def label(name: str, but: str | None = None) -> Get:
    """An enumerated attribute; ``but`` is a value that isn't shown."""
    return lambda r: F.when(~F.coalesce(text(name)(r) == F.lit(but if but else "\0"), F.lit(False)), enum_label(text(name)(r)))


def several(name: str, mark: str = " · ", most: int | None = None) -> Get:
    def get(r: Column) -> Column:
        held = F.from_json(F.get_json_object(r, f"$.{name}"), "array<string>")
        return F.nullif(F.array_join(held if most is None else F.slice(held, 1, most), mark), F.lit(""))

    return get


def joined(mark: str, *parts: Get) -> Get:
    return lambda r: F.nullif(F.concat_ws(mark, *[p(r) for p in parts]), F.lit(""))


def either(*parts: Get) -> Get:
    return lambda r: F.coalesce(*[p(r) for p in parts])


def given(test: Get, then: Get) -> Get:
    return lambda r: F.when(test(r).isNotNull(), then(r))


def rating(value: str, best: str | None) -> Get:
    top = lambda r: F.coalesce(rounded(text(best)(r)), F.lit("5")) if best else F.lit("5")
    return lambda r: F.concat(rounded(text(value)(r)), F.lit(" out of "), top(r))


def constant(value: str) -> Get:
    return lambda r: F.lit(value)


_CREDENTIAL = {"title": text("name"), "subtitle": text("issuer"), "tags": [label("kind")], "details": [("Number", text("identifier")), ("Valid until", text("validUntil"))], "url": text("verifyUrl")}
#: What a card shows of a record, by path; what isn't named is empty.
CARDS: dict[str, dict] = {
    "people": {
        "title": text("name"), "subtitle": text("title"), "tags": [label("role", "unknown")], "body": text("bio"), "url": either(text("profileUrl"), text("linkedin")), "image": text("imageUrl"),
        "details": [("Email", text("email")), ("Phone", text("phone")), ("Gender (guessed)", label("gender", "unknown"))],
    },
    "offerings": {"title": text("name"), "tags": [label("category")], "body": text("description"), "details": [("Price", text("pricing")), ("Includes", several("features"))], "url": text("url")},
    "onlinePresence.profiles": {"title": label("platform"), "subtitle": text("handle"), "url": text("url")},
    "foundation.otherLocations": {"title": text("formatted"), "details": [("City", text("city")), ("Region", text("region")), ("Country", text("country"))]},
    "proof.testimonials": {
        "title": either(text("authorName"), constant("Customer")), "subtitle": joined(", ", text("authorRole"), text("authorCompany"), text("authorLocation")), "tags": [label("platform"), rating("rating", None)],
        "body": lambda r: F.concat(F.lit("“"), text("quote")(r), F.lit("”")), "details": [("Date", text("date")), ("About", several("topics", ", "))], "url": text("mediaUrl"),
    },
    "proof.aggregateRatings": {"title": text("platform"), "subtitle": rating("ratingValue", "bestRating"), "details": [("Reviews", text("reviewCount"))]},
    "proof.caseStudies": {
        "title": text("title"), "subtitle": text("client"), "body": either(text("solution"), text("problem")), "url": text("url"),
        "details": [("Problem", given(text("solution"), text("problem"))), ("Results", several("results")), ("Numbers", several("metrics"))],
    },
    "proof.certifications": _CREDENTIAL,
    "proof.memberships": _CREDENTIAL,
    "proof.awards": {"title": text("name"), "subtitle": text("issuer"), "details": [("Year", text("year"))]},
    "proof.pressMentions": {"title": either(text("title"), text("outlet")), "subtitle": given(text("title"), text("outlet")), "tags": [label("kind")], "details": [("Date", text("date"))], "url": text("url")},
    "proof.trustStats": {"title": text("claim"), "tags": [label("category")], "details": [("As of", text("asOfDate"))]},
    "proof.guarantees": {"title": text("text"), "tags": [label("kind")], "body": text("terms")},
    "contentIntelligence.posts": {"title": text("title"), "subtitle": text("publishedAt"), "tags": [text("category")], "body": text("excerpt"), "details": [("By", text("author")), ("Words", text("wordCount"))], "url": text("url")},
    "contentIntelligence.headlinePatterns": {
        "title": label("pattern"), "subtitle": lambda r: F.concat(text("count")(r), F.when(text("count")(r) == "1", " post").otherwise(" posts")), "details": [("For example", several("examples", most=3))],
    },
    "contentIntelligence.faqs": {"title": text("question"), "tags": [text("topic")], "body": text("answer")},
    "contentIntelligence.glossary": {"title": text("term"), "body": text("definition")},
    "contentIntelligence.seasonalSignals": {"title": text("label"), "subtitle": text("period"), "body": text("text")},
    "contentIntelligence.contentGaps": {"title": text("topic"), "body": text("reason")},
}
#: Any other record.
PLAIN = {"title": either(text("name"), text("title"), text("label"), text("text"), constant("Untitled")), "body": either(text("description"), text("summary")), "url": text("url")}
#: Composites as labelled details.
COMPOSITES: dict[str, list[tuple[str, Get]]] = {
    "foundation.mainAddress": [("Address", text("formatted")), ("City", text("city")), ("Region", text("region")), ("Postal code", text("postalCode")), ("Country", text("country"))],
    "branding.writingStyle": [
        ("How it reads", text("description")), ("Tone", lambda r: F.nullif(F.array_join(F.transform(F.from_json(F.get_json_object(r, "$.tone"), "array<string>"), enum_label), ", "), F.lit(""))), ("Formality", label("formality")),
        ("Speaks to the reader as", lambda r: F.coalesce(fields.by_key(READERS, text("readerAddress")(r)), F.lit(EITHER_READER))),
        ("Words they use", several("preferredTerms", ", ")), ("Words they avoid", several("avoidTerms", ", ")), ("Calls to action", text("ctaStyle")),
    ],
    "contentIntelligence.taxonomy": [("Categories", several("categories", ", ")), ("Tags", several("tags", ", "))],
    "contentIntelligence.cadence": [
        ("How often they publish", lambda r: F.concat(rounded(text("postsPerMonth")(r)), F.lit(" posts a month"))), ("First post", text("firstPublished")), ("Latest post", text("lastPublished")),
        ("Last published", lambda r: F.concat(text("daysSinceLast")(r), F.lit(" days ago"), F.when(text("isStale")(r) == "true", " — the blog has gone quiet").otherwise(""))),
    ],
}


def details(record: Column, entries: list[tuple[str, Get]]) -> Column:
    """Labelled values, those without a value left out."""
    if not entries:
        return F.array().cast("array<struct<label: string, value: string>>")
    each = F.array(*[F.struct(F.lit(name).alias("label"), get(record).alias("value")) for name, get in entries])
    return F.filter(each, lambda d: d["value"].isNotNull())


def card(path: str, record: Column) -> Column:
    """struct(title, subtitle, tags, body, details, url, image) of a JSON record."""
    held = CARDS.get(path, PLAIN)
    none = F.lit(None).cast("string")
    one = lambda name: (held[name](record) if name in held else none).alias(name)
    tags = F.array_compact(F.array(*[t(record) for t in held["tags"]])) if held.get("tags") else F.array().cast("array<string>")
    return F.struct(F.coalesce(held["title"](record), F.lit("")).alias("title"), one("subtitle"), tags.alias("tags"), one("body"), details(record, held.get("details", [])).alias("details"), one("url"), one("image"))


def cards(found: DataFrame) -> DataFrame:
    """(site, path, position, key, title, subtitle, tags, body, details, url, image) of record fields.

    ``found(site, path, value)`` as `documents.collect` gives them; a record's key
    is its id, or else its path and place.
    """
    paths = [p for p, _, kind in LABELS if kind == "records"]
    each = found.where(F.col("path").isin(paths)).select("site", "path", F.posexplode(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")).alias("position", "v"))
    each = each.withColumn("record", F.to_json("v"))
    shown = card("", F.col("record"))
    for path in paths:
        shown = F.when(F.col("path") == path, card(path, F.col("record"))).otherwise(shown)
    key = F.coalesce(F.get_json_object("record", "$.id"), F.concat_ws("-", "path", F.col("position").cast("string")))
    return each.select("site", "path", "position", key.alias("key"), shown.alias("c")).select("site", "path", "position", "key", "c.*")


def composite(path: str, value: Column) -> Column:
    """Labelled details of a composite field's JSON value; empty for none."""
    return F.when(value.isNotNull() & (value != "null"), details(value, COMPOSITES[path])).otherwise(F.array().cast("array<struct<label: string, value: string>>"))


def colours(value: Column) -> Column:
    """Colours of a palette with their role and share of all uses."""
    held = F.from_json(value, "array<struct<hex: string, role: string, frequency: bigint>>")
    total = F.aggregate(held, F.lit(0).cast("long"), lambda s, c: s + F.coalesce(c["frequency"], F.lit(0)))
    role = lambda c: F.when(c["role"] == "unknown", "Other").otherwise(sentence_case(c["role"]))
    return F.transform(held, lambda c: F.struct(c["hex"].alias("hex"), role(c).alias("role"), F.when(total == 0, 0.0).otherwise(c["frequency"] / total).alias("share")))


# --- facts for a model ---


def fact(value: Column) -> Column:
    """A plain value's JSON as text: lists with commas, addresses by their line; null for what has none."""
    listed = F.try_variant_get(F.try_parse_json(value), "$", "array<variant>")
    one = lambda v: F.coalesce(F.try_variant_get(v, "$.formatted", "string"), F.when(~F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "string")))
    items = F.filter(F.transform(listed, one), lambda x: x.isNotNull() & (x != ""))
    return F.nullif(F.when(value.startswith("["), F.array_join(items, ", ")).otherwise(one(F.try_parse_json(value))), F.lit(""))


def facts(found: DataFrame, origins: DataFrame) -> DataFrame:
    """(site, place, label, value, source_url): what is known already, for a model to rely on.

    ``found(site, path, value, method, urls)`` as `documents.collect` gives them and
    ``origins(site, origin)``.  Records and composites, empty fields and what a
    model wrote are left out; a fact without a source has the site's origin.
    """
    table = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(p).alias("path"), F.lit(name).alias("label")) for k, (p, name, kind) in enumerate(LABELS) if kind not in ("records", "composite")])
    named = origins.select("site", "origin", F.inline(table))
    rows = found.where(~F.col("method").isin("ai-live", "ai-mock")).select("site", "path", fact(F.col("value")).alias("value"), F.get("urls", F.lit(0)).alias("source")).where("value is not null")
    return rows.join(named, ["site", "path"]).select("site", "place", "label", "value", F.coalesce("source", "origin").alias("source_url"))


def fact_lines(rows: DataFrame) -> DataFrame:
    """(site, facts): a site's facts as lines, in the order of the field table; no more than the table has."""
    line = F.concat(F.lit("- "), F.col("label"), F.lit(": "), F.col("value"), F.lit("   [from "), F.col("source_url"), F.lit("]"))
    return rows.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n").alias("facts"))
