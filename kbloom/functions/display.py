"""How records and fields are shown: one line each, which diffs compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The columns that make a record's line, by path: title, then subtitle.
LINES = {
    "people": ("name", "title"),
    "offerings": ("name", None),
    "onlinePresence.profiles": ("platform", "handle"),
    "foundation.otherLocations": ("formatted", None),
    "proof.testimonials": ("authorName", "authorCompany"),
    "proof.aggregateRatings": ("platform", "ratingValue"),
    "proof.caseStudies": ("title", "client"),
    "proof.certifications": ("name", "issuer"),
    "proof.memberships": ("name", "issuer"),
    "proof.awards": ("name", "issuer"),
    "proof.pressMentions": ("outlet", "title"),
    "proof.trustStats": ("claim", None),
    "proof.guarantees": ("text", None),
    "contentIntelligence.posts": ("title", "publishedAt"),
    "contentIntelligence.faqs": ("question", None),
    "contentIntelligence.glossary": ("term", None),
    "contentIntelligence.seasonalSignals": ("label", "period"),
    "contentIntelligence.contentGaps": ("topic", None),
    "contentIntelligence.headlinePatterns": ("pattern", "count"),
}


def sentence_case(text: Column) -> Column:
    spaced = F.regexp_replace(text, "[-_]+", " ")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1_000_000))


def record_line(path: str, record: Column) -> Column:
    """A JSON record as its title and subtitle, joined by a dash."""
    title, subtitle = LINES.get(path, ("name", None))
    head = F.get_json_object(record, f"$.{title}")
    if title == "platform":
        head = sentence_case(head)
    if path == "proof.testimonials":
        head = F.coalesce(head, F.lit("Customer"))
    tail = F.nullif(F.get_json_object(record, f"$.{subtitle}"), F.lit("")) if subtitle else F.lit(None).cast("string")
    return F.concat_ws(" — ", F.nullif(head, F.lit("")), tail)


def colour_line(hex_: Column, role: Column) -> Column:
    return F.concat(hex_, F.lit(" ("), role, F.lit(")"))


def scalar(path: str, value: Column) -> Column:
    """A number with separators, but a year as it is."""
    number = value.try_cast("long")
    return value if path == "foundation.yearFounded" else F.when(number.isNotNull(), F.format_number(number, 0)).otherwise(value)


def source_summary(labels: Column) -> Column:
    """Where a value was found, from the labels of its pages."""
    n, first = F.size(labels), F.get(labels, F.lit(0))
    return (
        F.when(n == 1, F.concat(F.lit("Found on "), first, F.lit(".")))
        .when(n == 2, F.concat(F.lit("Found on "), first, F.lit(" and "), F.get(labels, F.lit(1)), F.lit(".")))
        .when(n > 2, F.concat(F.lit("Found on "), first, F.lit(" and "), (n - 1).cast("string"), F.lit(" other pages.")))
    )
