"""The fields of a company's record, and tests on a field's envelope."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (path, impact, askable, answer cost, group, substitutes), in order.
FIELDS = [
    ("companyName", 5, True, 1, None, ()),
    ("foundation.overview", 5, True, 2, None, ("positioning.pitch",)),
    ("foundation.website", 5, True, 1, None, ()),
    ("foundation.industry", 5, True, 1, None, ()),
    ("foundation.businessModel", 4, True, 1, None, ()),
    ("foundation.companyRole", 3, True, 1, None, ()),
    ("foundation.yearFounded", 3, True, 1, None, ()),
    ("foundation.legalEntityType", 2, True, 1, None, ()),
    ("foundation.employeeCount", 3, True, 1, None, ()),
    ("foundation.revenue", 1, True, 2, None, ()),
    ("foundation.mainAddress", 5, True, 1, "location", ()),
    ("foundation.otherLocations", 4, True, 1, "location", ()),
    ("foundation.serviceLocations", 5, True, 1, "location", ()),
    ("foundation.altNames", 2, True, 1, None, ()),
    ("foundation.phone", 4, True, 1, "contact", ()),
    ("foundation.email", 3, True, 1, "contact", ()),
    ("positioning.pitch", 5, False, 2, None, ("foundation.overview",)),
    ("positioning.foundingStory", 4, True, 2, None, ()),
    ("market.buyers", 5, True, 2, None, ()),
    ("market.customerNeeds", 4, False, 2, None, ("market.buyers",)),
    ("market.idealPersona", 4, True, 3, None, ("market.buyers",)),
    ("market.industryGroupings", 2, False, 1, None, ()),
    ("market.industryOutlook", 2, False, 3, None, ()),
    ("market.channels", 3, True, 2, None, ()),
    ("market.funnels", 3, False, 1, None, ()),
    ("market.ctas", 3, False, 1, None, ()),
    ("market.suppliersPartners", 2, False, 1, None, ()),
    ("branding.writingStyle", 4, False, 3, None, ()),
    ("branding.artStyle", 3, False, 3, None, ()),
    ("branding.fonts", 2, False, 2, None, ()),
    ("branding.colors", 3, False, 2, None, ()),
    ("branding.logos", 4, True, 1, None, ()),
    ("onlinePresence.profiles", 4, True, 1, None, ()),
    ("people", 4, True, 2, None, ()),
    ("offerings", 5, True, 2, None, ()),
    ("proof.testimonials", 5, True, 2, None, ()),
    ("proof.aggregateRatings", 3, False, 1, None, ()),
    ("proof.caseStudies", 3, True, 3, None, ()),
    ("proof.certifications", 4, True, 1, "credentials", ()),
    ("proof.memberships", 3, True, 1, "credentials", ()),
    ("proof.awards", 2, True, 1, "credentials", ()),
    ("proof.pressMentions", 2, True, 2, None, ()),
    ("proof.trustStats", 4, True, 1, None, ()),
    ("proof.guarantees", 4, True, 1, None, ()),
    ("proof.clientLogos", 2, False, 2, None, ()),
    ("contentIntelligence.themes", 3, False, 2, None, ()),
    ("contentIntelligence.posts", 3, False, 2, None, ()),
    ("contentIntelligence.taxonomy", 1, False, 1, None, ()),
    ("contentIntelligence.cadence", 2, False, 1, None, ()),
    ("contentIntelligence.headlinePatterns", 2, False, 2, None, ()),
    ("contentIntelligence.faqs", 4, True, 2, None, ()),
    ("contentIntelligence.glossary", 3, True, 3, None, ()),
    ("contentIntelligence.seasonalSignals", 2, True, 1, None, ()),
    ("contentIntelligence.contentGaps", 3, False, 3, None, ()),
]

# Precedence and confidence of a claim's method, weight of a page's role.
METHODS = {"json-ld": (5, 0.95), "opengraph": (4, 0.85), "meta": (4, 0.8), "computed": (3, 0.7), "dom": (2, 0.65), "heuristic": (1, 0.45)}
ROLE_WEIGHTS = {
    "contact": 1.0, "about": 0.98, "home": 0.95, "team": 0.9, "services": 0.88, "products": 0.88, "pricing": 0.85, "testimonials": 0.85,
    "faq": 0.8, "legal": 0.75, "blog-index": 0.6, "blog-post": 0.55, "other": 0.7,
}

#: Share of a question's priority that is left if a substitute is known.
SUBSTITUTE_PENALTY = 0.3
MOST_QUESTIONS = 6


def category(path: str) -> str:
    return "foundation" if path == "companyName" else path.split(".")[0]


def by_key(table: dict, key: Column) -> Column:
    """A lookup of a small literal table; null for what it doesn't have."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def tier(method: Column) -> Column:
    return by_key({m: t for m, (t, _) in METHODS.items()}, method)


def score(confidence: Column, role: Column) -> Column:
    return confidence * by_key(ROLE_WEIGHTS, role)


def origin(method: Column) -> Column:
    """How a reconciled field was had: derived or scraped."""
    return F.when(method == "computed", "derived").otherwise("scraped")


def needs_review(method: Column, note: Column, value: Column, confidence: Column) -> Column:
    """Whether a person should look: a model's, a flagged or an unsure value."""
    return F.when(method == "user-edited", False).when(method.isin("ai-live", "ai-mock"), True).when(note.isNotNull(), True).otherwise(value.isNotNull() & (confidence < 0.5))


def rows() -> Column:
    """The field table as an array of structs, to be exploded beside a site."""
    every = []
    for k, (path, impact, askable, cost, group, substitutes) in enumerate(FIELDS):
        every.append(
            F.struct(
                F.lit(k).alias("place"), F.lit(path).alias("path"), F.lit(category(path)).alias("category"), F.lit(impact).alias("impact"), F.lit(askable).alias("askable"),
                F.lit(cost).alias("cost"), F.lit(group).cast("string").alias("grp"), F.array(*map(F.lit, substitutes)).cast("array<string>").alias("substitutes"),
            )
        )
    return F.array(*every)
