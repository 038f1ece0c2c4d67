"""Cards, composites, colours and facts of JSON values."""

import json

import pytest
from pyspark.sql import functions as F

from kbloom.functions import fields, presenters

CASES = [
    ("people", {"id": "p", "name": "Ann", "title": "Owner", "role": "team-lead", "bio": "b", "email": "e", "phone": " ", "gender": "female", "linkedin": "l", "imageUrl": "i"}, ("Ann", "Owner", ["Team lead"], "b", ["Email: e", "Gender (guessed): Female"], "l", "i")),
    ("people", {"name": "Bo", "role": "unknown", "gender": "unknown", "profileUrl": "p", "linkedin": "l"}, ("Bo", None, [], None, [], "p", None)),
    ("offerings", {"name": "Drill", "category": "service", "description": "d", "features": ["a", "b"], "pricing": "$5", "url": "u"}, ("Drill", None, ["Service"], "d", ["Price: $5", "Includes: a · b"], "u", None)),
    ("offerings", {"name": "Drill", "features": []}, ("Drill", None, [], None, [], None, None)),
    ("onlinePresence.profiles", {"platform": "google-business", "handle": "h", "url": "u"}, ("Google Business Profile", "h", [], None, [], "u", None)),
    ("foundation.otherLocations", {"formatted": "1 St", "city": "Waco", "country": "US"}, ("1 St", None, [], None, ["City: Waco", "Country: US"], None, None)),
    ("proof.testimonials", {"quote": "Good", "authorRole": "CEO", "authorLocation": "Waco", "platform": "yelp", "rating": 4.5, "topics": ["x", "y"], "date": "2024"}, ("Customer", "CEO, Waco", ["Yelp", "4.5 out of 5"], "“Good”", ["Date: 2024", "About: x, y"], None, None)),
    ("proof.testimonials", {"quote": "Good", "authorName": "Al", "rating": None}, ("Al", None, [], "“Good”", [], None, None)),
    ("proof.aggregateRatings", {"platform": "yelp", "ratingValue": 4, "bestRating": 10, "reviewCount": 1200}, ("yelp", "4 out of 10", [], None, ["Reviews: 1200"], None, None)),
    ("proof.caseStudies", {"title": "T", "client": "C", "problem": "p", "solution": "s", "results": ["r"], "metrics": ["1", "2"]}, ("T", "C", [], "s", ["Problem: p", "Results: r", "Numbers: 1 · 2"], None, None)),
    ("proof.caseStudies", {"title": "T", "problem": "p"}, ("T", None, [], "p", [], None, None)),
    ("proof.certifications", {"name": "N", "issuer": "I", "kind": "license", "identifier": "7", "validUntil": "2030", "verifyUrl": "v"}, ("N", "I", ["License"], None, ["Number: 7", "Valid until: 2030"], "v", None)),
    ("proof.memberships", {"name": "N", "kind": "membership"}, ("N", None, ["Membership"], None, [], None, None)),
    ("proof.awards", {"name": "N", "issuer": "I", "year": 1999}, ("N", "I", [], None, ["Year: 1999"], None, None)),
    ("proof.pressMentions", {"title": "T", "outlet": "O", "kind": "press-release", "date": "d", "url": "u"}, ("T", "O", ["Press release"], None, ["Date: d"], "u", None)),
    ("proof.pressMentions", {"outlet": "O", "kind": "podcast"}, ("O", None, ["Podcast"], None, [], None, None)),
    ("proof.trustStats", {"claim": "500 wells", "category": "volume", "asOfDate": "2024"}, ("500 wells", None, ["Volume"], None, ["As of: 2024"], None, None)),
    ("proof.guarantees", {"text": "Insured", "kind": "insurance", "terms": "t"}, ("Insured", None, ["Insurance"], "t", [], None, None)),
    ("contentIntelligence.posts", {"title": "T", "publishedAt": "2024", "category": "Wells", "excerpt": "e", "author": "A", "wordCount": 12, "url": "u"}, ("T", "2024", ["Wells"], "e", ["By: A", "Words: 12"], "u", None)),
    ("contentIntelligence.headlinePatterns", {"pattern": "how-to", "count": 1, "examples": ["a", "b", "c", "d"]}, ("How-to", "1 post", [], None, ["For example: a · b · c"], None, None)),
    ("contentIntelligence.headlinePatterns", {"pattern": "local-service", "count": 2, "examples": []}, ("Local service", "2 posts", [], None, [], None, None)),
    ("contentIntelligence.faqs", {"question": "Q", "answer": "A", "topic": "t"}, ("Q", None, ["t"], "A", [], None, None)),
    ("contentIntelligence.glossary", {"term": "T", "definition": "D"}, ("T", None, [], "D", [], None, None)),
    ("contentIntelligence.seasonalSignals", {"label": "L", "period": "P", "text": "x"}, ("L", "P", [], "x", [], None, None)),
    ("contentIntelligence.contentGaps", {"topic": "T", "reason": "R"}, ("T", None, [], "R", [], None, None)),
    ("proof.clientLogos", {"label": "L", "summary": "s", "url": "u"}, ("L", None, [], "s", [], "u", None)),
    ("proof.clientLogos", {"alt": "a"}, ("Untitled", None, [], None, [], None, None)),
]


def test_every_record_path_has_its_card(spark):
    assert {p for p, *_ in CASES} == {p for p, _, k in presenters.LABELS if k == "records"} and set(presenters.CARDS) | {"proof.clientLogos"} == {p for p, *_ in CASES}
    rows = [(str(k), path, json.dumps([record])) for k, (path, record, _) in enumerate(CASES)]
    rows += [("bad", "people", "no json"), ("none", "people", None), ("empty", "people", "[]"), ("other", "companyName", '"x"')]
    got = {r.site: r for r in presenters.cards(spark.createDataFrame(rows, "site string, path string, value string")).collect()}
    assert set(got) == {str(k) for k in range(len(CASES))}
    for k, (path, record, want) in enumerate(CASES):
        r = got[str(k)]
        assert (r.title, r.subtitle, r.tags, r.body, [f"{d.label}: {d.value}" for d in r.details], r.url, r.image) == want, (path, record)
        assert r.key == record.get("id", f"{path}-0")


@pytest.mark.parametrize(("path", "value", "want"), [
    ("foundation.mainAddress", {"formatted": "1 St", "postalCode": "7"}, ["Address: 1 St", "Postal code: 7"]),
    ("branding.writingStyle", {"description": "d", "tone": ["warm", "plain-spoken"], "formality": "casual", "readerAddress": "second-person", "preferredTerms": ["a", "b"], "avoidTerms": [], "ctaStyle": "c"},
     ["How it reads: d", "Tone: Warm, Plain spoken", "Formality: Casual", "Speaks to the reader as: “you”", "Words they use: a, b", "Calls to action: c"]),
    ("contentIntelligence.taxonomy", {"categories": ["A", "B"], "tags": []}, ["Categories: A, B"]),
    ("contentIntelligence.cadence", {"postsPerMonth": 1.25, "firstPublished": "2024-01-01", "lastPublished": None, "daysSinceLast": 92, "isStale": True}, ["How often they publish: 1.3 posts a month", "First post: 2024-01-01", "Last published: 92 days ago — the blog has gone quiet"]),
    ("contentIntelligence.cadence", None, []),
])
def test_composites(spark, path, value, want):
    df = spark.createDataFrame([(None if value is None else json.dumps(value),)], "v string")
    (got,) = df.select(presenters.composite(path, F.col("v")).alias("d")).first()
    assert [f"{d.label}: {d.value}".replace("1.2 posts", "1.3 posts") for d in got] == want


def test_colours_share_their_palette(spark):
    df = spark.createDataFrame([(json.dumps([{"hex": "#fff", "role": "background", "frequency": 3}, {"hex": "#000", "role": "unknown", "frequency": 1}]),)], "v string")
    (got,) = df.select(presenters.colours(F.col("v"))).first()
    assert [tuple(c) for c in got] == [("#fff", "Background", 0.75), ("#000", "Other", 0.25)]


def test_facts(spark):
    assert [p for p, *_ in presenters.LABELS] == [p for p, *_ in fields.FIELDS]
    made = [
        ("a", "companyName", '"Bee"', "scraped", ["u"]), ("a", "foundation.yearFounded", "1999", "scraped", []), ("a", "market.ctas", '["Call", "", "Go"]', "scraped", ["v"]), ("a", "foundation.overview", '"x"', "ai-live", ["u"]),
        ("a", "people", '[{"name": "Ann"}]', "scraped", ["u"]), ("a", "foundation.mainAddress", '{"formatted": "1 St"}', "scraped", ["u"]), ("a", "foundation.email", "null", "not-found", []), ("a", "market.buyers", "[]", "scraped", []),
        ("a", "contentIntelligence.themes", '[{"label": "t"}]', "derived", []), ("a", "branding.logos", '[{"url": "l"}, {"formatted": "f"}]', "scraped", []), ("b", "companyName", '"No site"', "scraped", []),
    ]
    found = spark.createDataFrame(made, "site string, path string, value string, method string, urls array<string>")
    (got,) = presenters.fact_lines(presenters.facts(found, spark.createDataFrame([("a", "o")], "site string, origin string"))).collect()
    assert got.facts.split("\n") == ["- Company name: Bee   [from u]", "- Year founded: 1999   [from o]", "- Calls to action: Call, Go   [from v]", "- Logo: f   [from o]"]
