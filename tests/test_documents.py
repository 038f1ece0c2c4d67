"""Documents from claims and pages."""

import json

from pyspark.sql import functions as F

from kbloom.functions import fields
from kbloom.operators import documents

CLAIM = "site string, path string, seq long, value string, method string, role string, confidence double, url string, note string"


def rows(spark, *items):
    made = [(site, path, k, value if isinstance(value, str) or value is None else json.dumps(value), method, "home", fields.METHODS[method][1], url, None) for k, (site, path, value, method, url) in enumerate(items)]
    return spark.createDataFrame(made, CLAIM)


def sites(spark, *names):
    made = [(n, f"https://{n}.com/") for n in names]
    return spark.createDataFrame(made, "site string, origin string").withColumn("now", F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))


def pages(spark, *names):
    made = [(n, k, f"https://{n}.com/{p}", "home", 200, 10 + k, f"2024-05-01T00:00:0{k}Z") for n in names for k, p in enumerate(["", "drilling-page"])]
    return spark.createDataFrame(made, "site string, place int, url string, role string, status int, bytes long, fetched_at string")


def document(spark, items, *names):
    names = names or ("a",)
    got = documents.from_claims(spark, rows(spark, *items), sites(spark, *names), pages(spark, *names)).collect()
    assert len(got) == len(names)
    return {r.site: json.loads(r.document) for r in got}


def test_an_empty_site_is_a_whole_document(spark):
    held = document(spark, [], "a", "b")
    for name, d in held.items():
        assert list(d) == ["sourceUrl", "scrape", "companyName", "foundation", "positioning", "market", "branding", "onlinePresence", "people", "offerings", "proof", "contentIntelligence", "quality"]
        flat = {p: d[p] if "." not in p else d[p.split(".")[0]][p.split(".")[1]] for p, *_ in fields.FIELDS}
        assert flat.pop("foundation.website") == {"value": f"https://{name}.com/", "method": "derived", "confidence": 0.95, "sourceUrls": [f"https://{name}.com/"]}
        assert all(f == {"value": None, "method": "not-found", "confidence": 0.0, "sourceUrls": []} for f in flat.values())
        assert [p["url"] for p in d["scrape"]["pages"]] == [f"https://{name}.com/", f"https://{name}.com/drilling-page"]
        assert d["scrape"]["startedAt"] == "2024-05-01T00:00:00Z" and d["scrape"]["warnings"] == []
        assert "foundation.website" not in d["quality"]["missingFields"] and len(d["quality"]["missingFields"]) == len(fields.FIELDS) - 1
        assert [c["category"] for c in d["quality"]["categoryScores"]] == documents.CATEGORIES and len(d["quality"]["followUpQuestions"]) == fields.MOST_QUESTIONS


def test_fields_of_every_kind(spark):
    d = document(spark, [
        ("a", "companyName", 'Bee "Cave" Drilling\n', "json-ld", "u1"), ("a", "companyName", "bee cave", "json-ld", "u2"), ("a", "companyName", "Other", "dom", "u3"),
        ("a", "foundation.yearFounded", "1999", "dom", "u1"), ("a", "foundation.mainAddress", "1 Main St", "dom", "u1"), ("a", "foundation.phone", "555-000-0000", "dom", "u1"),
        ("a", "market.ctas", "Call | now", "dom", "u1"), ("a", "market.ctas", "call | now", "json-ld", "u2"), ("a", "market.ctas", "Get a quote", "dom", "u2"),
        ("a", "people", {"name": "Ann", "title": "", "tags": ["x"]}, "dom", "u1"), ("a", "people", {"name": " ann", "title": "Owner", "age": 40, "tags": ["y", "x"]}, "json-ld", "u2"), ("a", "people", {"title": "nobody"}, "dom", "u1"),
        ("a", "people", "no json", "dom", "u1"), ("a", "unknown.path", "x", "dom", "u1"), ("a", "foundation.email", None, "dom", "u1"), ("zz", "companyName", "no such site", "dom", "u1"),
    ])["a"]
    name = d["companyName"]
    assert name["value"] == 'Bee "Cave" Drilling\n' and name["confidence"] == 0.45 and name["note"].startswith("We found 2 different values") and name["sourceUrls"] == ["u1"]
    assert [c["value"] for c in d["quality"]["conflicts"][0]["candidates"]] == ['Bee "Cave" Drilling\n', "bee cave"] and d["quality"]["conflicts"][0]["label"] == "companyName"
    assert d["foundation"]["yearFounded"]["value"] == 1999 and d["foundation"]["mainAddress"]["value"] == {"formatted": "1 Main St"}
    assert d["market"]["ctas"]["value"] == ["call | now", "Get a quote"] and d["market"]["ctas"]["confidence"] == 0.8
    (ann,) = d["people"]["value"]
    assert (ann["name"], ann["title"], ann["age"], sorted(ann["tags"])) == (" ann", "Owner", 40, ["x", "y"]) and ann["sourceUrls"] == ["u1", "u2"] and ann["confidence"] == 0.95 and len(ann["id"]) == 12
    assert d["people"]["sourceUrls"] == ["u2"] and d["foundation"]["email"]["value"] is None
    assert d["market"]["channels"]["value"] == ["Phone"]


def test_derivations(spark):
    post = lambda k, title, when=None, category=None: ("a", "contentIntelligence.posts", {"title": title, "url": f"https://a.com/b{k}", "publishedAt": when, "category": category, "excerpt": "e"}, "dom", "u1")
    d = document(spark, [
        post(1, "How to drill a well", "2024-01-01", "Wells"), post(2, "Is it deep?", "2024-03-01", "Wells"), post(3, "How to pump", "not a date", "Pumps"), post(4, "A note"), post(5, "An essay"), post(6, ""),
        ("a", "offerings", {"name": "Drilling Services"}, "dom", "u1"), ("a", "offerings", {"name": "Tank Cleaning"}, "dom", "u1"), ("a", "offerings", {"name": "The of"}, "dom", "u1"),
        ("a", "onlinePresence.profiles", "https://www.facebook.com/bee", "json-ld", "u1"), ("a", "onlinePresence.profiles", {"url": "https://x.com/bee", "platform": "x"}, "dom", "u1"), ("a", "onlinePresence.profiles", {"url": "https://www.facebook.com/two"}, "dom", "u1"),
        ("a", "market.funnels", "Quote request form", "dom", "u1"), ("a", "market.funnels", "Newsletter signup", "dom", "u1"), ("a", "foundation.website", "https://bee.com", "meta", "u1"),
    ])["a"]
    c = d["contentIntelligence"]
    assert c["cadence"]["value"] == {"postsPerMonth": round(2 / (60 / 30.44), 2), "firstPublished": "2024-01-01", "lastPublished": "2024-03-01", "daysSinceLast": 92, "isStale": True}
    assert [(p["pattern"], p["count"], p["examples"]) for p in c["headlinePatterns"]["value"]] == [("how-to", 2, ["How to drill a well", "How to pump"]), ("question", 1, ["Is it deep?"])]
    assert c["taxonomy"]["value"] == {"categories": ["Wells", "Pumps"], "tags": []}
    (gap,) = c["contentGaps"]["value"]
    assert gap["topic"] == "Tank Cleaning" and gap["relatedOffering"] == next(o["id"] for o in d["offerings"]["value"] if o["name"] == "Tank Cleaning")
    assert d["market"]["channels"]["value"] == ["Facebook", "X (Twitter)", "Blog / organic search", "Website", "Email"] and d["market"]["channels"]["sourceUrls"] == ["https://a.com/", "https://a.com/drilling-page"]
    assert d["foundation"]["website"] == {"value": "https://bee.com", "method": "scraped", "confidence": 0.8, "sourceUrls": ["u1"]}


def test_documents_from_crawled_pages(spark):
    body = '<html><head><meta property="og:site_name" content="Bee Co"><meta name="description" content="We drill wells of every depth for homes and farms."></head><body><a href="tel:5125550000">Call</a><a href="mailto:jo@bee.com">Mail</a></body></html>'
    made = [("bee", 1, 10, "https://bee.com/", "home", body, 200, 5, "2024-05-01T00:00:00Z"), ("bee", 2, 11, "https://bee.com/about", "about", None, 200, 5, "2024-05-01T00:00:01Z"), ("bad", 1, 12, "https://bad.com/", "home", "<p", None, None, None)]
    crawled = spark.createDataFrame(made, "site string, place int, page_id long, url string, role string, html string, status int, bytes long, fetched_at string")
    got = {r.site: json.loads(r.document) for r in documents.build(spark, crawled, sites(spark, "bee", "bad")).collect()}
    assert got["bee"]["companyName"]["value"] == "Bee Co" and got["bee"]["foundation"]["phone"]["value"] == "512-555-0000" and got["bee"]["foundation"]["email"]["value"] == "jo@bee.com"
    assert got["bee"]["foundation"]["overview"]["confidence"] == 0.5 and got["bee"]["market"]["channels"]["value"] == ["Phone", "Email"]
    assert got["bad"]["companyName"]["value"] is None and got["bad"]["scrape"]["pages"] == [{"url": "https://bad.com/", "role": "home", "status": None, "bytes": None, "fetchedAt": None}]
