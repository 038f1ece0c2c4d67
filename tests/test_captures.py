import gzip
import json

from kbloom.sources import captures


def test_captures_round_trip(spark, tmp_path):
    for slug, n in (("one", 2), ("two", 1)):
        at = tmp_path / slug
        at.mkdir()
        pages = [{"file": f"{k:02d}.html.gz", "url": f"https://{slug}.example/{k}", "role": "home", "status": 200, "bytes": 3, "fetchedAt": "2024-01-01T00:00:00Z"} for k in range(n + 1)]
        for k in range(n):
            (at / f"{k:02d}.html.gz").write_bytes(gzip.compress(f"<p>é {slug}\n{k}</p>\n".encode()))
        (at / "stray.html.gz").write_bytes(gzip.compress(b"stray"))
        (at / "manifest.json").write_text(json.dumps({"slug": slug, "name": slug, "url": f"https://{slug}.example/", "pages": pages, "warnings": []}, indent=1))
    got = {(r.slug, r.page_id): r.html for r in captures.captured_pages(spark, f"file://{tmp_path}").collect()}
    assert got == {("one", 0): "<p>é one\n0</p>\n", ("one", 1): "<p>é one\n1</p>\n", ("one", 2): None, ("two", 0): "<p>é two\n0</p>\n", ("two", 1): None}


def test_documents_round_trip_as_json(spark, tmp_path):
    rows = [("a", json.dumps({"identity": {"name": {"value": "Bee", "confidence": 0.9}}, "people": [{"name": "Ann"}]})), ("b", "{}")]
    captures.export_json(spark.createDataFrame(rows, "slug string, document string"), f"file://{tmp_path}/out")
    back = captures.read_json(spark, f"file://{tmp_path}/out")
    assert sorted((r.slug, r.document) for r in back.collect()) == rows
    parsed = captures.read_json(spark, f"file://{tmp_path}/out", "people array<struct<name: string>>, slug string")
    assert {r.slug: r.people and [p.name for p in r.people] for r in parsed.collect()} == {"a": ["Ann"], "b": None}


def test_documents_from_captures(spark, tmp_path):
    """Two captures to two documents, roles told by the URLs and warnings kept."""
    from kbloom.operators import documents

    for slug in ("bee", "ant"):
        at = tmp_path / slug
        at.mkdir()
        html = f'<html><head><meta property="og:site_name" content="{slug} Co"></head><body><a href="tel:5125550000">Call</a></body></html>'
        pages = [{"file": f"{k:02d}.html.gz", "url": f"https://{slug}.example/{path}", "role": "other", "status": 200, "bytes": 3, "fetchedAt": f"2024-01-01T00:00:0{k}Z"} for k, path in enumerate(["", "contact"])]
        (at / "00.html.gz").write_bytes(gzip.compress(html.encode()))
        warnings = [{"code": "budget-exceeded", "message": "We stopped.", "url": None}] if slug == "bee" else []
        (at / "manifest.json").write_text(json.dumps({"slug": slug, "name": slug, "url": f"https://www.{slug}.example", "capturedAt": "2024-01-01T00:00:00Z", "pages": pages, "warnings": warnings}))
    pages, sites, warnings = captures.crawls(spark, f"file://{tmp_path}")
    got = {r.site: json.loads(r.document) for r in documents.build(spark, pages, sites, warnings).collect()}
    assert set(got) == {"bee", "ant"}
    for slug, d in got.items():
        assert d["companyName"]["value"] == f"{slug} Co" and d["foundation"]["phone"]["value"] == "512-555-0000" and d["sourceUrl"] == f"https://{slug}.example/"
        assert [p["role"] for p in d["scrape"]["pages"]] == ["home", "contact"]
    assert got["bee"]["scrape"]["warnings"] == [{"code": "budget-exceeded", "message": "We stopped.", "url": None}] and got["ant"]["scrape"]["warnings"] == []
