"""Column functions on single values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kbloom.functions import dialect, fields, text, urls
from kbloom.operators import library, palette


def values(spark, rows, fn):
    """fn over a column v, in the order of the rows."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_normalize_url(spark):
    rows = {
        "example.com": "https://example.com/",
        " HTTP://WWW.Example.com:80/a/ ": "http://example.com/a",
        "https://x.com:8443/A/?b=2&a=1&utm_source=q&e=#f": "https://x.com:8443/A?a=1&b=2",
        "https://x.com/?a=2&a=1": "https://x.com/?a=2&a=1",
        "mailto:a@b.c": None,
        "ftp://x.com/": None,
        "": None,
        None: None,
    }
    assert values(spark, list(rows), urls.normalize_url) == list(rows.values())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abW.:/?#&=%20", max_size=25), min_size=30, max_size=60))
def test_normalize_url_is_idempotent(spark, rows):
    once = values(spark, rows, lambda c: urls.normalize_url(F.concat(F.lit("http://h.io/"), c)))
    assert values(spark, once, urls.normalize_url) == once


def test_domains_and_hosts(spark):
    rows = ["a.b.example.com", "www.shop.co.uk", "x.y.com.au", "localhost", "example.org"]
    assert values(spark, rows, urls.registrable_domain) == ["example.com", "shop.co.uk", "y.com.au", "localhost", "example.org"]
    assert values(spark, ["10.1.2.3", "8.8.8.8", "192.168.1.256", "x.local", "::1", "example.com"], urls.blocked_host) == [True, False, False, True, False, False]
    assert values(spark, ["::1", "[fe80::1]", "2606:4700::1111", "::ffff:10.0.0.1", "64:ff9b::a00:1", "x"], urls.blocked_v6) == [True, True, False, True, True, False]


def test_classify(spark):
    rows = {"https://x.com/": "home", "https://x.com/about": "about", "https://x.com/help/privacy": "legal", "https://x.com/blog/p": "blog-post", "https://x.com/z": "other", "nothing": "other"}
    assert values(spark, list(rows), lambda c: urls.classify(c)["role"]) == list(rows.values())


def test_text_pieces(spark):
    assert values(spark, ["Since the 3rd. We drill wells. Ok. \"You call!\" Yes you do it"], lambda c: F.array_join(text.sentences(c), "/")) == ['Since the 3rd./We drill wells./"You call!" Yes you do it']
    assert values(spark, ["don't über-cool l'été 12 x2"], lambda c: F.array_join(text.words(c), ",")) == ["don't,ber,cool,l,t"]
    assert values(spark, ["cat", "drilled", "water", "yes", "beautiful"], text.syllables) == [1, 1, 2, 1, 4]
    assert values(spark, ["(512) 273-7389", "1-512.273.7389", "1111111111", "12"], text.phone) == ["512-273-7389", "512-273-7389", None, None]
    assert values(spark, ["Wells | Bee Co", "Home", "x" * 70, ""], text.name_from_title) == ["Wells", "Home", None, None]
    assert values(spark, ["12 Main St, Austin, TX 78701", "nowhere"], lambda c: text.us_address(c)["city"]) == ["Austin", None]


def test_headlines(spark):
    rows = {"How to drill": "how-to", "Top 5 pumps": "listicle", "Is it deep?": "question", "Steel vs plastic": "comparison", "Summer sale": "seasonal", "Welcome Bob": "announcement", "Wells in Austin": "local-service", "Plain": "other"}
    assert values(spark, list(rows), text.headline) == list(rows.values())


def test_rounding_and_space(spark):
    assert values(spark, ["1.005", "0.285", "0.125"], lambda c: dialect.half_up(c.cast("double"), 2)) == [1.0, 0.28, 0.13]
    assert values(spark, ["  a \n b "], dialect.squash) == ["a b"]


def test_needs_review(spark):
    rows = [("user-edited", "n", "v", 0.1), ("ai-live", None, None, 1.0), ("scraped", "n", None, 1.0), ("scraped", None, "v", 0.4), ("scraped", None, None, 0.0), ("scraped", None, "v", 0.5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, m string, n string, v string, c double")
    got = [r[1] for r in df.select("i", fields.needs_review(F.col("m"), F.col("n"), F.col("v"), F.col("c"))).orderBy("i").collect()]
    assert got == [False, True, True, True, False, False]


def test_field_table():
    assert len(fields.FIELDS) == 54
    assert sum(i for _, i, *_ in fields.FIELDS) == 180
    assert sum(i for _, i, asked, *_ in fields.FIELDS if asked) == 128


def test_library_columns(spark):
    assert values(spark, ["0.39", "0.4", "0.7", "0.71"], lambda c: library.band(c.cast("double"))) == ["low", "medium", "medium", "high"]
    now = "2024-02-01 00:00:00"
    rows = {"2024-01-31 23:59:30": "just now", "2024-01-31 23:10:00": "50m ago", "2024-01-31 04:00:00": "20h ago", "2024-01-30 12:00:00": "yesterday", "2024-01-10 00:00:00": "22d ago", "2023-10-01 00:00:00": "4mo ago", "2021-01-01 00:00:00": "3y ago", None: "unknown"}
    assert values(spark, list(rows), lambda c: library.relative_time(c.cast("timestamp_ntz"), now)) == list(rows.values())


def test_contrast(spark):
    assert values(spark, ["#000000", "#ffffff"], lambda c: dialect.half_up(palette.contrast(c, F.lit("#ffffff")), 2)) == [21.0, 1.0]


@pytest.mark.parametrize("name,kept", [("a  b", True), ("zzz", False)])
def test_search_needs_every_word(spark, name, kept):
    assert values(spark, ["Alpha Beta a b"], lambda c: library.matches(F.lower(c), name)) == [kept]


def test_syllables_of_a_text_are_those_of_its_words(spark):
    from kbloom.functions import text as T
    from kbloom.functions.dialect import words_bounded

    texts = ["The committees' wasted yellow eyes ed e es by y I'm rhythm, don't 5'6 abc1'foo _'n rock_'n", "", "a b c", "yes eyes loved rated trees queue beautiful", "Rated l'été x's it’s O'Neill's"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_extract_all("t", F.lit(words_bounded(T.WORD)), F.lit(0))
    rows = df.select("t", plain.alias("p"), T.words(F.col("t")).alias("w")).select("t", "p", "w", T.syllable_sum(F.col("w")).alias("s"), F.aggregate("w", F.lit(0), lambda a, x: a + T.syllables(x)).alias("each"))
    for r in rows.collect():
        assert r.p == r.w and r.s == r.each, r


def test_text_for_match_equals_its_sql_for_every_character(spark):
    import duckdb

    from kbloom.plans.text_queries import _MATCH

    characters = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = ["x".join(characters[k : k + 512]) for k in range(0, len(characters), 512)]
    want = duckdb.execute(f"SELECT list_transform($1, lambda t: {_MATCH.format('t')})", [rows]).fetchone()[0]
    assert values(spark, rows, text.for_match) == want
