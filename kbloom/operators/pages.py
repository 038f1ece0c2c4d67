"""Page text: excerpts under a budget, verbatim quotes, visible text and colours."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbloom.functions.dialect import let
from kbloom.sources.scratch import small_batches


def excerpts(docs: DataFrame, site: str, order: str, budget: int) -> DataFrame:
    """Rows within a site's running budget; ``take`` is how much of each fits.

    ``docs`` has n, the characters a row asks for; rows are served in order.  A
    row asks for one at least, so no more rows than the budget can be served and
    the rest of a large site is left out before the running sum.
    """
    docs = docs.withColumn("used", F.row_number().over(Window.partitionBy(site).orderBy(order))).where(F.col("used") <= budget).drop("used")
    before = Window.partitionBy(site).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("n").over(before), F.lit(0))
    return docs.withColumn("used", used).where(F.col("used") < budget).withColumn("take", F.least(F.col("n"), F.lit(budget) - F.col("used")).cast("int"))


#: Characters of a quote that is looked for.
LEAST_QUOTE = 8
#: Quotes of so many bytes in all are sent to every task.
SENT_QUOTES = 32 << 20


def verbatim(quotes: DataFrame, docs: DataFrame, words: int = 3) -> DataFrame:
    """(item_id, doc_id) where ``quotes.q`` is a substring of ``docs.t``.

    A quote may begin and end inside a word, but its inner words are whole.  Its
    anchor is the run of its second to fourth words; with three or four words its
    longest inner word; with two, four characters of the longer one at the space
    between; with one, its first characters.  Documents are looked up by anchors
    alone, hashed to 64 bits, and searched for the quotes they meet.  Quotes of
    fewer than ``LEAST_QUOTE`` characters are not looked for.

    Up to ``SENT_QUOTES`` the quotes go to the documents, whose text is made once
    and searched where it is read; more of them meet the anchors by a shuffle.
    """
    keyed = quotes.where(F.length("q") >= LEAST_QUOTE).select("item_id", "q", let(F.split("q", " "), lambda p: _anchor(p, words)).alias("k")).select("item_id", "q", "k.kind", "k.anchor")
    # documents get the kinds of anchors that some quote has; there are five
    held = keyed.agg(F.collect_set("kind").alias("kinds"), F.sum(F.octet_length("q")).alias("size")).first()
    kinds, keyed = set(held["kinds"]), keyed.drop("kind")
    if not kinds:
        return quotes.select("item_id").join(docs.select("doc_id"), F.lit(False))
    # no text is null and no array is left out: a filter on either would make it twice
    docs = docs.select("doc_id", F.coalesce("t", F.lit("")).alias("t"))
    spread = docs.withColumn("anchors", let(F.split("t", " "), lambda w: F.array_distinct(_anchors(w, words, kinds))))
    if held["size"] <= SENT_QUOTES:
        near = spread.select("doc_id", "t", F.explode_outer("anchors").alias("anchor")).join(F.broadcast(keyed), "anchor")
    else:
        near = spread.select("doc_id", F.explode_outer("anchors").alias("anchor")).join(keyed.drop("q"), "anchor").select("item_id", "doc_id").distinct()
        near = near.join(docs, "doc_id").join(keyed.drop("anchor"), "item_id")
    return near.where(F.contains("t", "q")).select("item_id", "doc_id")


def _key(kind: str, *parts: Column) -> Column:
    return F.xxhash64(F.lit(kind), *parts)


def _anchor(parts: Column, words: int) -> Column:
    """The kind and the key of a quote by its words."""
    of = lambda kind, *x: F.struct(F.lit(kind).alias("kind"), _key(kind, *x).alias("anchor"))
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    at_space = F.when(F.length(first) >= 4, of("E", F.right(first, F.lit(4)))).otherwise(of("S", F.left(second, F.lit(4))))
    return (
        F.when(F.size(inner) >= words, of("R", *[F.get(inner, F.lit(k)) for k in range(words)]))
        .when(F.size(inner) > 0, of("W", longest))
        .when(F.size(parts) == 2, at_space)
        .otherwise(of("C", F.left(first, F.lit(LEAST_QUOTE))))
    )


def _anchors(w: Column, words: int, kinds: set[str]) -> Column:
    """All keys of the given kinds that a document of these words can be found by."""
    known = F.array_distinct(w)
    long, four = F.filter(known, lambda x: F.length(x) >= LEAST_QUOTE), F.filter(known, lambda x: F.length(x) >= 4)
    parts = {
        "R": F.transform(w, lambda x, i: _key("R", x, *[F.get(w, i + k) for k in range(1, words)])),
        "W": F.transform(known, lambda x: _key("W", x)),
        "E": F.transform(four, lambda x: _key("E", F.right(x, F.lit(4)))),
        "S": F.transform(four, lambda x: _key("S", F.left(x, F.lit(4)))),
        "C": F.flatten(F.transform(long, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - (LEAST_QUOTE - 1)), lambda i: _key("C", F.substring(x, i, F.lit(LEAST_QUOTE)))))),
    }
    return F.concat(*[part for kind, part in parts.items() if kind in kinds])


def _reader(closed: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from kbloom.operators.dom import parse

        for batch in batches:
            rows = []
            for page_id, html in zip(batch.page_id, batch.html, strict=True):
                root = parse(html, closed)
                title, body = root.first("title"), root.first("body")
                css = " ".join(k for n in root.find("style") for k in n.kids if isinstance(k, str)) + " " + " ".join(n.attrs["style"] for n in root.walk() if n.attrs.get("style"))
                rows.append((page_id, title.text() if title else None, root.text(apart=True), (body or root).text(), css.strip(), html))
            yield pd.DataFrame(rows, columns=["page_id", "title", "visible_text", "body_text", "css", "html"])

    return run


def read(pages: DataFrame, closed: bool = False) -> DataFrame:
    """Each page parsed once: title, visible text, body text and style sheets.

    HTML decodes some references without a semicolon too; with ``closed`` only
    those that have one are decoded.
    """
    return small_batches(pages.select("page_id", "html")).mapInPandas(_reader(closed), "page_id long, title string, visible_text string, body_text string, css string, html string")


# Marks of frameworks that render in the browser.
FRAMEWORKS = [
    (r"<div[^>]+id=[\"']__next[\"']", "Next.js"),
    (r"<div[^>]+id=[\"']root[\"'][^>]*>\s*</div>", "React"),
    (r"<div[^>]+id=[\"']app[\"'][^>]*>\s*</div>", "Vue"),
    (r"ng-version=|<app-root", "Angular"),
    (r"data-reactroot", "React"),
    (r"window\.__nuxt__", "Nuxt"),
    (r"<div[^>]+class=[\"'][^\"']*svelte-", "Svelte"),
]
THIN_TEXT = 300


def framework(html: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, name in reversed(FRAMEWORKS):
        out = F.when(F.lower(html).rlike(pattern), name).otherwise(out)
    return out


def color_counts(css: Column) -> Column:
    """All colours of a style sheet as #rrggbb, repeats included.

    Short hex forms are widened; rgb() colours count from an alpha of 0.25.
    """
    hexes = F.transform(F.regexp_extract_all(F.lower(css), F.lit(r"#([0-9a-f]{6}|[0-9a-f]{3})(?![0-9a-z_])"), F.lit(1)), lambda x: F.when(F.length(x) == 3, F.regexp_replace(x, "(.)(.)(.)", "$1$1$2$2$3$3")).otherwise(x))
    rgb = r"rgba?\(\s*([0-9]{1,3})[\s,]+([0-9]{1,3})[\s,]+([0-9]{1,3})\s*(?:[,/]\s*([0-9.]+)\s*)?\)"
    whole = F.filter(F.regexp_extract_all(F.lower(css), F.lit(rgb), F.lit(0)), lambda x: F.coalesce(F.nullif(F.regexp_extract(x, rgb, 4), F.lit("")).try_cast("double"), F.lit(1.0)) >= 0.25)
    channel = lambda x, k: F.lpad(F.lower(F.hex(F.least(F.regexp_extract(x, rgb, k).cast("int"), F.lit(255)))), 2, "0")
    return F.transform(F.concat(hexes, F.transform(whole, lambda x: F.concat(channel(x, 1), channel(x, 2), channel(x, 3)))), lambda x: F.concat(F.lit("#"), x))


# Marks of review widgets whose quotes load in the browser.
REVIEW_WIDGETS = [
    (r"birdeye\.com|birdeye_|bdreview", "Birdeye"),
    (r"trustpilot\.com/(bootstrap|widget)|tp-widget", "Trustpilot"),
    (r"yotpo\.com|yotpo-widget", "Yotpo"),
    (r"podium\.com|podium-widget", "Podium"),
    (r"nicejob\.co|nicejob-", "NiceJob"),
    (r"grade\.us|reviewsonmywebsite", "Grade.us"),
    (r"elfsight\.com.*google-reviews|elfsight-app", "Elfsight"),
    (r"reviews\.io|reviewsio", "Reviews.io"),
    (r"shopperapproved\.com", "Shopper Approved"),
]


def review_widgets(html: Column) -> Column:
    """Names of the review widgets in a page's source."""
    return F.array_compact(F.array(*[F.when(F.lower(html).rlike(pattern), name) for pattern, name in REVIEW_WIDGETS]))


# Types that name no trade.
GENERIC_TYPES = ["Organization", "Corporation", "LocalBusiness", "ProfessionalService", "Service", "Store", "Thing"]


def industry_from_type(kind: Column) -> Column:
    """A structured-data type as words; null for a generic one."""
    words = F.regexp_replace(F.regexp_replace(kind, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    plain = F.trim(F.regexp_replace(F.regexp_replace(words, r"(?<![A-Za-z0-9_])Business(?![A-Za-z0-9_])", ""), r"\s+", " "))
    return F.when(~kind.isin(GENERIC_TYPES) & (F.length(plain) >= 3), plain)


def google_fonts(href: Column) -> Column:
    """Families that a font link asks for."""
    return F.filter(F.transform(F.regexp_extract_all(href, F.lit("family=([^&:]+)"), F.lit(1)), lambda x: F.trim(F.try_url_decode(x))), lambda x: x != "")


# Patterns of a copyright line and of legal forms.
COPYRIGHT = r"(?i)(?:©|\(c\)|copyright)([^|\n]{3,120})"
COPYRIGHT_NOISE = r"(?i)(?<![A-Za-z0-9_])all\s+rights\s+reserved.*$|copyright|©|\(c\)"
_YEAR = r"(?<![0-9])(?:18|19|20)[0-9]{2}(?![0-9])"
#: Years at the head or the end of a line; within it a number is part of the name.
COPYRIGHT_YEARS = rf"^(?:[\s,.|·\-–—]*{_YEAR})+|(?:[\s,.|·\-–—]*{_YEAR})+[\s,.|·\-–—]*$"
FOOTER_TAIL = r"(?i)(?<![A-Za-z0-9_])(privacy|terms|cookie\s+policy|sitemap|accessibility|disclaimer|web(?:site)?\s+(?:design|by)|designed?\s+by|powered\s+by|built\s+by).*$"
ENTITY = r"(?:^|[\s,])(LLC|L\.L\.C\.|Inc\.?|Incorporated|Ltd\.?|Corp\.?|Corporation|LLP|PLLC|P\.C\.|PA)$"


def legal_name(footer: Column) -> Column:
    """The registered name of a copyright line; null if it is no name.

    Years before and after the name are left out, numbers within it are kept.
    """
    line = F.regexp_extract(footer, COPYRIGHT, 1)
    whole = F.regexp_replace(F.regexp_replace(line, COPYRIGHT_NOISE, " "), FOOTER_TAIL, " ")
    bare = F.regexp_replace(F.regexp_replace(whole, COPYRIGHT_YEARS, " "), r"\s+", " ")
    name = F.regexp_replace(bare, r"^[\s,.|·©\-]+|[\s,.|·©\-]+$", "")
    return F.when(F.length(name).between(4, 70) & name.rlike("^[A-Z]") & name.rlike("[a-z]"), name)


def legal_entity(name: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(name, ENTITY, 1), r"\.$", ""), F.lit(""))
