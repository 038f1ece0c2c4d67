"""URL normalisation, site identity and page roles, all as Column expressions."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kbloom.functions.dialect import let, trimmed, words_bounded

# Query parameters that never select content.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "msclkid",
    "mc_cid", "mc_eid", "ref", "_ga", "_gl", "hsa_acc", "hsa_cam",
]

# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = [
    "co.uk", "org.uk", "ac.uk", "gov.uk", "co.nz", "co.za", "com.au", "net.au", "org.au", "com.br", "com.mx", "co.in",
    "co.jp", "com.sg",
]

# Fixed value: path endings that are no page.
NOT_A_PAGE = r"\.(pdf|jpe?g|png|gif|webp|avif|svg|ico|mp4|webm|mov|mp3|wav|zip|gz|tar|dmg|exe|css|js|json|xml|rss|woff2?|ttf|eot)$"

# Roles by path, first match wins; (role, priority, patterns).
ROLE_RULES = [
    ("about", 95, [r"^/(about|about-us|our-story|who-we-are|company|history|meet-us)(/|$)", r"/(about|about-us|our-story|who-we-are)(/|$)"]),
    ("services", 90, [r"^/(services|what-we-do|solutions|offerings|capabilities)(/|$)", r"/(services|solutions|what-we-do)(/|$)"]),
    ("contact", 85, [r"^/(contact|contact-us|get-in-touch|locations|find-us)(/|$)"]),
    ("products", 80, [r"^/(products|shop|catalog|catalogue|equipment)(/|$)"]),
    ("team", 75, [r"^/(team|our-team|staff|people|leadership|management|agents|attorneys|providers)(/|$)", r"/(our-team|meet-the-team|meet-our-team|staff-directory|staff-?bios|our-staff)(/|$)"]),
    ("testimonials", 70, [r"^/(testimonials|reviews|client-reviews|what-clients-say|success-stories|case-studies)(/|$)", r"/(testimonials|reviews|case-studies)(/|$)"]),
    ("pricing", 65, [r"^/(pricing|plans|rates|packages|quote|estimate)(/|$)"]),
    ("faq", 60, [r"^/(faq|faqs|frequently-asked|questions|help|resources)(/|$)"]),
    ("blog-index", 45, [r"^/(blog|news|articles|insights|resources|updates|posts)/?$"]),
    ("blog-post", 30, [r"^/(blog|news|articles|insights|posts)/.+", r"^/[0-9]{4}/[0-9]{2}/.+"]),
    ("legal", 10, [r"^/(privacy|privacy-policy|terms|terms-of-service|terms-and-conditions|accessibility|sitemap|disclaimer|cookie-policy)(/|$)"]),
]
LEGAL = r"/(privacy|privacy-policy|terms|terms-of-service|terms-of-use|terms-and-conditions|cookie-policy|disclaimer|accessibility|legal|dmca)(/|$)"
ANCHOR_HINTS = [
    (r"\babout\b|\bour story\b|\bwho we are\b", "about"),
    (r"\bservices\b|\bwhat we do\b", "services"),
    (r"\bcontact\b|\bget in touch\b", "contact"),
    (r"\bteam\b|\bstaff\b|\bour people\b", "team"),
    (r"\btestimonials\b|\breviews\b", "testimonials"),
    (r"\bpricing\b|\brates\b|\bget a quote\b", "pricing"),
    (r"\bfaq\b|\bfrequently asked\b", "faq"),
    (r"\bblog\b|\bnews\b|\barticles\b", "blog-index"),
]
OTHER_PRIORITY = 40

_URL = r"(?s)^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; empty if there is none."""
    return F.regexp_extract(url, _URL, k)


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and ``www.``; null for no URL."""
    raw = F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":[0-9]*$", "")
    host = F.regexp_replace(F.lower(raw), r"^www\.", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    path = part(url, 3)
    return F.when(path == "", F.lit("/")).otherwise(path)


def normalize_url(url: Column) -> Column:
    """Canonical form of an absolute URL, or null for what is no http(s) page.

    https is assumed without a scheme; host in lower case without ``www.`` and
    default port; no fragment, tracking or empty parameters, the rest sorted by
    name, order kept within one; no closing slash but at the root.  Escapes are
    left as they are.
    """

    def absolute(raw: Column) -> Column:
        page = (raw != "") & ~raw.rlike(r"(?i)^(mailto|tel|javascript|data|sms):")
        return F.when(page, F.when(raw.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), raw).otherwise(F.concat(F.lit("https://"), raw)))

    def split(raw: Column) -> Column:
        return F.struct(F.lower(part(raw, 1)).alias("scheme"), host_of(raw).alias("host"), F.regexp_extract(part(raw, 2), r":([0-9]+)$", 1).alias("port"), F.regexp_replace(path_of(raw), r"/+$", "").alias("path"), part(raw, 4).alias("query"))

    def ordered(query: Column) -> Column:
        pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=.+") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING))
        keyed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p"))))
        return F.when(query == "", "").otherwise(let(F.array_join(F.transform(keyed, lambda x: x["p"]), "&"), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))))

    def joined(x: Column) -> Column:
        scheme, port = x["scheme"], x["port"]
        shown = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
        path = F.when(x["path"] == "", "/").otherwise(x["path"])
        return F.when(scheme.isin("http", "https") & x["host"].isNotNull(), F.concat(scheme, F.lit("://"), x["host"], shown, path, ordered(x["query"])))

    # parts that are used more than once are bound, so each is found once
    return let(let(let(trimmed(url), absolute), split), joined)


def registrable_domain(host: Column) -> Column:
    """The last two labels of a host, three under a two-label suffix."""
    labels = F.split(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    return F.when(host.isNull(), F.lit(None)).when((F.size(labels) > 2) & two.isin(TWO_LABEL_SUFFIXES), three).otherwise(two)


def same_site(a: Column, b: Column) -> Column:
    return F.coalesce(registrable_domain(host_of(a)) == registrable_domain(host_of(b)), F.lit(False))


def html_like(url: Column) -> Column:
    return host_of(url).isNotNull() & ~F.lower(path_of(url)).rlike(NOT_A_PAGE)


def site_slug(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(registrable_domain(host_of(url)), "[^a-z0-9]+", "-"), F.lit("unknown-site"))


def page_slug(url: Column) -> Column:
    query = part(url, 4)
    whole = F.concat(path_of(url), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    slug = F.lower(F.regexp_replace(F.regexp_replace(whole, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(host_of(url).isNull() | (slug == ""), "index").otherwise(F.substring(slug, 1, 80))


def page_label(url: Column) -> Column:
    """The page's last path segment as a phrase; the URL itself if it is none."""
    last = F.try_element_at(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), F.lit(-1))
    text = F.trim(F.regexp_replace(F.regexp_replace(last, r"\.[A-Za-z0-9_]+$", ""), "[-_]+", " "))
    phrase = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000))
    return F.when(host_of(url).isNull(), url).when(F.coalesce(text, F.lit("")) == "", "the home page").otherwise(F.concat(F.lit("the "), phrase, F.lit(" page")))


def classify(url: Column, anchor: Column | None = None) -> Column:
    """struct(role, priority, confidence) of a page by its path, then anchor."""

    def found(role: str, priority: int, confidence: float) -> Column:
        return F.struct(F.lit(role).alias("role"), F.lit(priority).alias("priority"), F.lit(confidence).alias("confidence"))

    path = F.lower(path_of(url))
    out = F.when(host_of(url).isNull(), found("other", 0, 0.0)).when(path == "/", found("home", 100, 1.0)).when(path.rlike(LEGAL), found("legal", 10, 0.85))
    for role, priority, patterns in ROLE_RULES:
        out = out.when(path.rlike("|".join(patterns)), found(role, priority, 0.9))
    if anchor is not None:
        by_role = {role: priority for role, priority, _ in ROLE_RULES}
        for pattern, role in ANCHOR_HINTS:
            out = out.when(F.coalesce(F.lower(anchor).rlike(words_bounded(pattern)), F.lit(False)), found(role, by_role[role] - 5, 0.5))
    depth = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    priority = F.when(depth <= 1, OTHER_PRIORITY + 5).otherwise(F.lit(OTHER_PRIORITY) - depth)
    return out.otherwise(F.struct(F.lit("other").alias("role"), priority.alias("priority"), F.lit(0.2).alias("confidence")))


def website_valid(url: Column) -> Column:
    """An http(s) address whose host has a dot and proper labels."""
    whole = F.when(trimmed(url).rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"), trimmed(url)).otherwise(F.concat(F.lit("https://"), trimmed(url)))
    host = F.regexp_replace(part(whole, 2), r":[0-9]*$", "")
    labels = F.split(host, r"\.")
    good = F.lower(part(whole, 1)).isin("http", "https") & F.contains(host, F.lit(".")) & (F.length(host) <= 253) & F.forall(labels, lambda x: (F.length(x) >= 1) & (F.length(x) <= 63))
    return F.coalesce(good, F.lit(False))


# IPv4 networks that are not the public internet.
PRIVATE_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]
PRIVATE_NAMES = ["localhost", ".localhost", ".local", ".internal", ".home.arpa"]


def v4_bounds(network: str) -> tuple[int, int]:
    """First and last address of a network as integers."""
    address, bits = network.split("/")
    a, b, c, d = map(int, address.split("."))
    first = (a << 24) + (b << 16) + (c << 8) + d
    return first, first + (1 << 32 - int(bits)) - 1


def v4_number(address: Column) -> Column:
    """A dotted address as a long; null for what is none."""
    octets = F.transform(F.split(address, r"\."), lambda x: F.when(x.rlike("^[0-9]{1,3}$"), x.try_cast("long")))
    good = (F.size(octets) == 4) & F.forall(octets, lambda x: F.coalesce(x <= 255, F.lit(False)))
    return F.when(good, F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


def blocked_host(host: Column) -> Column:
    """Whether a host names a private address or network."""
    number, name = v4_number(host), F.lower(host)
    inside = F.lit(False)
    for low, high in map(v4_bounds, PRIVATE_V4):
        inside = inside | F.coalesce(number.between(low, high), F.lit(False))
    named = name == PRIVATE_NAMES[0]
    for suffix in PRIVATE_NAMES[1:]:
        named = named | F.endswith(name, F.lit(suffix))
    return inside | F.coalesce(named, F.lit(False))


def blocked_v6(host: Column) -> Column:
    """IPv6 literals that are not public, IPv4-mapped and NAT64 forms unwrapped."""
    @F.pandas_udf("boolean")
    def judge(hosts: pd.Series) -> pd.Series:
        def one(text):
            try:
                address = ipaddress.IPv6Address((text or "").strip("[]"))
            except ValueError:
                return False
            inner = address.ipv4_mapped
            if inner is None and address in ipaddress.ip_network("64:ff9b::/96"):
                inner = ipaddress.IPv4Address(int(address) & 0xFFFFFFFF)
            if inner is not None:
                return any(inner in ipaddress.ip_network(n) for n in PRIVATE_V4)
            return not address.is_global

        return hosts.map(one)

    return judge(host)


# Platforms by the end of a profile's host.
SOCIAL_HOSTS = [
    (r"(^|\.)linkedin\.com$", "linkedin"),
    (r"(^|\.)facebook\.com$", "facebook"),
    (r"(^|\.)instagram\.com$", "instagram"),
    (r"(^|\.)(twitter|x)\.com$", "x"),
    (r"(^|\.)youtube\.com$", "youtube"),
    (r"(^|\.)tiktok\.com$", "tiktok"),
    (r"(^|\.)pinterest\.com$", "pinterest"),
    (r"(^|\.)yelp\.com$", "yelp"),
    (r"(^|\.)(g\.page|business\.google\.com)$", "google-business"),
]


def social_profile(normal: Column, own_domain: Column) -> Column:
    """struct(platform, url, handle) of a normalised profile link; null for any other."""

    def named(host: Column) -> Column:
        platform = F.lit(None).cast("string")
        for pattern, name in reversed(SOCIAL_HOSTS):
            platform = F.when(host.rlike(pattern), name).otherwise(platform)
        return F.when(~F.coalesce(F.endswith(host, own_domain), F.lit(False)), platform)

    def profile(url: Column) -> Column:
        handle = F.try_element_at(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), F.lit(-1))
        return let(let(host_of(url), named), lambda p: F.when(p.isNotNull(), F.struct(p.alias("platform"), url.alias("url"), handle.alias("handle"))))

    # the link and its host are bound, so each is worked out once
    return let(normal, profile)
