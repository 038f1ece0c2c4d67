"""Extractors: a page is parsed once and yields claims.

A claim is (page_id, extractor, seq, path, value, method, confidence); values of
records are JSON.  The two sequence columns are the order that reconciliation
breaks ties by.  An extractor that fails loses its own claims for that page.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbloom.functions import urls
from kbloom.functions.text import AUDIENCE, NOT_A_PLACE
from kbloom.operators.dom import Node, parse
from kbloom.sources.scratch import small_batches

CLAIMS = "page_id long, extractor int, seq int, path string, value string, method string, confidence double"

# --- structured data ---

# Structured-data types of businesses, and the endings of further ones.
BUSINESS_TYPES = frozenset(
    """Organization Corporation LocalBusiness NGO Airline Consortium Plumber Electrician Locksmith Roofing RoofingContractor HVACBusiness GeneralContractor
    HousePainter MovingCompany Dentist Physician MedicalClinic Optician Pharmacy VeterinaryCare LegalService Attorney Notary AccountingService InsuranceAgency
    FinancialService RealEstateAgent TravelAgency AutoRepair AutoDealer AutoBodyShop GasStation Restaurant Bakery CafeOrCoffeeShop BarOrPub Hotel Motel
    Campground Winery Brewery Distillery BeautySalon HairSalon NailSalon DaySpa TattooParlor HealthClub SportsClub Gym ChildCare Preschool School Library Museum
    Church Casino Florist Bookstore ClothingStore GroceryStore HardwareStore PetStore FurnitureStore JewelryStore Photographer EventVenue SelfStorage Landscaper
    PestControl WasteManagement SecurityService Emergency""".split()
)
# Fixed value: endings of types that name a business.
BUSINESS_ENDINGS = re.compile(r"(Business|Service|Agent|Store|Shop|Agency|Practice|Contractor|Company)$")


def _nodes(value, out: list[dict]) -> list[dict]:
    """Objects with a type, depth first."""
    if isinstance(value, list):
        for x in value:
            _nodes(x, out)
    elif isinstance(value, dict):
        if "@type" in value:
            out.append(value)
        for x in value.values():
            _nodes(x, out)
    return out


def _types(node: dict) -> list[str]:
    held = node.get("@type")
    return [str(x) for x in (held if isinstance(held, list) else [held])]


def _address(value) -> str | None:
    if isinstance(value, str):
        return value.strip() or None
    if not isinstance(value, dict):
        return None
    end = " ".join(str(value[k]) for k in ("addressRegion", "postalCode") if value.get(k))
    parts = [str(value[k]) for k in ("streetAddress", "addressLocality") if value.get(k)] + ([end] if end else [])
    return ", ".join(parts) or None


def json_ld(root: Node, page: dict):
    nodes: list[dict] = []
    for script in root.find("script"):
        if "ld+json" in (script.attrs.get("type") or ""):
            try:
                _nodes(json.loads("".join(k for k in script.kids if isinstance(k, str))), nodes)
            except ValueError:
                continue
    by_id: dict = {}
    for n in nodes:
        if isinstance(n.get("@id"), str):
            by_id.setdefault(n["@id"], n)

    def follow(x):
        return by_id.get(x["@id"], x) if isinstance(x, dict) and set(x) == {"@id"} else x

    firm = next((n for n in nodes if any(t in BUSINESS_TYPES or BUSINESS_ENDINGS.search(t) for t in _types(n))), None)
    if firm:
        for key, path in (("name", "companyName"), ("telephone", "foundation.phone"), ("email", "foundation.email"), ("foundingDate", "foundation.yearFounded"), ("url", "foundation.website")):
            if isinstance(firm.get(key), str) and firm[key].strip():
                yield path, firm[key].strip(), "json-ld", 0.8 if key == "url" else 0.95
        address = _address(follow(firm.get("address")))
        if address:
            yield "foundation.mainAddress", address, "json-ld", 0.95
        links = firm.get("sameAs") or []
        for link in links if isinstance(links, list) else [links]:
            if isinstance(link, str) and link.startswith("http"):
                yield "onlinePresence.profiles", link, "json-ld", 0.95
    for n in nodes:
        if "Question" in _types(n):
            answer = follow(n.get("acceptedAnswer"))
            if isinstance(answer, dict) and n.get("name") and answer.get("text"):
                yield "contentIntelligence.faqs", {"question": str(n["name"]).strip(), "answer": re.sub(r"<[^>]+>", " ", str(answer["text"])).strip()}, "json-ld", 0.95
        if "Person" in _types(n) and n.get("name") and any(n.get(k) for k in ("jobTitle", "description", "worksFor", "image")):
            yield "people", {"name": str(n["name"]), "title": n.get("jobTitle")}, "json-ld", 0.95


# --- metadata and contact ---


def metadata(root: Node, page: dict):
    meta = {}
    for n in root.find("meta"):
        name = (n.attrs.get("property") or n.attrs.get("name") or "").lower()
        if name and n.attrs.get("content", "").strip():
            meta.setdefault(name, n.attrs["content"].strip())
    if "og:site_name" in meta:
        yield "companyName", meta["og:site_name"], "opengraph", 0.85
    if len(meta.get("description", "")) > 40:
        yield "foundation.overview", meta["description"], "meta", 0.5 if page["role"] == "home" else 0.35
    if "og:image" in meta:
        yield "branding.logos", urljoin(page["url"], meta["og:image"]), "opengraph", 0.4
    if page["role"] == "home":
        link = next((n.attrs.get("href") for n in root.find("link") if (n.attrs.get("rel") or "").lower() == "canonical"), None) or meta.get("og:url")
        if link:
            yield "foundation.website", urljoin(page["url"], link), "meta", 0.8


def contact(root: Node, page: dict):
    for n in root.find("a"):
        href = n.attrs.get("href") or ""
        if href.lower().startswith("tel:"):
            digits = re.sub(r"\D", "", href)[-10:]
            if len(digits) == 10:
                yield "foundation.phone", f"{digits[:3]}-{digits[3:6]}-{digits[6:]}", "dom", 0.85
        elif href.lower().startswith("mailto:"):
            yield "foundation.email", href[7:].split("?")[0].lower(), "dom", 0.85
    for n in root.find("address"):
        if n.text():
            yield "foundation.mainAddress", n.text(apart=True), "dom", 0.7


# --- people, offerings, content ---

# Class names of cards.
_CARD = r"(^|[\s_-])(team|staff|person|people|member|bio|employee|profile)s?([\s_-]|$)"
_SERVICE = r"(^|[\s_-])(service|offering|product|solution|feature)s?([\s_-]|$)"
_PERSON = re.compile(r"^[A-Z][\w'’.-]+(?: (?:[A-Z]\.?|de|van|von))?(?: [A-Z][\w'’-]+){1,2}$")


def _innermost(root: Node, pattern: str) -> list[Node]:
    """Marked elements with a heading that hold no other such element."""
    marked = [n for n in root.walk() if n.attrs.get("class") and n.has_class(pattern) and n.first("h2", "h3", "h4", "h5")]
    held = {id(n) for n in marked}
    outer = set()
    for n in marked:
        up = n.up
        while up is not None:
            if id(up) in held:
                outer.add(id(up))
            up = up.up
    return [n for n in marked if id(n) not in outer]


def people(root: Node, page: dict):
    if page["role"] not in ("team", "about"):
        return
    seen = set()
    for card in _innermost(root, _CARD):
        name = card.first("h2", "h3", "h4", "h5").text()
        if not _PERSON.match(name) or name.lower() in seen or len(seen) >= 30:
            continue
        seen.add(name.lower())
        lines = [n.text() for n in card.find("p", "span", "div") if n.text() and n.text() != name]
        title = next((t.rstrip(".") for t in lines if len(t) <= 70 and len(t.split()) <= 8 and not re.search(r"\d", t)), None)
        bio = next((t[:800] for t in lines if len(t) >= 60 and re.search(r"[.!?]", t)), None)
        yield "people", {"name": name, "title": title, "bio": bio}, "dom", 0.7


def offerings(root: Node, page: dict):
    if page["role"] not in ("services", "products", "pricing"):
        return
    seen = set()
    for card in _innermost(root, _SERVICE):
        name = card.first("h2", "h3", "h4", "h5").text()
        if not 3 <= len(name) <= 80 or name.lower() in seen or len(seen) >= 40:
            continue
        seen.add(name.lower())
        text = next((n.text() for n in card.find("p") if len(n.text()) >= 20), None)
        yield "offerings", {"name": name, "description": text}, "dom", 0.65


# Labels that are navigation, and verbs of calls to action.
NOT_A_CALL = re.compile(
    r"^(home|about|about us|services|products|contact|contact us|blog|news|faq|menu|search|login|log in|sign in|sign up|register|privacy|terms|sitemap|next|"
    r"previous|prev|back|close|skip to content|read more|learn more|more|toggle navigation|español|english)$", re.I)  # fmt: skip
CALL = re.compile(
    r"\b(call|get|request|schedule|book|start|contact|apply|shop|buy|order|subscribe|sign|join|download|claim|talk|speak|find|discover|explore|see|view|reserve|"
    r"try|quote|estimate|consult|notify|submit)\b", re.I)  # fmt: skip


def content(root: Node, page: dict):
    seen, n_faqs = set(), 0
    for n in root.find("details"):
        head = n.first("summary")
        if head is None or n_faqs >= 40:
            continue
        question = head.text()
        answer = n.text(apart=True)[len(head.text(apart=True)) :].strip()
        if question.endswith("?") and 8 <= len(question) <= 250 and 15 <= len(answer) <= 2000 and question.lower() not in seen:
            seen.add(question.lower())
            n_faqs += 1
            yield "contentIntelligence.faqs", {"question": question, "answer": answer}, "dom", 0.7
    counts: dict[str, int] = {}
    for n in root.walk():
        button = n.tag == "button" or n.attrs.get("role") == "button" or n.tag == "a" and n.has_class("btn|button") or n.tag == "input" and n.attrs.get("type") == "submit"
        label = (n.attrs.get("value") or n.text()) if button else ""
        if 3 <= len(label) <= 60 and not NOT_A_CALL.match(label) and CALL.search(label):
            counts[label] = counts.get(label, 0) + 1
    for label, _ in sorted(counts.items(), key=lambda x: -x[1])[:12]:
        yield "market.ctas", label, "dom", 0.65
    terms: dict[str, tuple[str, str]] = {}
    for dt in root.find("dt"):
        dd = dt.after()
        if dd is not None and dd.tag == "dd" and dt.text() and len(dt.text()) <= 60 and 25 <= len(dd.text()) <= 600:
            terms.setdefault(dt.text().lower(), (dt.text(), dd.text()))
    for head in root.find("h2", "h3", "h4"):
        name, body = head.text(), head.after()
        text = body.text() if body is not None and body.tag == "p" else ""
        if name and len(name) <= 50 and len(name.split()) <= 5 and 40 <= len(text) <= 600 and re.match(rf"(the\s+)?{re.escape(name)}\s+(is|are|refers to|means)\b", text, re.I):
            terms.setdefault(name.lower(), (name, text))
    for name, text in list(terms.values())[:25]:
        yield "contentIntelligence.glossary", {"term": name, "definition": text}, "dom", 0.6


def testimonials(root: Node, page: dict):
    seen = set()
    marked = [n for n in root.walk() if n.tag == "blockquote" or n.attrs.get("class") and n.has_class("testimonial|review|quote")]
    held = {id(n) for n in marked}
    for n in marked:
        if any(id(k) in held for k in n.walk() if k is not n):
            continue
        quote = n.text(apart=True).strip("\"“” ")
        key = re.sub(r"[^a-z0-9]", "", quote.lower())[:120]
        if 40 <= len(quote) <= 900 and re.search(r"[.!?]", quote) and key not in seen:
            seen.add(key)
            yield "proof.testimonials", {"quote": quote}, "dom", 0.65


# Headings over the places that a company serves.
AREA_HEADING = re.compile(
    r"\b(areas?\s+(we\s+)?serve[sd]?|service\s+areas?|communities?\s+we\s+serve|where\s+we\s+work|locations?\s+we\s+serve|proudly\s+serving|now\s+serving)\b", re.I)
_PLACE = re.compile(r"^[A-Z]")
_NO_PLACE = re.compile(NOT_A_PLACE, re.I)
_AUDIENCE = re.compile(AUDIENCE, re.I)


def locations(root: Node, page: dict):
    """Items of lists, or of the paragraph, that follow an area heading."""
    seen = set()
    for head in root.find("h1", "h2", "h3", "h4", "h5", "h6", "strong"):
        if not AREA_HEADING.search(head.text()) or len(head.text()) > 80:
            continue
        names, after, steps = [], head.after(), 0
        while after is not None and steps < 3:
            names += [n.text() for n in after.find("li")]
            if after.tag == "p":
                names += [re.sub(r"^the\s+|[.!?]+$", "", x, flags=re.I).strip() for x in re.split(r"\s*(?:,|;|·|\||\band\b|&)\s*", after.text())]
            after, steps = after.after(), steps + 1
        for name in names:
            good = 3 <= len(name) <= 60 and _PLACE.match(name) and len(name.split()) <= 5 and not _NO_PLACE.search(name) and not _AUDIENCE.match(name)
            if good and name.lower() not in seen and len(seen) < 40:
                seen.add(name.lower())
                yield "foundation.serviceLocations", name, "dom", 0.7


def logos(root: Node, page: dict):
    """Up to three images of the home page that call themselves a logo."""
    if page["role"] != "home":
        return
    seen = set()
    for image in root.find("img"):
        source = image.attrs.get("src") or image.attrs.get("data-src") or image.attrs.get("data-lazy-src") or (image.attrs.get("srcset") or "").split(" ")[0]
        near, up = False, image.up
        while up is not None:
            near = near or up.tag == "header" or up.has_class("logo") or up.tag == "a" and up.has_class("brand")
            up = up.up
        hints = [source or "", image.attrs.get("alt") or "", image.attrs.get("class") or "", image.attrs.get("id") or ""]
        if source and (near or any("logo" in h.lower() for h in hints[2:])) and any(re.search("logo|brand", h, re.I) for h in hints[:3]):
            url = urljoin(page["url"], source)
            if url not in seen and len(seen) < 3:
                seen.add(url)
                yield "branding.logos", {"url": url, "alt": image.attrs.get("alt")}, "dom", 0.75


def funnels(root: Node, page: dict):
    """Ways in which a visitor can convert."""
    found = []
    if root.first("form"):
        words = " ".join(f.text() for f in root.find("form")).lower()
        kinds = [("quote|estimate", "Quote request form"), ("appointment|schedule|book", "Appointment scheduler"), ("subscribe|newsletter|email updates", "Newsletter signup")]
        found.append(next((name for pattern, name in kinds if re.search(pattern, words)), "Contact form"))
    links = [n.attrs.get("href") or "" for n in root.find("a")]
    html = page["html"] or ""
    tests = [
        (any(h.startswith("tel:") for h in links), "Phone call"),
        (any(h.startswith("mailto:") for h in links), "Email"),
        (re.search(r"calendly\.com|acuityscheduling\.com|housecallpro\.com", html, re.I), "Online booking"),
        (re.search("mailchimp|klaviyo|constantcontact|list-manage", html, re.I), "Newsletter signup"),
        (any("/cart" in h or "/checkout" in h for h in links) or any("cart" in (f.attrs.get("action") or "") for f in root.find("form")), "Online checkout"),
        (re.search(r"livechat|tawk\.to|intercom|drift\.com|messenger", html, re.I), "Live chat"),
    ]
    for name in dict.fromkeys([*found, *(name for test, name in tests if test)]):
        yield "market.funnels", name, "dom", 0.7


def posts(root: Node, page: dict):
    """Posts that a blog's index lists."""
    if page["role"] != "blog-index":
        return
    seen = set()
    for item in root.walk():
        if not (item.tag == "article" or item.attrs.get("class") and item.has_class("post|entry")) or item.first("article"):
            continue
        link, head = next((a for a in item.find("a") if a.attrs.get("href")), None), item.first("h1", "h2", "h3", "h4")
        title = (head.text() if head else "") or (link.text() if link else "")
        if link is None or not 8 <= len(title) <= 200:
            continue
        url = urljoin(page["url"], link.attrs["href"])
        if url in seen or len(seen) >= 40:
            continue
        seen.add(url)
        time, text = item.first("time"), item.first("p")
        when = (time.attrs.get("datetime") or time.text() or None) if time else None
        yield "contentIntelligence.posts", {"title": title, "url": url, "publishedAt": when, "excerpt": text.text() if text else None}, "dom", 0.65


# Fixed value: job words of a title.
_JOB = re.compile(r"\b(owner|founder|president|ceo|cfo|coo|cto|manager|director|supervisor|lead|foreman|technician|advisor|consultant|attorney|accountant|partner|principal|driller|engineer|agent|assistant|specialist|coordinator)\b", re.I)


def people_in_sequence(root: Node, page: dict):
    """People named by a heading whose next lines are a job title."""
    if page["role"] not in ("team", "about"):
        return
    lines = [n for n in root.walk() if n.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "span") and n.text()]
    for k, line in enumerate(lines):
        name = line.text()
        if line.tag[0] != "h" or not _PERSON.match(name):
            continue
        after = [n.text() for n in lines[k + 1 : k + 8]]
        title = next((t.rstrip(".") for t in after[:2] if len(t) <= 70 and len(t.split()) <= 8 and not re.search(r"\d", t) and _JOB.search(t)), None)
        if title:
            bio = next((t[:800] for t in after if len(t) >= 60 and re.search(r"[.!?]", t)), None)
            yield "people", {"name": name, "title": title, "bio": bio}, "dom", 0.6


EXTRACTORS = [json_ld, metadata, contact, people, offerings, content, testimonials, locations, logos, funnels, posts, people_in_sequence]


def _claims(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for page in batch.to_dict("records"):
            root = parse(page["html"])
            for k, extractor in enumerate(EXTRACTORS):
                try:
                    found = list(extractor(root, page))
                except Exception:  # noqa: BLE001  a page loses this extractor's claims only
                    continue
                for seq, (path, value, method, confidence) in enumerate(found):
                    rows.append((page["page_id"], k, seq, path, value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), method, confidence))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in CLAIMS.split(", ")])


def claims(pages: DataFrame) -> DataFrame:
    """The claims of ``pages(page_id, url, role, html)``."""
    return small_batches(pages.select("page_id", "url", "role", "html")).mapInPandas(_claims, CLAIMS)


# --- vendors ---

# Vendors by host, first match wins.
VENDORS = [
    ("Google Analytics", r"google-analytics\.com|googletagmanager\.com"),
    ("Google", r"(^|\.)(google|gstatic|googleapis|googleusercontent)\.com$"),
    ("Google Ads", r"googleadservices\.com|doubleclick\.net"),
    ("Plausible", r"plausible\.io"),
    ("Fathom", r"usefathom\.com"),
    ("Hotjar", r"hotjar\.com"),
    ("Meta Pixel", r"connect\.facebook\.net"),
    ("HubSpot", r"hubspot\.com|hs-scripts\.com|hsforms\.(net|com)"),
    ("Salesforce", r"salesforce\.com|force\.com"),
    ("Mailchimp", r"mailchimp\.com|list-manage\.com|chimpstatic\.com"),
    ("Sendgrid", r"sendgrid\.(net|com)"),
    ("MailGun", r"mailgun\.(net|org|com)"),
    ("Klaviyo", r"klaviyo\.com"),
    ("Constant Contact", r"constantcontact\.com"),
    ("ActiveCampaign", r"activehosted\.com|activecampaign\.com"),
    ("Wufoo", r"wufoo\.com"),
    ("Typeform", r"typeform\.com"),
    ("Jotform", r"jotform\.com"),
    ("Gravity Forms", r"gravityforms\.com"),
    ("Calendly", r"calendly\.com"),
    ("Acuity Scheduling", r"acuityscheduling\.com"),
    ("Housecall Pro", r"housecallpro\.com"),
    ("ServiceTitan", r"servicetitan\.com"),
    ("Stripe", r"stripe\.(com|network)"),
    ("PayPal", r"paypal(objects)?\.com"),
    ("Square", r"squareup\.com|squarecdn\.com"),
    ("Birdeye", r"birdeye\.com"),
    ("Trustpilot", r"trustpilot\.com"),
    ("Yotpo", r"yotpo\.com"),
    ("Podium", r"podium\.com"),
    ("NiceJob", r"nicejob\.co"),
    ("Yelp", r"yelp\.com"),
    ("Yext", r"yext(apis)?\.com"),
    ("Bright Local", r"brightlocal\.com"),
    ("Intercom", r"intercom\.(io|com)"),
    ("Drift", r"drift\.com"),
    ("Tawk.to", r"tawk\.to"),
    ("Zendesk", r"zendesk\.com|zdassets\.com"),
    ("Twilio", r"twilio\.com|twiliocdn\.com"),
    ("DialogTech", r"dialogtech\.com"),
    ("CallRail", r"callrail\.com"),
    ("Cloudflare", r"cloudflare(insights)?\.com|cdnjs\.cloudflare\.com"),
    ("Amazon Web Services", r"amazonaws\.com|awsstatic\.com"),
    ("Rackspace", r"rackspace\.com|rackcdn\.com"),
    ("Box.com", r"box\.(com|net)"),
    ("Dropbox", r"dropbox(static)?\.com"),
    ("Vimeo", r"vimeo(cdn)?\.com"),
    ("YouTube", r"youtube(-nocookie)?\.com|ytimg\.com"),
    ("Wistia", r"wistia\.(com|net)"),
    ("TransUnion", r"transunion\.com|tlo\.com"),
    ("Elfsight", r"elfsight\.com"),
    ("jQuery", r"code\.jquery\.com"),
    ("WordPress.com", r"wp\.com|wordpress\.com"),
    ("Wix", r"wix(static|apps)?\.com|parastorage\.com"),
    ("Squarespace", r"squarespace(-cdn)?\.com"),
    ("Shopify", r"shopify(cdn|cloud)?\.com"),
    ("Webflow", r"webflow\.(com|io)"),
    ("HighLevel", r"gohighlevel\.com|leadconnectorhq\.com"),
    ("Usercentrics", r"usercentrics\.(eu|com)"),
    ("UserWay", r"userway\.org"),
    ("jsDelivr", r"jsdelivr\.net"),
    ("unpkg", r"unpkg\.com"),
    ("LiveChat", r"livechatinc\.com"),
    ("Popupsmart", r"popupsmart\.com"),
    ("Diverse Solutions", r"diversesolutions\.com"),
    ("CountingWorks Pro", r"countingworkspro\.com"),
    ("UI Avatars", r"ui-avatars\.com"),
]
# Hosts that are no supplier's.
NOT_A_SUPPLIER = r"(^|\.)(facebook|instagram|twitter|x|linkedin|youtube|tiktok|pinterest|reddit|yelp|example)\.(com|org|net)$"
SPECIFICATIONS = r"(^|\.)(w3|schema|gmpg|purl|xmlns|dublincore)\.org$"
MOST_UNKNOWN = 15


def _hosts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = set()
        for page_id, url, html in zip(batch.page_id, batch.url, batch.html, strict=True):
            for n in parse(html).find("script", "iframe", "link", "img"):
                target = n.attrs.get("src") or n.attrs.get("href")
                if target:
                    try:
                        host = urlsplit(urljoin(url or "", target)).hostname
                    except ValueError:
                        continue
                    if host:
                        rows.add((page_id, url, host))
        yield pd.DataFrame(sorted(rows), columns=["page_id", "url", "host"])


def vendors(pages: DataFrame) -> DataFrame:
    """(page_id, vendor, method): known vendors, and up to 15 other foreign hosts.

    Social and specification hosts are no suppliers, nor are names of eight
    letters or more with less than a quarter of vowels, which no person chose.
    """
    found = small_batches(pages.select("page_id", "url", "html")).mapInPandas(_hosts, "page_id long, url string, host string")
    foreign = found.where(urls.registrable_domain(F.col("host")) != urls.registrable_domain(urls.host_of(F.col("url"))))
    name = F.lit(None).cast("string")
    for vendor, pattern in reversed(VENDORS):
        name = F.when(F.col("host").rlike(pattern), vendor).otherwise(name)
    named = foreign.withColumn("name", name)
    label = F.substring_index(urls.registrable_domain(F.col("host")), ".", 1)
    made_up = (F.length(label) >= 8) & (F.length(F.regexp_replace(label, "[^aeiouy]", "")) / F.length(label) < 0.25)
    other = named.where(F.col("name").isNull() & ~F.col("host").rlike(NOT_A_SUPPLIER) & ~F.col("host").rlike(SPECIFICATIONS) & ~made_up).select("page_id", F.col("host").alias("vendor")).distinct()
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("vendor"))
    other = other.withColumn("place", place).where(F.col("place") <= MOST_UNKNOWN).select("page_id", "vendor", F.lit("heuristic").alias("method"))
    return named.where("name is not null").select("page_id", F.col("name").alias("vendor"), F.lit("dom").alias("method")).distinct().unionByName(other)
