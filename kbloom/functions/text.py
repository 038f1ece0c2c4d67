"""Sentences, words, syllables and the patterns found in visible text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kbloom.functions.dialect import half_up, let, squash, words_bounded

# Words that carry no topic.
STOP_WORDS = """
the a an and or but if then than that this these those of to in on at by for with from as is are was were be been being have
has had do does did will would should could can may might must shall not no yes it its we our us you your yours they their
them he she his her i me my all any some more most other into over after before up down out off about also just only very so
too there here when where which who what how why new get one two use using used make made see like time way well back even
because through during while between each both own same such now day days year years home page click read
""".split()

# Words that every business site uses.
BUSINESS_WORDS = """
service services business businesses company companies customer customers client clients team quality professional
professionals experience experienced solution solutions provide provides providing offer offers offering need needs help
helping work working best great top leading trusted reliable contact call today free learn more info information request quote
schedule appointment years local area areas people support product products industry industries value values commitment
committed dedicated mission vision choose why us
""".split()

# Fixed value: what a word is.
WORD = r"\b[a-zA-Z'’]+\b"
# Patterns of what a text says.
YOU = r"\b(you|your|yours|you're|you'll)\b"
WE = r"\b(we|our|ours|we're|we'll|us)\b"
# Fixed value: verbs that open an instruction.
IMPERATIVE = (
    r"^(call|get|schedule|book|contact|request|discover|find|learn|explore|start|try|join|sign|visit|see|check|let|don't|make|"
    r"take|give|ask|trust|choose|protect|save|stop|keep|bring|read|download|subscribe|order|shop|browse)\b"
)
# Fixed value: marks of text that isn't prose.
BOILERPLATE = r"\b(cookie|privacy policy|all rights reserved|©|skip to (main )?content)\b"


def has(text: Column, pattern: str) -> Column:
    """Case-insensitive search with ASCII word boundaries."""
    return F.lower(text).rlike(words_bounded(pattern))


#: WORD with each boundary as the two cases that its first and last characters leave.
_WORD = (
    r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z])|(?<=[A-Za-z0-9_])(?=['’]))[a-zA-Z'’]+"
    r"(?:(?<=[A-Za-z])(?![A-Za-z0-9_])|(?<=['’])(?=[A-Za-z0-9_]))"
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def sentences(squashed: Column) -> Column:
    """Sentences of three tokens or more of a squashed text."""
    parts = F.transform(F.split(squashed, r"(?<=[.!?])\s+(?=[A-Z\"“(])"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.size(F.split(s, " ")) >= 3)


def syllables(word: Column) -> Column:
    """Vowel groups of one or two letters, silent endings left out."""
    clean = F.regexp_replace(F.lower(word), "[^a-z]", "")
    cut = F.regexp_replace(F.regexp_replace(clean, "(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", "")
    return F.when(F.length(clean) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(cut, F.lit("[aeiouy]{1,2}"))))


def syllable_sum(all_words: Column) -> Column:
    """The `syllables` of all words together, by the same rules over one joined text."""
    clean = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.array_join(all_words, " ")), "[^a-z ]", ""), F.lit(" "))

    def longer(text: Column) -> Column:
        cut = F.regexp_replace(F.regexp_replace(text, "(?:[^laeiouy ]es|ed|[^laeiouy ]e)(?= )", ""), "(?<= )y", "")
        return let(cut, lambda t: F.regexp_count(t, F.lit("[aeiouy]{1,2}")) + F.regexp_count(t, F.lit("(?<= )[^aeiouy ]*(?= )")))

    some = let(clean, lambda t: F.regexp_count(t, F.lit("(?<= )[a-z]{0,3}(?= )")) + let(F.regexp_replace(t, "(?<= )[a-z]{0,3} ", ""), longer))
    return F.when(F.size(all_words) > 0, some).otherwise(0)


def term(word: Column) -> Column:
    """A word as a topic term; null for short, long, stop and generic words."""
    whole = F.lower(word)
    low = F.when(F.endswith(whole, F.lit("'s")) | F.endswith(whole, F.lit("’s")), F.substring(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole)
    return F.when(F.length(low).between(4, 24) & ~low.isin(sorted({*STOP_WORDS, *BUSINESS_WORDS})), low)


def metrics(text: Column, split: Column, all_words: Column) -> Column:
    """Measures of a squashed text, its sentences and its words."""
    n, w = F.size(split), F.size(all_words)
    mean = w / n
    lengths = F.transform(split, lambda s: F.size(F.split(s, " ")).cast("double"))
    spread = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    spoken = syllable_sum(all_words)
    grade = F.lit(0.39) * mean + F.lit(11.8) * (spoken / w) - F.lit(15.59)
    empty = (n == 0) | (w == 0)
    ratio = lambda p: F.when(empty, 0.0).otherwise(half_up(F.size(F.filter(split, p)) / n, 2))

    def matching(low: Column, pattern: str) -> Column:
        return F.size(F.filter(low, lambda s: s.rlike(words_bounded(pattern))))

    # the three patterns read the sentences in lower case, made once
    marks = let(F.transform(split, F.lower), lambda low: F.array(*[matching(low, p) for p in (YOU, WE, IMPERATIVE)]))
    share = lambda k: F.when(empty, 0.0).otherwise(half_up(F.get(marks, F.lit(k)) / n, 2))
    return F.struct(
        w.cast("long").alias("word_count"),
        n.cast("long").alias("sentence_count"),
        F.when(empty, 0.0).otherwise(half_up(mean, 2)).alias("mean_length"),
        F.when(empty, 0.0).otherwise(half_up(F.sqrt(spread), 2)).alias("length_stddev"),
        F.when(empty, 0.0).otherwise(half_up(F.greatest(grade, F.lit(0.0)), 2)).alias("reading_grade"),
        share(0).alias("second_person"),
        share(1).alias("first_person"),
        ratio(lambda s: F.contains(s, F.lit("!"))).alias("exclamations"),
        ratio(lambda s: F.contains(s, F.lit("?"))).alias("questions"),
        share(2).alias("imperatives"),
    )


def exemplars(split: Column, most: int = 12) -> Column:
    """Up to ``most`` sentences, evenly spread, that show how a text is written."""

    def usable(s: Column) -> Column:
        return F.size(F.split(s, " ")).between(6, 45) & (F.length(s) <= 320) & ~has(s, BOILERPLATE) & s.rlike("[.!?]$")

    def stride(good: Column) -> Column:
        step = F.size(good) / F.lit(float(most))
        spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(good, F.floor(i * step).cast("int")))
        return F.when(F.size(good) <= most, good).otherwise(spread)

    return let(F.filter(split, usable), stride)


# --- patterns ---

# Patterns of what a text says.
PHONE = r"(?:\+?1[\s.\-]?)?\(?[0-9]{3}\)?[\s.\-]?[0-9]{3}[\s.\-]?[0-9]{4}"
EMAIL = r"[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}"
US_ADDRESS = r"^(.*?),?\s*([A-Za-z .'\-]{2,30}),?\s+([A-Z]{2})\s+([0-9]{5}(?:-[0-9]{4})?)$"
SINCE = r"\b(?:since|est\.?|established(?:\s+in)?|serving\s+[^.,;]{0,50}\s+since|in\s+business\s+since|family[\- ]owned\s+since)\s+((?:18|19|20)[0-9]{2})\b"
LICENCE = r"\b(?:license|licence|lic\.?|reg(?:istration)?\.?)\s*(?:no\.?|number|#)?\s*[:#]?\s*([A-Za-z]{0,3}[\-\s]?[0-9]{3,8})\b"
# Claims that build trust, (category, unit, pattern with the value).
TRUST = [
    ("years-in-business", "years", r"\b(?:over|more than|nearly|almost)?\s*([0-9]{1,3}|a|one)\+?\s*(?:years?|decades?)\s+(?:of\s+)?(?:experience|in business|serving|of service)"),
    ("years-in-business", "year", r"\bsince\s+((?:19|20)[0-9]{2})\b"),
    ("customers-served", "customers", r"\b(?:over|more than|nearly)?\s*([0-9,]{2,10})\+?\s+(?:satisfied\s+)?(?:customers|clients|homeowners|families|businesses)\b"),
    ("projects-completed", "projects", r"\b(?:over|more than|nearly)?\s*([0-9,]{2,10})\+?\s+(?:projects|jobs|wells|installations|homes|systems|inspections)\s+(?:completed|drilled|installed|served|sold)?"),
    ("volume-transacted", "currency", r"\b(?:over|more than|nearly)?\s*\$\s*([0-9.,]+)\s*(billion|million|b|m)\b[^.]{0,40}"),
]


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit("(?i)" + words_bounded(pattern)), F.lit(group))


def phone(raw: Column) -> Column:
    """Ten digits as ddd-ddd-dddd; null for what is no such number."""
    digits = F.regexp_replace(F.regexp_replace(raw, "[^0-9]", ""), "^1([0-9]{10})$", "$1")
    false = digits.rlike("^(?:1{7,}|0{7,}|1234567890)$")
    return F.when((F.length(digits) == 10) & ~false, F.regexp_replace(digits, "^(...)(...)(....)$", "$1-$2-$3"))


def junk_email(address: Column) -> Column:
    low = F.lower(address)
    return low.rlike(r"(example|test|your|domain|email|sentry|wixpress|sample)\.(com|org|net)$") | low.rlike(r"^(user|name|youremail|info@example)") | low.rlike(r"\.(png|jpe?g|gif|webp|svg)$")


def us_address(line: Column) -> Column:
    part = lambda k: F.nullif(F.trim(F.regexp_extract(line, US_ADDRESS, k)), F.lit(""))
    return F.struct(line.alias("formatted"), part(1).alias("street"), part(2).alias("city"), part(3).alias("region"), part(4).alias("postal_code"))


def role_from_title(title: Column) -> Column:
    """A person's role by the words of the job title."""
    return (
        F.when(title.isNull() | (title == ""), F.lit(None))
        .when(has(title, r"\b(owner|founder|co-?founder|proprietor)\b"), "owner")
        .when(has(title, r"\b(ceo|cfo|coo|cto|president|vice president|vp|principal|partner)\b"), "executive")
        .when(has(title, r"\b(manager|director|supervisor|lead|foreman|superintendent)\b"), "manager")
        .when(has(title, r"\b(advisor|consultant|attorney|accountant)\b"), "advisor")
        .otherwise("staff")
    )


def name_from_title(title: Column) -> Column:
    """The shortest part of a page title, the first of equals, up to 60 long."""
    parts = F.filter(F.transform(F.split(title, r"\s*[|\-–—·»]\s*"), lambda s: F.trim(s)), lambda s: F.length(s) > 1)
    first = F.array_min(F.transform(parts, lambda s, i: F.struct(F.length(s).alias("n"), i.alias("i"), s.alias("s"))))
    return F.when(first["n"] <= 60, first["s"])


def offering_key(name: Column) -> Column:
    """A name for comparing offerings: generic words and punctuation left out."""
    bare = F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", " ")
    return squash(F.regexp_replace(bare, words_bounded(r"\b(services?|solutions?|systems?|company|inc|llc)\b"), ""))


# Categories of offerings by words of the name, first match wins.
CATEGORIES = [
    ("consultation", r"\b(consult|consultation|assessment|evaluation|audit|advice|advisory|planning session)\b"),
    ("financing", r"\b(financing|finance|loan|lease|payment plan|mortgage)\b"),
    ("subscription", r"\b(subscription|membership|monthly plan|maintenance plan|retainer)\b"),
    ("package", r"\b(package|bundle|plan|tier)\b"),
    ("industry-solution", r"\b(for (?:contractors|dealers|clinics|schools|restaurants)|industry|vertical)\b"),
    ("product", r"\b(equipment|parts|supplies|hardware|software|kit|unit|system)\b"),
]


def offering_category(name: Column) -> Column:
    out = F.lit("service")
    for category, pattern in reversed(CATEGORIES):
        out = F.when(has(name, pattern), category).otherwise(out)
    return out


def quote_key(quote: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(quote), "[^a-z0-9]", ""), 1, 120)


# Signs read as an ASCII one, and letters whose lower case is ASCII.
EVENED = {"'": "‘’‚‛", "-": "‐‑‒–—―", "i": "\u0130", "k": "\u212a"}


def for_match(text: Column) -> Column:
    """Text for verbatim comparison: case, quotes, dashes and signs evened out.

    All but ASCII words, apostrophes and hyphens becomes a space, so only ASCII
    is lower-cased; the pattern's one class is read several times faster than ranges.
    """
    for sign, others in EVENED.items():
        for other in others:
            text = F.replace(text, F.lit(other), F.lit(sign))
    return F.trim(F.lower(F.regexp_replace(text, r"[^\w'\-]+", " ")))


# Headline patterns, first match wins.
HEADLINES = [
    ("how-to", r"^(how to|how do|a guide to|guide to|the ultimate guide|steps to|ways to)\b"),
    ("listicle", r"^[0-9]+\s+[a-z0-9_]+|\btop\s+[0-9]+\b|\b[0-9]+\s+(?:ways|tips|reasons|things|signs|mistakes)\b"),
    ("question", r"\?\s*$"),
    ("comparison", r"\bvs\.?\b|\bversus\b|\bcompared to\b|\bwhich is better\b"),
    ("seasonal", r"\b(spring|summer|fall|autumn|winter|holiday|christmas|new year)\b"),
    ("announcement", r"\b(announcing|introducing|now offering|we[' ]re excited|new at|welcome)\b"),
]
# Patterns of what a text says.
LOCAL = r"\bin\s+[A-Z][a-z]+(?:,\s*[A-Z]{2})?\s*$|\bnear (me|you)\b"


def headline(title: Column) -> Column:
    out = F.when(title.rlike(words_bounded(LOCAL)), "local-service").otherwise("other")
    for name, pattern in reversed(HEADLINES):
        out = F.when(has(title, pattern), name).otherwise(out)
    return out


# Words that don't tell one offering from another.
GAP_WORDS = "and or the for of in a an to with services service solutions solution systems system products product our your".split()


def significant(name: Column) -> Column:
    """The first three telling words of an offering's name."""
    return F.slice(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: (F.length(w) > 3) & ~w.isin(GAP_WORDS)), 1, 3)


# Promises, (kind, pattern), one match of each.
GUARANTEES = [
    ("licensing", r"\b(?:fully\s+)?licensed(?:,)?\s*(?:and\s+)?(?:bonded)?(?:,)?\s*(?:and\s+)?insured\b"),
    ("satisfaction", r"\b(?:100%\s*)?satisfaction guarantee(?:d)?\b"),
    ("satisfaction", r"\bmoney[\- ]back guarantee\b"),
    ("warranty", r"\b([0-9]+)[\- ]year (?:warranty|guarantee)\b"),
    ("warranty", r"\blifetime (?:warranty|guarantee)\b"),
    ("insurance", r"\bfully insured\b"),
    ("bonding", r"\bbonded\b"),
]
# Credentials, (name, kind, pattern).
CREDENTIALS = [
    ("Certified Public Accountant (CPA)", "certification", r"\bCPA\b|\bCertified Public Accountant\b"),
    ("AICPA", "membership", r"\bAICPA\b|American Institute of (Certified Public Accountants|CPAs)"),
    ("QuickBooks Certified ProAdvisor", "certification", r"(?i)QuickBooks\s+(Certified\s+)?ProAdvisor"),
    ("National Ground Water Association (NGWA)", "membership", r"(?i)\bNGWA\b|National Ground ?Water Association"),
    ("Better Business Bureau", "accreditation", r"(?i)\bBBB\b|Better Business Bureau"),
    ("LEED", "certification", r"(?i)\bLEED\b\s*(certified|accredited)?"),
    ("NATE Certified", "certification", r"(?i)\bNATE[\- ]certified\b"),
    ("ASE Certified", "certification", r"(?i)\bASE[\- ]certified\b"),
    ("EPA Certified", "certification", r"(?i)\bEPA[\- ]certified\b"),
    ("National Association of Realtors", "membership", r"(?i)\bRealtor®|\bNAR\b|National Association of Realtors"),
    ("Multiple Listing Service", "membership", r"\bMLS\b"),
    ("Chamber of Commerce", "membership", r"(?i)Chamber of Commerce"),
]
# Patterns of what a text says.
SEASONAL = (
    r"\b((?:spring|summer|fall|autumn|winter|holiday|christmas|black friday|new year|memorial day|labor day|back[\- ]to[\- ]school)\b"
    r"[^.!?]{0,60}(?:special|savings|sale|offer|promotion|discount|deal|event))"
)
SERVING = r"\b(?:[Pp]roudly\s+)?[Ss]erv(?:ing|es)\s+([A-Z][A-Za-z.'\-]*(?:\s+[A-Z][A-Za-z.'\-]*){0,3}(?:\s*,\s*(?:and\s+)?(?:the\s+)?[A-Z][A-Za-z.'\-]*(?:\s+[A-Z][A-Za-z.'\-]*){0,3}){0,15})"
NOT_A_PLACE = (
    r"\b(customer|client|business|home|owner|need|since|year|community|team|company|service|quality|water|well|call|contact|free|estimate|and more|others|pumping|drilling|"
    r"plumbing|roofing|hvac|electric(?:al)?|landscaping|cleaning|repair|inspections?|monitoring|realty|group|associates|insurance|agency|solutions)\b"
)
AUDIENCE = (
    r"^(smbs?|smes?|clients?|customers?|businesses|companies|brands?|agencies|dealers?|contractors?|homeowners?|families|professionals?|realtors?|investors?|"
    r"patients?|students?)$"
)


def guarantees(text: Column) -> Column:
    """Promises as structs (kind, text): the first of each kind of wording."""
    each = [F.struct(F.lit(kind).alias("kind"), squash(F.regexp_extract(text, "(?i)" + words_bounded(p), 0)).alias("text")) for kind, p in GUARANTEES]
    some = F.filter(F.array(*each), lambda x: x["text"] != "")
    bonded = F.exists(some, lambda x: (x["kind"] != "bonding") & F.contains(F.lower(x["text"]), F.lit("bonded")))
    return F.filter(some, lambda x: ~((x["kind"] == "bonding") & bonded))


def credentials(text: Column) -> Column:
    """Named credentials as structs (name, kind)."""
    each = [F.when(text.rlike(words_bounded(p)), F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"))) for name, kind, p in CREDENTIALS]
    return F.array_compact(F.array(*each))


def service_areas(text: Column) -> Column:
    """Places that a text says are served, each once, in order."""
    lists = F.regexp_extract_all(text, F.lit(words_bounded(SERVING)), F.lit(1))
    parts = F.flatten(F.transform(lists, lambda x: F.split(squash(x), words_bounded(r"\s*(?:,|;|·|\||\band\b|&)\s*"))))
    clean = F.transform(parts, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "^(?i)the +", ""), r"[.!?]+$", "")))
    good = F.filter(clean, lambda x: F.length(x).between(3, 60) & x.rlike("^[A-Z]") & ~has(x, NOT_A_PLACE) & ~F.lower(x).rlike(AUDIENCE) & (F.size(F.split(x, " ")) <= 5))
    return F.array_distinct(good)
