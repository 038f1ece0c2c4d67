"""The shape of documents: a walk over a schema, and what it must agree with.

A document's schema is compared both ways with the field table and the record
tables (`differences`), and documents with the values that enumerated attributes
may have (`wrong_values`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from kbloom.functions import fields

#: What an envelope has; and the columns of a record that say where it is from.
ENVELOPE = {"value", "method", "confidence", "sourceUrls"}
PROVENANCE = {"id", "method", "confidence", "sourceUrls"}
#: Parts of a document that are no fields.
APART = ("sourceUrl", "scrape", "quality")

# What enumerated attributes may be; [] stands for the records of a list.
ENUMS = {
    "foundation.businessModel": "b2b b2c b2b2c b2g marketplace mixed",
    "foundation.companyRole": "manufacturer distributor retailer service-provider contractor agency broker consultancy software-vendor nonprofit other",
    "people[].role": "owner executive manager staff advisor unknown",
    "people[].gender": "male female unknown",
    "offerings[].category": "product service package subscription consultation financing industry-solution other",
    "proof.certifications[].kind": "license certification membership accreditation",
    "proof.memberships[].kind": "license certification membership accreditation",
    "proof.pressMentions[].kind": "feature quote listing",
    "proof.trustStats[].category": "years-in-business customers-served projects-completed volume-transacted team-size response-time other",
    "proof.guarantees[].kind": "warranty satisfaction licensing insurance bonding",
    "contentIntelligence.headlinePatterns[].pattern": "how-to listicle question comparison local-service seasonal announcement other",
    "branding.writingStyle.tone": "authoritative warm professional conversational technical reassuring urgent aspirational educational direct playful formal",
    "branding.writingStyle.formality": "casual neutral formal",
    "branding.writingStyle.readerAddress": "second-person third-person mixed",
}


def envelope(value: str) -> str:
    return f"struct<value: {value}, method: string, confidence: double, sourceUrls: array<string>, note: string>"


def document_schema(records: dict[str, tuple[str, str]]) -> StructType:
    """The schema of documents, from the field table and the record tables ``(path of the value, columns)``."""
    items = {path.removesuffix(".value"): item for path, item in records.values()}
    own = "id string, method string, confidence double, sourceUrls array<string>"
    numbers, texts = ("foundation.yearFounded", "foundation.employeeCount"), {"foundation.mainAddress": "struct<formatted: string, city: string, region: string, postalCode: string, country: string>"}
    texts["branding.writingStyle"] = "struct<description: string, tone: array<string>, formality: string, readerAddress: string, preferredTerms: array<string>, avoidTerms: array<string>, ctaStyle: string>"
    texts["contentIntelligence.taxonomy"] = "struct<categories: array<string>, tags: array<string>>"
    texts["contentIntelligence.cadence"] = "struct<postsPerMonth: double, firstPublished: string, lastPublished: string, daysSinceLast: bigint, isStale: boolean>"
    lists = ("foundation.otherLocations", "foundation.serviceLocations", "foundation.altNames", "market.buyers", "market.industryGroupings", "market.channels", "market.funnels", "market.ctas", "market.suppliersPartners", "branding.fonts")
    held: dict[str, list[str]] = {}
    for path, *_ in fields.FIELDS:
        struct = lambda columns: "array<struct<" + ", ".join(f"{c.split()[0]}: {c.split(' ', 1)[1]}" for c in columns.split(", ")) + ">>"
        value = struct(f"{own}, {items[path]}") if path in items else texts.get(path) or ("bigint" if path in numbers else "array<string>" if path in lists else "string")
        head, _, name = path.partition(".")
        held.setdefault(head, []).append(f"{name or head}: {envelope(value)}")
    parts = [f"{head} {members[0].split(': ', 1)[1]}" if "." not in next(p for p, *_ in fields.FIELDS if p.split(".")[0] == head) else f"{head} struct<{', '.join(members)}>" for head, members in held.items()]
    return StructType.fromDDL(", ".join(parts))


def leaves(kind: DataType, path: str = "") -> list[tuple[str, str]]:
    """(path, type) of every value: envelopes are their value, lists of records ``collection`` and their attributes."""
    if isinstance(kind, StructType):
        if set(kind.names) >= ENVELOPE:
            return leaves(kind["value"].dataType, path)
        return [leaf for f in kind.fields for leaf in leaves(f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        item = kind.elementType
        skipped = PROVENANCE if set(item.names) >= PROVENANCE else set()
        return [(path, "collection"), *(leaf for f in item.fields if f.name not in skipped for leaf in leaves(f.dataType, f"{path}[].{f.name}"))]
    return [(path, kind.simpleString())]


def differences(schema: StructType, records: dict[str, tuple[str, str]]) -> list[tuple[str, str]]:
    """(path, problem) where a schema disagrees with the field table, the record tables or the enumerations.

    Problems are ``not in the schema``, ``not in the field table``, ``not in the
    record table``, ``another type``, ``no envelope`` and ``not a text``.
    """
    found, out = leaves(schema), []
    kinds = dict(found)
    known = {p for p, *_ in fields.FIELDS}

    def at(path: str) -> DataType | None:
        kind: DataType | None = schema
        for name in path.split("."):
            kind = kind[name].dataType if isinstance(kind, StructType) and name in kind.names else None
        return kind

    for path in sorted(known):
        kind = at(path)
        if kind is None:
            out.append((path, "not in the schema"))
        elif not (isinstance(kind, StructType) and set(kind.names) >= ENVELOPE):
            out.append((path, "no envelope"))
    roots = {p.split("[]")[0] for p in kinds}
    out += [(p, "not in the field table") for p in sorted(roots) if p.split(".")[0] not in APART and not any(p == k or p.startswith(f"{k}.") for k in known)]
    for path, item in records.values():
        base = path.removesuffix(".value")
        if base.split(".")[0] in APART or at(base) is None:
            continue
        want = {f"{base}[].{f.name}": f.dataType.simpleString() for f in StructType.fromDDL(item).fields}
        have = {p: t for p, t in found if p.startswith(f"{base}[].")}
        out += [(p, "not in the schema") for p in want if p not in have] + [(p, "not in the record table") for p in have if p not in want]
        out += [(p, "another type") for p in want if p in have and want[p] != have[p]]
    out += [(p, "not a text") for p in ENUMS if p not in kinds or kinds[p] not in ("string", "array<string>")]
    return out


def wrong_values(documents: DataFrame) -> DataFrame:
    """(doc, path, value) of ``documents(doc, document)`` where an enumerated attribute has none of its values."""
    each = []
    for path, values in ENUMS.items():
        base, _, name = path.partition("[].")
        if name:
            held = F.try_variant_get(F.try_parse_json(F.get_json_object("document", f"$.{base}.value")), "$", "array<variant>")
            found = F.transform(held, _attribute(name))
        else:
            field, _, rest = path.rpartition(".") if path.count(".") == 2 else (path, "", "")
            text = F.get_json_object("document", f"$.{field}.value.{rest}" if rest else f"$.{field}.value")
            found = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
        bad = F.filter(found, _outside(values.split()))
        each.append(F.transform(bad, _named(path)))
    every = F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<struct<path: string, value: string>>")) for x in each]))
    return documents.select("doc", F.inline(every))


def _attribute(name: str):
    return lambda v: F.try_variant_get(v, f"$.{name}", "string")


def _outside(values: list[str]):
    return lambda x: x.isNotNull() & ~x.isin(values)


def _named(path: str):
    return lambda x: F.struct(F.lit(path).alias("path"), x.alias("value"))
