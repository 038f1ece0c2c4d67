"""A document's schema against the tables, and values against their enumerations."""

import json

import pytest
from pyspark.sql.types import StringType, StructField, StructType

from kbloom.functions import fields, schema
from kbloom.operators import store


@pytest.fixture(scope="module")
def whole(spark):
    return schema.document_schema(store.PROJECTIONS)


def without(kind: StructType, path: str, put: StructField | None = None) -> StructType:
    head, _, rest = path.partition(".")
    out = []
    for f in kind.fields:
        if f.name != head:
            out.append(f)
        elif rest:
            out.append(StructField(f.name, without(f.dataType, rest, put)))
        elif put:
            out.append(put)
    return StructType(out)


def test_the_whole_schema_agrees_with_all_tables(whole):
    assert schema.differences(whole, store.PROJECTIONS) == []
    paths = [p for p, _ in schema.leaves(whole)]
    assert len(paths) == len(set(paths)) > 150
    assert {p.split("[]")[0] for p in paths} >= {p for p, *_ in fields.FIELDS} - {"foundation.mainAddress", "branding.writingStyle", "contentIntelligence.taxonomy", "contentIntelligence.cadence"}
    assert dict(schema.leaves(whole))["people"] == "collection" and "people[].id" not in paths and "people[].name" in paths and "branding.writingStyle.tone" in paths


def test_broken_schemas_are_named(whole):
    broken = lambda *a: schema.differences(without(whole, *a), store.PROJECTIONS)
    assert broken("foundation.phone") == [("foundation.phone", "not in the schema")]
    assert broken("foundation.phone", StructField("phone", StringType())) == [("foundation.phone", "no envelope")]
    extra = StructType([*whole.fields, StructField("mood", StringType())])
    assert schema.differences(extra, store.PROJECTIONS) == [("mood", "not in the field table")]
    tables = {**store.PROJECTIONS, "people": ("people.value", store.PROJECTIONS["people"][1].replace("title string, ", "nick string, ").replace("bio string", "bio int"))}
    assert schema.differences(whole, tables) == [("people[].nick", "not in the schema"), ("people[].title", "not in the record table"), ("people[].bio", "another type")]


def test_values_outside_their_enumerations(spark):
    bodies = {
        "good": {"people": {"value": [{"role": "owner"}, {"role": None}]}, "foundation": {"businessModel": {"value": "b2b"}}, "branding": {"writingStyle": {"value": {"tone": ["warm"], "formality": "casual"}}}},
        "bad": {"people": {"value": [{"role": "boss"}, {"role": "owner", "gender": "x"}]}, "foundation": {"businessModel": {"value": "B2B"}}, "branding": {"writingStyle": {"value": {"tone": ["warm", "loud"]}}}},
        "empty": {},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()] + [("none", None), ("no", "no json")], "doc string, document string")
    got = sorted((r.doc, r.path, r.value) for r in schema.wrong_values(df).collect())
    assert got == [("bad", "branding.writingStyle.tone", "loud"), ("bad", "foundation.businessModel", "B2B"), ("bad", "people[].gender", "x"), ("bad", "people[].role", "boss")]
