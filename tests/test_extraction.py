"""Schemas, fields, evidence and scores on small replies; the worked arithmetic of the default scorer."""

import datetime
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from folioforge.functions import values
from folioforge.operators import evidence, fields, schema, scoring


@dataclass
class Vendor:
    name: str = schema.extract("who sells")
    taxID: str = schema.extract("")


@dataclass
class Item:
    description: str = schema.extract("")
    quantity: float = schema.extract("how many,min=0")
    unitPrice: float = schema.extract("each,min=0")


@dataclass
class Invoice:
    number: str = schema.extract("the number\\, as printed,required")
    issued: datetime.date = schema.extract("day of issue,required,format=date")
    currency: str = schema.extract("code,format=currency")
    method: str | None = schema.extract("how paid,enum=cash|card")
    total: float = schema.extract("amount due,required,min=0")
    vendor: Vendor = schema.extract("")
    items: list[Item] = schema.extract("lines")
    note = "untagged"


S = schema.reflect(Invoice)


def test_tags_and_keys():
    assert S.fields[0].description == "the number, as printed" and [f.key for f in S.leaves()] == ["number", "issued", "currency", "method", "total", "vendor.name", "vendor.tax_id", "items[].description", "items[].quantity", "items[].unit_price"]
    assert schema.key_of("VATRate") == "vat_rate" and schema.key_of("IBANNumber") == "iban_number" and schema.key_of("total") == "total"
    for bad in ("x,foo", "x,format=zip", "x,format=date,format=date", "x,min=a", "x,enum="):
        with pytest.raises(schema.SchemaError):
            schema.parse_tag(bad)


def test_json_schema():
    node = schema.json_schema(S)
    assert node["additionalProperties"] is False and node["required"][:3] == ["number", "issued", "currency"]
    assert node["properties"]["issued"] == {"type": ["string", "null"], "description": "day of issue", "format": "date"}
    assert node["properties"]["method"]["enum"] == ["cash", "card", None] and node["properties"]["total"]["minimum"] == 0
    assert schema.spark_type(S)["items"].dataType.elementType["unit_price"].dataType.simpleString() == "double"


REPLIES = [
    (1, '{"number":"A-7","issued":"3 April 2026","currency":"ugx","method":"cash","total":"1,200.50","vendor":{"Name":"Acme Ltd"},"items":[{"description":"x","quantity":2,"unit_price":600.25}]}', "Invoice A-7 of April 3, 2026\nACME Ltd total 1 200,50 UGX cash 2 x 600.25"),
    (2, '{"number":" ","issued":"03/04/2026","currency":"ABC","method":"barter","total":-5}', "nothing here"),
    (3, "not json", ""),
]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(REPLIES, "doc_id long, reply string, source string")
    f = fields.validate(fields.convert(fields.walk(df, S), values.country_codes(spark)), S)
    return evidence.ground(f, df.select("doc_id", "source")).cache()


def rows(df, doc):
    return {r.key: r for r in df.filter(F.col("doc_id") == doc).collect()}


def test_fields(table):
    one, two, three = (rows(table, k) for k in (1, 2, 3))
    assert one["total"].v_num == 1200.5 and one["currency"].v_str == "UGX" and one["issued"].v_ts.date() == datetime.date(2026, 4, 3)
    assert one["vendor.name"].raw == "Acme Ltd" and not one["vendor.tax_id"].found and one["items[0].quantity"].v_num == 2 and one["items"].found
    assert all(r.valid for k, r in one.items()) and not two["number"].found and not two["number"].valid
    assert two["issued"].ambiguous.day_first == datetime.date(2026, 4, 3) and not two["currency"].valid and not two["method"].valid and not two["total"].valid
    assert not any(r.found for r in three.values()) and "items" in three


def test_grounding(table):
    one, two, three = (rows(table, k) for k in (1, 2, 3))
    assert [one[k].grounding for k in ("number", "issued", "currency", "vendor.name", "total", "items[0].unit_price")] == [1.0, 0.8, 0.8, 0.8, 0.8, 1.0]
    assert two["total"].grounding == 0.0 and one["vendor.tax_id"].grounding is None and three["total"].grounding is None


def test_scores(spark, table):
    checks = evidence.cross_check(table, [evidence.CrossRule("items add up", "items", "total", ("items[].quantity", "items[].unit_price")), evidence.CrossRule("parts", "sum", "total", ("tax",))])
    got = {(r.doc_id, r.rule): (r.applicable, r.passed) for r in checks.collect()}
    assert got[1, "items add up"] == (True, True) and got[2, "items add up"] == (False, None) and got[1, "parts"] == (False, None)
    scored = scoring.score(scoring.with_cross_fields(table, checks)).cache()
    one, two = rows(scored, 1), rows(scored, 2)
    assert one["number"].confidence == 1.0 and one["issued"].confidence == 0.88 and two["total"].confidence == 0.33 or two["total"].confidence <= 0.35
    assert two["total"].reasons == ["value not in source", "low confidence"]
    final = {r.doc_id: r for r in scoring.answer(scored).collect()}
    assert final[1].valid and not final[2].valid and final[2].needs_review and final[3].confidence == 0.0
    said = {r.doc_id: r.explanation for r in scoring.explain(scoring.answer(scored), "number").collect()}
    assert said[1].startswith("number: A-7 (confidence 1.00, valid)\n  grounding 1.00 x 0.30")


@pytest.mark.parametrize(
    ("grounding", "agreement", "form", "rules", "ambiguous", "suspicious", "want", "caps"),
    [
        (1.0, None, "", [True], False, False, 1.0, []), (0.8, None, "", [True], False, False, 0.87, []), (0.0, None, "", [True], False, False, 0.33, []),
        (0.0, None, "iban", [True], False, False, 0.35, ["capped:grounding"]), (None, None, "", [True], False, False, 1.0, []),
        (None, None, "date", [True, False], True, False, 0.40, ["capped:rule"]), (1.0, None, "", [True], False, True, 0.60, ["capped:suspicious"]), (1.0, 0.0, "", [True], False, False, 0.50, ["capped:agreement"]),
    ],
)
def test_worked_scores(spark, grounding, agreement, form, rules, ambiguous, suspicious, want, caps):
    row = (1, "k", "k", "string", form, True, True, not ambiguous, [(f"r{i}", p, None) for i, p in enumerate(rules)], (datetime.date(2026, 4, 3),) if ambiguous else None, grounding, agreement, suspicious)
    df = spark.createDataFrame([row], "doc_id int, key string, group_key string, kind string, format string, required boolean, found boolean, converted boolean, rules array<struct<rule:string,passed:boolean,message:string>>, ambiguous struct<d:date>, grounding double, agreement double, suspicious boolean")
    r = scoring.score(df).first()
    assert r.confidence == want and [s.name for s in r.signals if s.weight == 0] == caps


def test_agreement(spark):
    cases = [("float", "25,000", "25000", True), ("float", "1", "2", False), ("time", "03/04/2026", "2026-04-03", True), ("bool", "true", "Yes", True), ("string", "Acme Ltd", "ACME  LTD", True), ("string", "Acme Ltd", "Acme Limited", False), ("string", "x", None, None), ("currency", "100 USD", "USD 100", True), ("currency", "USD 100", "EUR 100", False)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, kind string, a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", evidence.same_value(F.col("a"), F.col("b"), F.col("kind")).alias("got")).collect())
