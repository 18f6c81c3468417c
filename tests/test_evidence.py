"""Grounding of money, arrays, derived values and dates; findings; corpus loading, equality and acquisition."""

import json

import pytest
from pyspark.sql import functions as F

from folioforge.functions import values
from folioforge.operators import acquire, evidence, fields, mapping, normalise, schema, scoring
from folioforge.plans import evaluation, joins

ITEM = schema.Field("amounts", "amounts", "array", elem=schema.Field("", "amounts[]", "float"))
S = schema.Field("x", "", "object", fields=(
    schema.Field("price", "price", "string", rules=(schema.Rule("format", "currency"),)), schema.Field("day", "day", "time"), schema.Field("paid", "paid", "bool"), schema.Field("count", "count", "int", bits=8), ITEM,
))


def grounded(spark, reply, source, **more):
    df = spark.createDataFrame([(1, json.dumps(reply), source)], "doc_id long, reply string, source string")
    f = fields.convert(fields.walk(df, S), values.country_codes(spark))
    return {r.key: r for r in evidence.ground_arrays(evidence.ground(f, df.select("doc_id", "source"), **more)).collect()}


@pytest.mark.parametrize(
    ("price", "source", "want"),
    [("100 USD", "we owe USD 100.00 now", 0.8), ("100 USD", "we owe $100", 0.8), ("100 USD", "we owe EUR 100", 0.0), ("€1.234,56", "sum 1 234,56 EUR", 0.8), ("100 USD", "100 apples, and much later USD", 0.0), ("100 USD", "pay 100 USD", 1.0)],
)
def test_money(spark, price, source, want):
    assert grounded(spark, {"price": price}, source)["price"].grounding == want


def test_dates_booleans_arrays_and_derived(spark):
    got = grounded(spark, {"day": "2026-03-04", "paid": True, "amounts": [1, 2.5, 9]}, "On 4/3/26, paid: yes. 1 and 2,50")
    assert [got[k].grounding for k in ("day", "paid", "amounts[0]", "amounts[1]", "amounts[2]")] == [0.8, 0.8, 1.0, 0.8, 0.0]
    assert got["amounts"].grounding == pytest.approx(0.6) and not got["amounts"].exact and got["amounts"].at == got["amounts[0]"].at
    assert grounded(spark, {"day": "2026-03-04"}, "On 4/3/26", date_order="mdy")["day"].grounding == 0.0
    assert grounded(spark, {"amounts": [7]}, "nothing", derivable=F.lit(True))["amounts[0]"].grounding == 0.5
    assert grounded(spark, {"amounts": []}, "nothing")["amounts"].grounding is None


def test_widths(spark):
    assert grounded(spark, {"count": 128}, "128")["count"].v_int is None and grounded(spark, {"count": 127}, "127")["count"].v_int == 127


def test_findings(spark):
    rows = [(1, "Title", "Please ignore  previous chapters"), (2, "Keywords", "json, prompt"), (3, "T", "[/INST] x"), (4, "T", "You must respond with care"), (5, "T", "instruction")]
    got = normalise.instruction_findings(spark.createDataFrame(rows, "doc_id long, meta_key string, value string"))
    assert {r.doc_id for r in got.collect()} == {1, 3, 4}
    said = {r.doc_id: r.suspicions for r in normalise.suspicions(got).collect()}
    assert said[1] == ["metadata field Title that addresses a model"]
    df = spark.createDataFrame([(1, "zero-width", 2, 0x200B, None, 3), (1, "zero-width", 2, 0x200B, None, 4)], "doc_id long, kind string, page int, cp int, meta_key string, n int")
    merged = normalise.merge_findings(df.withColumn("box", F.lit(None).cast("struct<minx:double,miny:double,maxx:double,maxy:double>")))
    assert normalise.suspicions(merged).first().suspicions == ["character without width U+200B on page 2, 7 times"]


def test_readings(spark):
    rows = [(1, "k", 0, "1,000", 0.5), (1, "k", 1, "1000", 0.5), (1, "k", 2, None, 0.9), (2, "k", 0, "1", 0.1), (2, "k", 1, "2", 0.2), (3, "k", 0, "1", 0.1), (4, "k", 0, " ", 0.1)]
    got = {r.doc_id: (r.best, r.missing, r.agreed) for r in joins.candidates(spark.createDataFrame(rows, "doc_id long, key string, reading int, raw string, confidence double"), F.lit("float")).collect()}
    assert got == {1: ("1,000", [2], True), 2: ("2", [], False), 3: ("1", [], None), 4: (None, [0], None)}


EQUAL = [
    ("25000", "number", "25,000", "string", True), ("18430.55", "number", "18430.55", "number", True), ("UGX 78,470", "string", "78470", "number", False), ("100 USD", "string", "USD 100", "string", True), ("100 USD", "string", "100 EUR", "string", False),
    ("Acme Ltd", "string", "ACME  LTD", "string", True), ("Acme Ltd", "string", "Acme Limited", "string", False), ("007", "string", "7", "string", False), ("2026-03-14", "string", "2026-03-14T00:00:00Z", "time", True), ("true", "bool", "yes", "string", False), ("50", "number", "50%", "string", False),
]


def test_equality(spark):
    df = spark.createDataFrame(EQUAL, "w string, wt string, g string, gt string, want boolean")
    assert [r.got for r in df.select(evaluation.same_typed(F.col("w"), F.col("g"), F.col("wt"), F.col("gt")).alias("got")).collect()] == [e[-1] for e in EQUAL]


def test_flatten(spark):
    rows = [(1, '{"a":{"b":[{"c":1.50},{"c":null}],"e":{}},"f":"x","g":[],"h":false,"n":null,"m":[[1,2]]}'), (2, "[1]"), (3, "no"), (4, "{}"), (5, None)]
    got = {(r.doc, r.key): (r.type, r.text) for r in evaluation.flatten(spark.createDataFrame(rows, "doc long, expected string")).collect()}
    assert got == {(1, "a.b[0].c"): ("number", "1.5"), (1, "a.e"): ("object", "{}"), (1, "f"): ("string", "x"), (1, "g"): ("array", "[]"), (1, "h"): ("bool", "false"), (1, "m[0][0]"): ("number", "1"), (1, "m[0][1]"): ("number", "2")} or got[1, "a.b[0].c"] == ("number", "1.50")


def test_load(spark, tmp_path):
    for k, extra in (("001", "exclude: [total, 'items[0].x']\n"), ("002", "exclude:\n  - notes\n  - vendor.name\n")):
        (tmp_path / "forms").mkdir(exist_ok=True)
        (tmp_path / "forms" / f"{k}.meta.yaml").write_text(f"source: synthetic\nlicence: CC0-1.0\nredacted: nothing\ndifficulty: good-scan\npages: 2\nlanguage: en\n{extra}")
        (tmp_path / "forms" / f"{k}.expected.json").write_text('{"total": 5}')
    got = {r.name: r for r in evaluation.load(spark, str(tmp_path), ["forms"]).collect()}
    assert got["001"].exclude == ["total", "items[0].x"] and got["002"].exclude == ["notes", "vendor.name"] and got["001"].pages == 2 and got["001"].difficulty == "good-scan" and got["002"].category == "forms"
    (tmp_path / "forms" / "003.meta.yaml").write_text("source: synthetic\ndifficulty: good-scan\n")
    with pytest.raises(Exception, match="forms/003 lacks licence, expected"):
        evaluation.load(spark, str(tmp_path), ["forms"]).collect()


def test_acquire(spark):
    files = spark.createDataFrame([(1, "pdf", None), (2, "csv", None), (3, "png", None), (4, "png", "malformed")], "doc_id long, kind string, error string")
    of = lambda mode, **p: [(r.route, r.error) for r in acquire.route(files, mode, acquire.Providers(**p)).orderBy("doc_id").collect()]
    assert of("auto") == [("text", None), ("office", None), ("vision", None), (None, "malformed")]
    assert of("ocr") == [(None, "no_provider"), ("office", None), (None, "no_provider"), (None, "malformed")]
    assert of("ocr", document_ocr=True, ocr=True)[0] == ("document_ocr", None) and of("vision", ocr=True)[2] == ("vision", None)
    with pytest.raises(ValueError):
        of("all")
    pages = spark.createDataFrame([(1, 1, None), (1, 2, "no text"), (2, 1, "no text")], "doc_id long, page int, why string")
    read = acquire.read_pages(pages, "auto", acquire.Providers(ocr=False, vision=True))
    assert sorted((r.doc_id, r.page, r.reading) for r in read.collect()) == [(1, 1, "text"), (1, 2, "vision"), (2, 1, "vision")]
    lost = {r.doc_id: (r.pages, r.error) for r in acquire.unread(acquire.read_pages(pages, "text", acquire.Providers(vision=False))).collect()}
    assert lost == {1: ([2], None), 2: ([1], "no_content")}
    assert {r.doc_id: r.second for r in acquire.second(acquire.primary(read), "both", acquire.Providers(ocr=True)).collect()} == {1: "vision", 2: "ocr"}


PLACED = [(1, [("Total", 10.0, 10.0, 50.0, 20.0, 0), ("two", 55.0, 10.0, 80.0, 20.0, 0), ("pages", 10.0, 30.0, 50.0, 40.0, 1)]), (2, [("End", 10.0, 10.0, 40.0, 20.0, 0)])]
MADE = mapping.normalise([(n, 600.0, 800.0, [mapping.Box(i, *w, 1.0) for i, w in enumerate(words)]) for n, words in PLACED])


def hit_fields(spark, replies):
    """Grounded fields price and count of replies over MADE's text, with their places."""
    texts = spark.createDataFrame([(k, MADE["text"], MADE["segments"], MADE["pages"]) for k in range(len(replies))], f"doc_id long, source string, segments array<{mapping.SEGMENT}>, pages array<struct<page:int,marker_start:int,body_start:int,end:int>>")
    plain = schema.Field("x", "", "object", fields=(schema.Field("word", "word", "string"), schema.Field("count", "count", "int", bits=32)))
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(replies)], "doc_id long, reply string")
    f = fields.convert(fields.walk(df, plain), values.country_codes(spark))
    return {(r.doc_id, r.key): r for r in evidence.hits(evidence.ground(f, texts.select("doc_id", "source", "pages")), texts).collect()}


def test_page_markers_are_not_the_document(spark):
    got = hit_fields(spark, [{"word": "page", "count": 2}, {"word": "pages End"}, {"word": "End"}])
    assert got[0, "word"].grounding == 0.0 and got[0, "count"].grounding == 0.0 and got[1, "word"].grounding == 0.0
    assert got[2, "word"].grounding == 1.0 and MADE["text"][got[2, "word"].at - 1 :].startswith("End")


def test_places_of_a_match(spark):
    got = hit_fields(spark, [{"word": "two\npages"}, {"word": "End"}, {"word": "none"}])
    two, end, none = (got[k, "word"] for k in range(3))
    assert two.page == 1 and [(r.line, tuple(r.box)) for r in two.regions] == [(0, (55, 10, 80, 20)), (1, (10, 30, 50, 40))] and tuple(two.box) == (10, 10, 80, 40)
    assert end.page == 2 and tuple(end.box) == (10, 10, 40, 20)
    assert none.page is None and none.regions is None and none.box is None


def test_rules_and_scorers_of_callers(spark):
    rows = [(1, "a", "a", 1.0), (1, "b", "b", 2.0), (2, "a", "a", 3.0), (2, "b", "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, key string, group_key string, v_num double").withColumns({"v_ts": F.lit(None).cast("timestamp"), "kind": F.lit("float"), "format": F.lit(""), "required": F.lit(False), "found": F.col("v_num").isNotNull(), "converted": F.col("v_num").isNotNull(), "valid": F.lit(True), "ambiguous": F.lit(None).cast("struct<d:date>"), "rules": F.array().cast("array<struct<rule:string,passed:boolean,message:string>>")})
    rule = evidence.CrossFunction("a above b", ("a", "b"), lambda value: value("a")["v_num"] > value("b")["v_num"], "a is not above b")
    checks = evidence.cross_check(df, [rule, evidence.CrossRule("sum", "sum", "b", ("a",), absolute=1.0)])
    assert {(r.doc_id, r.rule): (r.applicable, r.passed, r.message) for r in checks.collect()} == {(1, "a above b"): (True, False, "a is not above b"), (1, "sum"): (True, True, None), (2, "a above b"): (False, None, None), (2, "sum"): (False, None, None)}
    crossed = scoring.with_cross_fields(df, checks)
    got = {(r.doc_id, r.key): r for r in scoring.score(crossed).collect()}
    assert got[1, "a"].confidence == got[1, "b"].confidence == 0.8 and [s.name for s in got[1, "b"].signals] == ["schema", "crossfield", "crossfield"]  # (0.15 + 0 + 0.05) / 0.25
    assert got[1, "a"].reasons == ["cross-field rule failed: a above b"] and not got[1, "a"].valid and got[2, "a"].valid and got[2, "a"].confidence == 1.0
    half = scoring.score(crossed, lambda found, said: F.struct(F.when(found, 0.5).otherwise(0.0).alias("confidence"), F.transform(said, lambda s: s.withField("value", F.lit(0.5))).alias("signals")))
    own = {(r.doc_id, r.key): r for r in half.collect()}
    assert own[2, "a"].confidence == 0.5 and own[2, "a"].reasons == ["low confidence"] and own[1, "a"].confidence == 0.5  # (0.075 + 0.05) / 0.25
