"""Conversions and formats against tables of inputs and results."""

import datetime

import pytest
from pyspark.sql import functions as F

from folioforge.functions import dates, text, values

NUMBERS = {
    "25,000": 25000.0, "1.234.567,89": 1234567.89, "1234,56": 1234.56, "25'000": 25000.0, "25\u00a0000": 25000.0, "25\u2009000": 25000.0, "1.234,56 €": 1234.56, "₹1,00,000.00": 100000.0, "UGX 1,200,000": 1200000.0,
    "1 200 000 UGX": 1200000.0, "-1,234.56": -1234.56, "1,234.56-": -1234.56, "(1,234.56)": -1234.56, "($1,234.56)": -1234.56, "0.500": 0.5, ".5": 0.5, "1.2345": 1.2345, "1.5 kg": 1.5, "1.234": 1234.0, "7": 7.0, "+7": 7.0,
    "": None, "twenty five thousand": None, "50%": None, "NIL": None, "1,2,3": None, "1.2.3.4,5,6": None, ",": None, "1e5": None, "10-20": None, "−5": -5.0, "EUR": None,
}
D = datetime.date(2026, 4, 3)
DATES = dict.fromkeys(["2026-04-03", "2026/04/03", "2026.04.03", "20260403", "2026-04-03T14:30:00Z", "3 April 2026", "April 3, 2026", "3 Apr. 2026", "3rd April 2026", "3 April 26", "2026 3 April"], D)
DATES |= dict.fromkeys(["31/02/2026", "2026-13-01", "25/26/2026", "00/04/2026", "April 2026", "2026", "12345", "1/2/3/4", "3 Aprol 2026", "14:30", ""], None)
DATES |= {"25/04/2026": datetime.date(2026, 4, 25), "04/25/26": datetime.date(2026, 4, 25), "5/5/1999": datetime.date(1999, 5, 5), "1 jan 70": datetime.date(1970, 1, 1), "1 Sept 68": datetime.date(2068, 9, 1)}
FORMATS = [
    ("email", "Amina Nakato <a@Example.com>", "a@example.com"), ("email", "a@mail.example.co.ug", "a@mail.example.co.ug"), ("email", "a@localhost", None), ("email", "a@b.c1", None), ("email", "a b@c.de", None),
    ("phone", "+256 (0) 41 4234567", "+256414234567"), ("phone", "00256414234567", "+256414234567"), ("phone", "(0771) 234-567", "0771234567"), ("phone", "123", None), ("phone", "+0771234567", None),
    ("iban", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"), ("iban", "gb82-west-1234-5698-7654-32", "GB82WEST12345698765432"), ("iban", "GB82WEST12345698765431", None), ("iban", "GB82WEST1234569876543", None),
    ("swift", "DEUTDEFF", "DEUTDEFF"), ("swift", "deutdeff", "DEUTDEFF"), ("swift", "DEUT DE FF", "DEUTDEFF"), ("swift", "CITIUS33", "CITIUS33"), ("swift", "DEUTZZFF", None), ("swift", "DEUTDE1F", None),
    ("uuid", "{6BA7B810-9DAD-11D1-80B4-00C04FD430C8}", "6ba7b810-9dad-11d1-80b4-00c04fd430c8"), ("uuid", "urn:uuid:6ba7b8109dad11d180b400c04fd430c8", "6ba7b810-9dad-11d1-80b4-00c04fd430c8"), ("uuid", "6ba7", None),
    ("currency", " ugx ", "UGX"), ("currency", "ABC", None),
]
CANONICAL = {"oﬃce": "office", "Ĳ": "IJ", "a\u00a0b\u3000c": "a b c", "a  \t\n  b": "a b", "  x": " x", "１２，３": "12,3", "m²": "m2", "½": "1⁄2", "Ⅳ": "IV", "①": "1", "™": "TM", "𝐀𝐛": "Ab", "a\u200bb": "a\u200bb", "漢字": "漢字", "ｶ": "ｶ"}


def each(spark, cases, fn):
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    return {r.t: r.v for r in df.select("t", fn(F.col("t")).alias("v")).collect()}


def test_numbers(spark):
    assert each(spark, NUMBERS, values.parse_number) == NUMBERS


def test_dates(spark):
    assert each(spark, DATES, lambda c: dates.read_date(c)["value"]) == DATES


@pytest.mark.parametrize("order", ["", "ymd", "dmy", "mdy"])
def test_ambiguous_dates(spark, order):
    for t, r in each(spark, ["03/04/2026", "03-04-2026", "03.04.2026", "03/04/26", "3/4/2026"], lambda c: dates.read_date(c, order)).items():
        day, month = datetime.date(2026, 4, 3), datetime.date(2026, 3, 4)
        want = (None, True, day, month) if order in ("", "ymd") else (day if order == "dmy" else month, False, None, None)
        assert (r.value, r.ambiguous, r.day_first, r.month_first) == want, t


def test_clocks(spark):
    cases = {"2026-04-03T14:30:00Z": "2026-04-03 14:30:00", "3 April 2026 2:05 pm": "2026-04-03 14:05:00", "2026-04-03 14:30:00+03:00": "2026-04-03 11:30:00", "2026-04-03 25:00": None, "2026-04-03": "2026-04-03 00:00:00"}
    assert each(spark, cases, lambda c: dates.read_timestamp(c).cast("string")) == cases


def test_formats(spark):
    fns = {"email": values.normalise_email, "phone": values.normalise_phone, "iban": values.normalise_iban, "uuid": values.normalise_uuid, "currency": values.normalise_currency}
    fns["swift"] = lambda c: values.normalise_swift(c, values.country_codes(spark))
    for kind, fn in fns.items():
        cases = {t: v for k, t, v in FORMATS if k == kind}
        assert each(spark, cases, fn) == cases


def test_canonical(spark):
    assert each(spark, CANONICAL, text.canonical) == CANONICAL
    assert each(spark, list(CANONICAL.values()), text.canonical) == {v: v for v in CANONICAL.values()}


def test_bounded_search(spark):
    df = spark.createDataFrame([("Smithson Smith", "Smith", 10), ("a Acme (Ltd) b", "Acme (Ltd)", 3), ("xAcme", "Acme", 0), ("x", "", 0)], "t string, v string, want int")
    assert all(r.got == r.want for r in df.select("want", text.find_bounded(F.col("t"), F.col("v")).alias("got")).collect())


def test_number_tokens(spark):
    got = each(spark, ["pay 1 234,50 or 1.234 now", "A4 x_5 7", "12 -3"], lambda c: F.transform(text.number_tokens(c), text.number_readings))
    assert got["pay 1 234,50 or 1.234 now"] == [[1234.5], [1.234, 1234.0]] and got["A4 x_5 7"] == [[7.0]] and got["12 -3"] == [[12.0], [-3.0]]


def test_marks_compose(spark):
    cases = {"é": "é", "École": "École", "ấ": "ấ", "x́y": "x́y", "q̣̇": "q̣̇", "́a": "́a", "ﬁñ": "fiñ", "𝐀è": "Aè"}
    assert each(spark, cases, text.canonical) == cases


def test_bounded_search_of_overlaps(spark):
    rows = [("xa a a", "a a", 4), ("abab ab", "ab", 6), ("-- a --", "--", 1), ("a.b a.b", "a.b", 1), ("aaa aa", "aa", 5), (" ab", "ab", 3), ("éa a", "a", 4), ("total 1,234.56", "234", 9)]
    df = spark.createDataFrame(rows, "t string, v string, want int")
    assert [(r.t, r.got) for r in df.select("t", "want", text.find_bounded(F.col("t"), F.col("v")).alias("got")).collect()] == [(t, w) for t, _, w in rows]


def test_written_dates(spark):
    cases = {
        "on 3rd march 2026.": [20260303], "march 3, 2026": [20260303], "the third of march 2026": [20260303], "3-3-26": [20260303, 20260303], "2026/03/04": [20260304], "04/03/2026 and 1 jan 70": [20260304, 20260403, 19700101],
        "twenty-first of may 68": [20680521], "x3 march 2026": [], "12345-1-2": [], "2026-03/04": [],
    }
    got = each(spark, cases, lambda c: F.flatten(dates.written_dates(c)))
    assert got == cases
    assert each(spark, ["04/03/2026"], lambda c: F.flatten(dates.written_dates(c, "dmy"))) == {"04/03/2026": [20260304]}


def test_integer_widths(spark):
    cases = {"127": 127, "128": None, "-128": -128, "-129": None, "1.5": None}
    assert each(spark, cases, lambda c: values.parse_integer(c, 8)) == cases
    wide = {"9007199254740993": 9007199254740993, "9223372036854775807": 2**63 - 1, "9223372036854775808": None, "-9223372036854775808": -(2**63)}
    assert each(spark, wide, values.parse_integer) == wide
    assert each(spark, {"255": 1, "256": 1, "-1": 1}, lambda c: values.parse_integer(c, 8, True)) == {"255": 255, "256": None, "-1": None}
