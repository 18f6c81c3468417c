"""Typed values out of printed text, as Column expressions. A refused text gives NULL."""

from __future__ import annotations

from functools import reduce

from decimal import Decimal

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.expr import chain, let

# Active ISO 4217 codes.
CURRENCIES = (
    "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BOV BRL BSD BTN BWP BYN BZD CAD CDF CHE CHF CHW CLF CLP CNY COP COU CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP "
    "GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MXV MYR "
    "MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD USN UYI UYU "
    "UYW UZS VED VES VND VUV WST XAF XAG XAU XBA XBB XBC XBD XCD XCG XDR XOF XPD XPF XPT XSU XTS XUA XXX YER ZAR ZMW ZWG"
).split()
# Registered IBAN lengths by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 "
    "IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 "
    "SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()
GROUPED = r"\d+(?:(?:[.,]\d{2,3})*[.,]\d{3})?"
_SPACES = "\u00a0\u202f\u2009"


def country_codes(spark: SparkSession) -> list[str]:
    """ISO 3166-1 alpha-2 codes as the JVM knows them, and XK, which banks use for Kosovo."""
    return sorted({*spark.sparkContext._jvm.java.util.Locale.getISOCountries(), "XK"})


def blank(c: Column) -> Column:
    """Null, empty or white space only: not an answer. Zero and false are answers."""
    return c.isNull() | c.cast("string").rlike(r"^\s*$")


def _without_units(c: Column) -> Column:
    c = F.trim(F.regexp_replace(c, rf"[\p{{Sc}}{_SPACES}']", ""))
    c = F.trim(F.regexp_replace(c, r"^\p{L}{1,4}(?!\p{L})(?=.)", ""))
    return F.trim(F.regexp_replace(c, r"(?<=.)(?<!\p{L})\p{L}{1,4}$", ""))


def parse_number(c: Column) -> Column:
    """A double from a printed number: thousands separators, currency signs or short units, accounting negatives.

    With both separators the later is decimal. One separator, once, is decimal unless exactly three digits follow
    a first group other than a bare 0. Groups have three digits, or two where another separator follows.
    """

    def unbracketed(t: Column) -> Column:
        bracketed = t.rlike(r"(?s)^\(.*\)$")
        inner = F.when(bracketed, F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))).otherwise(t)
        return F.struct(bracketed.alias("minus"), _without_units(inner).alias("t"))

    def unsigned(x: Column) -> Column:
        t, signed, bare = x["t"], F.lit(False), x["t"]
        for sign in reversed(["-", "\u2212", "\u2013"]):
            before, after = t.startswith(sign), t.endswith(sign)
            signed = F.when(before | after, True).otherwise(signed)
            bare = F.when(before, F.substring(t, F.lit(2), F.length(t))).when(after, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(bare)
        digits = F.regexp_replace(_without_units(F.regexp_replace(F.trim(bare), r"^\+", "")), " ", "")
        return F.struct((x["minus"] != signed).alias("minus"), digits.alias("t"))

    def read(x: Column) -> Column:
        t = x["t"]
        marks = F.length(F.regexp_replace(t, r"[^.,]", ""))
        both = t.contains(",") & t.contains(".")
        decimal = both | ((marks == 1) & (~t.rlike(r"[.,].{3}$") | t.rlike(r"^0?[.,]")))
        head, tail = F.regexp_extract(t, r"^(.*)[.,][^.,]*$", 1), F.regexp_extract(t, r"[.,]([^.,]*)$", 1)
        fraction = t.rlike(rf"^(?:{GROUPED})?[.,]\d*$") & t.rlike(r"\d")
        plain = F.when(decimal & fraction, F.concat(F.lit("0"), F.regexp_replace(head, "[.,]", ""), F.lit("."), tail, F.lit("0"))).when(~decimal & t.rlike(rf"^{GROUPED}$"), F.regexp_replace(t, "[.,]", ""))
        return let(plain.cast("double"), lambda value: F.when(F.abs(value) < float("inf"), F.when(x["minus"], -value).otherwise(value)))

    return chain(F.regexp_replace(c, r"^\s+|\s+$", ""), unbracketed, unsigned, read)


def parse_bool(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "yes", "y", "checked"), True).when(t.isin("false", "no", "n", "unchecked"), False)


def whole_number(c: Column) -> Column:
    """A whole number of up to 38 digits, as a decimal, from plain digits or any printed number without a fraction; NULL for all else."""
    bare = F.trim(c)
    return F.when(bare.rlike(r"^[+-]?\d{1,38}$"), bare.cast("decimal(38,0)")).otherwise(let(parse_number(c), lambda n: F.when(n == F.floor(n), n.cast("decimal(38,0)"))))


def fits(n: Column, bits: Column, unsigned: Column) -> Column:
    """Whether a whole number has a place among the integers of that width."""
    power = lambda k: F.lit(Decimal(2) ** k).cast("decimal(38,0)")
    top = lambda less: F.when(bits == 8, power(8 - less)).when(bits == 16, power(16 - less)).when(bits == 32, power(32 - less)).otherwise(power(64 - less))
    return F.when(unsigned, (n >= 0) & (n < top(0))).otherwise((n >= -top(1)) & (n < top(1)))


def parse_integer(c: Column, bits: int = 64, unsigned: bool = False) -> Column:
    """A whole number that fits the width; fractions, overflow and, if unsigned, negatives are refused."""
    kind = "decimal(20,0)" if unsigned and bits == 64 else "bigint"
    return let(whole_number(c), lambda n: F.when(fits(n, F.lit(bits), F.lit(unsigned)), n.cast(kind)))


def normalise_currency(c: Column) -> Column:
    t = F.upper(F.trim(c))
    return F.when(t.isin(*CURRENCIES), t)


def normalise_uuid(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.trim(c), r"^\{(.*)\}$", "$1"), r"^(?i)urn:uuid:", "")
    t = F.lower(t)
    bare = F.when(t.rlike(r"^[0-9a-f]{32}$"), t).when(t.rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.regexp_replace(t, "-", ""))
    return F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def normalise_phone(c: Column) -> Column:
    """+digits for international numbers (+ or 00 in front), else digits; 7 to 15 of them."""
    t = F.trim(c)
    abroad = t.startswith("+") | (t.startswith("00") & (F.length(t) > 2))
    body = F.when(abroad, F.regexp_replace(F.regexp_replace(t, r"^(\+|00)", ""), r"\( ?0 ?\)", "")).otherwise(t)
    clean = F.regexp_replace(body, rf"[ \-().\/{_SPACES}\u2013\u2014\u2212]", "")
    return F.when(abroad & clean.rlike(r"^[1-9]\d{7,14}$"), F.concat(F.lit("+"), clean)).when(~abroad & clean.rlike(r"^\d{7,15}$"), clean)


def normalise_email(c: Column) -> Column:
    """The address of an RFC 5322 mailbox (plain or with a display name), lower-cased, with a deliverable domain."""
    t = F.trim(c)
    atom = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\-\x{80}-\x{10ffff}]+"
    address = F.when(t.rlike(rf"^{atom}(\.{atom})*@[^\s@<>]+$"), t).otherwise(F.regexp_extract(t, rf'^(?:"(?:[^"\\]|\\.)*"|[^<>"@,;:()\[\]\\]*)\s*<({atom}(?:\.{atom})*@[^\s@<>]+)>$', 1))
    domain = r"^[^@]{1,64}@(?=.{1,253}$)([A-Za-z0-9]([A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]([A-Za-z\-]{0,61}[A-Za-z])$"
    return F.when((F.octet_length(t) <= 1024) & (F.octet_length(address) <= 254) & address.rlike(domain), F.lower(address))


def _squashed(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[\s\-]", ""))


def mod97(digits: Column) -> Column:
    """Remainder by 97 of a decimal string of any length."""
    return F.aggregate(F.filter(F.split(digits, ""), lambda d: d != ""), F.lit(0), lambda acc, d: (acc * 10 + d.cast("int")) % 97)


def normalise_iban(c: Column) -> Column:
    """Upper case without spaces or hyphens, 15 to 34 long, of its country's length where one is registered, remainder 1."""
    t = _squashed(c)
    lengths = F.create_map(*[x for e in IBAN_LENGTHS for x in (F.lit(e[:2]), F.lit(int(e[2:])))])
    turned = F.concat(F.substring(t, F.lit(5), F.length(t)), F.substring(t, F.lit(1), F.lit(4)))
    digits = F.array_join(F.transform(F.split(turned, ""), lambda ch: F.when(ch.rlike("[A-Z]"), (F.ascii(ch) - 55).cast("string")).otherwise(ch)), "")
    right_length = F.coalesce(F.try_element_at(lengths, F.substring(t, 1, 2)) == F.length(t), F.lit(True))
    return F.when(t.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$") & right_length & (mod97(digits) == 1), t)


def normalise_swift(c: Column, countries: list[str]) -> Column:
    t = _squashed(c)
    return F.when(t.rlike(r"^[A-Z]{6}[A-Z2-9][A-NP-Z0-9]([A-Z0-9]{3})?$") & F.substring(t, 5, 2).isin(*countries), t)


def raw_text(c: Column, kind: str) -> Column:
    """What a value looks like before conversion: trimmed strings, plain decimal numbers, true or false; composites are empty."""
    if kind in ("double", "float"):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(F.regexp_replace(c.cast("decimal(38,15)").cast("string"), r"\.?0+$", ""))
    if kind in ("string", "boolean", "int", "bigint", "long"):
        return F.trim(c.cast("string"))
    return F.lit("")


def within(a: Column, b: Column, absolute: float = 0.01, relative: float = 0.0) -> Column:
    """Equal but for rounding: the difference is at most `absolute`, or at most `relative` of the larger."""
    distance, scale = F.abs(a - b), F.greatest(F.abs(a), F.abs(b))
    slack = scale * 1e-12
    close = distance <= absolute + slack
    return close | (distance <= scale * relative + slack) if relative > 0 else close
