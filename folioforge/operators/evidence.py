"""Evidence for fields: grounding in the source text, agreement of two readings, cross-field rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import dates, text, values
from folioforge.functions.expr import let
from folioforge.operators import mapping

# Signs that stand for a currency.
SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₦": "NGN", "₵": "GHS", "₹": "INR", "₽": "RUB", "₩": "KRW", "₪": "ILS", "₫": "VND", "₱": "PHP", "฿": "THB", "₺": "TRY", "₴": "UAH", "₸": "KZT", "R$": "BRL"}


def _sign_in(c: Column) -> Column:
    """The currency whose sign a text holds; NULL if none."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(k)), v) for k, v in sorted(SIGNS.items(), key=lambda kv: -len(kv[0]))])


def _code_in(c: Column) -> Column:
    """The currency that an amount's text names by code or sign; NULL if none."""
    return F.coalesce(F.nullif(F.regexp_extract(F.upper(c), r"(?<![A-Z])([A-Z]{3})(?![A-Z])", 1), F.lit("")), _sign_in(c))


MASK = "\ue000"  # stands for the characters of a page marker; no value holds it and no fold removes it


def without_markers(source: Column, pages: Column) -> Column:
    """The text with every character of the page markers masked, so that nothing matches in or across them; offsets stay."""
    return F.array_join(F.transform(pages, lambda p: F.concat(F.repeat(F.lit(MASK), p["body_start"] - p["marker_start"]), mapping.page_text(source, p))), "")


def ground(fields: DataFrame, sources: DataFrame, *, date_order: str = "", derivable: Column | None = None) -> DataFrame:
    """Adds grounding (1 verbatim, 0.8 normalised, 0.5 derivable, 0 not in the source, NULL where it does not apply), exact, at (1-based), size (characters of the exact match).

    sources: doc_id, source (normalised text), and pages where the text holds page markers, which are not the document: no
    value is found in them. A text is folded once, and its numbers and dates are read once, for all
    fields of a document. Amounts with a currency need the currency within 8 characters of the number. `derivable` holds for
    fields that may be computed from what is there; date_order (dmy or mdy) settles dates that could be read either way.
    """
    if "pages" in sources.columns:
        sources = sources.withColumn("source", F.when(F.size("pages") > 0, without_markers(F.col("source"), F.col("pages"))).otherwise(F.col("source")))
    prepared = sources.select("doc_id", "source", text.folded(F.col("source")).alias("_folded"), text.numbers_in(F.col("source")).alias("_numbers"))
    prepared = prepared.withColumn("_dates", F.flatten(dates.written_dates(F.col("_folded"), date_order)))
    numeric, timed, flag = F.col("v_num").isNotNull(), F.col("v_ts").isNotNull(), F.col("v_bool").isNotNull()
    money = (F.col("format") == "currency") & F.col("raw").rlike(r"\d")
    midnight = F.date_format("v_ts", "HH:mm:ss") == "00:00:00"
    plain = F.when(numeric, values.raw_text(F.col("v_num"), "double")).when(timed, F.when(midnight, F.date_format("v_ts", "yyyy-MM-dd")).otherwise(F.date_format("v_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).when(flag, F.col("v_bool").cast("string")).otherwise(F.col("raw"))
    joined = fields.join(prepared, "doc_id", "left").withColumn("_plain", plain)
    joined = joined.withColumn("at", F.when(numeric, F.lit(0)).otherwise(text.find_bounded(F.col("source"), F.col("_plain"))))
    literal = F.when(numeric, F.exists("_numbers", lambda n: n["t"] == F.col("_plain"))).otherwise(F.col("at") > 0)
    spoken = F.when(F.col("v_bool"), F.array(F.lit("true"), F.lit("yes"))).otherwise(F.array(F.lit("false"), F.lit("no")))
    same_number = lambda n, v: F.exists(n["v"], lambda x: text.nearly(x, v))
    near_code = lambda n, code: F.coalesce(F.contains(F.upper(F.concat(n["before"], F.lit(" "), n["after"])), code), F.lit(False)) | F.coalesce( _sign_in(n["before"]) == code, F.lit(False)) | F.coalesce(_sign_in(n["after"]) == code, F.lit(False))
    amount, code = values.parse_number(F.regexp_replace("raw", r"[^\d.,'\- ]", "")), _code_in(F.col("raw"))
    folded = (
        F.when(numeric, F.exists("_numbers", lambda n: same_number(n, F.col("v_num"))))
        .when(money, F.exists("_numbers", lambda n: same_number(n, amount) & (code.isNull() | near_code(n, code))))
        .when(timed, F.array_contains("_dates", F.date_format("v_ts", "yyyyMMdd").cast("int")))
        .when(flag, F.exists(spoken, lambda p: text.find_bounded(F.col("_folded"), p) > 0))
        .otherwise(text.find_bounded(F.col("_folded"), F.trim(text.folded(F.col("_plain")))) > 0)
    )
    applies = F.col("found") & ~F.col("kind").isin("object", "array") & ~values.blank(F.col("source"))
    lost = F.when(derivable, 0.5).otherwise(0.0) if derivable is not None else F.lit(0.0)
    out = joined.withColumn("grounding", F.when(applies, F.when(literal, 1.0).when(folded, 0.8).otherwise(lost)))
    out = out.withColumn("exact", F.col("grounding") == 1.0).withColumn("at", F.when(F.col("exact"), F.nullif(F.when(numeric, text.find_bounded(F.col("source"), F.col("_plain"))).otherwise(F.col("at")), F.lit(0))))
    return out.withColumn("size", F.when(F.col("at").isNotNull(), F.length("_plain"))).drop("_folded", "_numbers", "_dates", "_plain", "source")


def hits(grounded: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Adds page, regions and box of exact matches: the page of their first character, a box for each line they touch, and the box around those on that page.

    texts: doc_id, segments, pages, as normalise_words() gives them. Without a match, or without placed words, they are NULL
    or empty. A text's segments are joined to the fields of its document, never exploded. Without texts, grounded has segments and pages
    of its own rows, which a join with the same table would shuffle and sort once more; a row without a doc_id has no text in either case.
    """
    start = F.col("at") - 1
    if texts is None:
        placed = grounded.withColumns({k: F.when(F.col("doc_id").isNotNull(), F.col(k)) for k in ("segments", "pages")})
    else:
        placed = grounded.join(texts.select("doc_id", "segments", "pages"), "doc_id", "left")
    placed = placed.withColumn("regions", F.when(F.col("at").isNotNull(), mapping.regions_of(F.col("segments"), start, start + F.col("size"))))
    placed = placed.withColumn("page", F.when(F.col("at").isNotNull(), mapping.page_at(F.col("pages"), start)))
    own = F.filter("regions", lambda r: r["page"] == F.col("page"))
    side = lambda name, pick: pick(F.transform("_own", lambda r: r["box"][name])).alias(name)
    box = F.struct(side("minx", F.array_min), side("miny", F.array_min), side("maxx", F.array_max), side("maxy", F.array_max))
    return placed.withColumn("_own", own).withColumn("box", F.when(F.size("_own") > 0, box)).drop("_own", "segments", "pages")


def ground_arrays(grounded: DataFrame) -> DataFrame:
    """Fills grounding, exact and at of arrays from their elements: the mean of those that apply, exact if all are, the first one's place."""
    element = grounded.filter(F.col("key").rlike(r"\[\d+\]$") & F.col("grounding").isNotNull())
    number = F.regexp_extract("key", r"\[(\d+)\]$", 1).cast("int")
    sums = element.groupBy(F.col("doc_id").alias("_d"), F.regexp_replace("key", r"\[\d+\]$", "").alias("_k")).agg(
        F.avg("grounding").alias("_g"), F.bool_and("exact").alias("_e"), F.min_by("at", F.when(F.col("at").isNotNull(), number)).alias("_at")
    )
    whole = grounded.join(sums, (F.col("doc_id") == F.col("_d")) & (F.col("key") == F.col("_k")) & (F.col("kind") == "array"), "left")
    return whole.withColumns({"grounding": F.coalesce("grounding", "_g"), "exact": F.coalesce("exact", "_e"), "at": F.coalesce("at", "_at")}).drop("_d", "_k", "_g", "_e", "_at")


def same_value(a: Column, b: Column, kind: Column) -> Column:
    """Whether two readings' texts mean the same; NULL where either is absent.

    Numbers to nine digits, dates by any shared reading, money by amount and (if both name one) currency, booleans by
    meaning, all else folded text. What does not convert on both sides is compared as text.
    """
    of = lambda d: F.array_compact(F.array(d["value"], d["day_first"], d["month_first"]))
    at = lambda d: d["seconds"] - F.coalesce(d["zone_minutes"], F.lit(0)) * 60
    code = lambda c: F.nullif(F.regexp_extract(F.upper(c), r"(?<![A-Z])([A-Z]{3})(?![A-Z])", 1), F.lit(""))
    pair = lambda fn: F.struct(fn(a).alias("a"), fn(b).alias("b"))
    as_number = let(pair(values.parse_number), lambda p: text.nearly(p["a"], p["b"]))
    as_date = let(pair(dates.read_date), lambda p: F.when(p["a"].isNotNull() & p["b"].isNotNull(), F.arrays_overlap(of(p["a"]), of(p["b"])) & F.coalesce(at(p["a"]) == at(p["b"]), F.lit(True))))
    special = (
        F.when(kind.isin("int", "float"), as_number)
        .when(kind == "currency", as_number & F.coalesce(code(a) == code(b), F.lit(True)))
        .when(kind == "time", as_date)
        .when(kind == "bool", values.parse_bool(a) == values.parse_bool(b))
    )
    return F.when(~values.blank(a) & ~values.blank(b), F.coalesce(special, F.trim(text.folded(a)) == F.trim(text.folded(b))))


def agree(fields: DataFrame, second: DataFrame) -> DataFrame:
    """Adds agreement (1 or 0; NULL where either reading lacks the field) and candidates, by a left join on doc_id and key."""
    other = second.select("doc_id", "key", F.col("raw").alias("_other"))
    joined = fields.join(other, ["doc_id", "key"], "left")
    same = F.when(~F.col("kind").isin("object", "array"), same_value(F.col("raw"), F.col("_other"), F.col("kind")))
    return joined.withColumn("agreement", same.cast("double")).withColumn("candidates", F.when(~same, F.array("raw", "_other"))).drop("_other")


@dataclass(frozen=True)
class CrossRule:
    """name, and kind: sum (total = parts), items (total = sum of products of leaves), before (total is the earlier date)."""

    name: str
    kind: str
    total: str
    parts: tuple[str, ...]
    absolute: float = 0.01
    relative: float = 0.0

    @property
    def keys(self) -> tuple[str, ...]:
        """The fields that a verdict concerns: for items the total and the array."""
        return (self.total, *dict.fromkeys(p.split("[]")[0] for p in self.parts)) if self.kind == "items" else (self.total, *self.parts)


@dataclass(frozen=True)
class CrossFunction:
    """A rule of the caller's own: check(value) gets value(key), a struct of v_num and v_ts and of the other v_ columns and raw that the fields have, NULL
    where the field did not convert, and returns a boolean Column; NULL means that the rule does not apply."""

    name: str
    keys: tuple[str, ...]
    check: Callable[[Callable[[str], Column]], Column]
    message: str = ""


MESSAGES = {"sum": "the parts do not add up", "items": "the items do not add up", "before": "the dates are in the wrong order"}


def cross_check(fields: DataFrame, rules: list[CrossRule | CrossFunction]) -> DataFrame:
    """(doc_id, n, rule, keys, applicable, passed, message) for every document and rule, n counting rules, in one aggregation.

    A rule does not apply where a value it needs is missing, or where there are no items. Messages never state amounts.
    """
    num = lambda key: F.max(F.when(F.col("key") == key, F.col("v_num")))
    when = lambda key: F.max(F.when(F.col("key") == key, F.col("v_ts")))
    known = [c for c in fields.columns if c in ("v_num", "v_ts", "v_bool", "v_str", "v_int", "raw")]
    some = reduce(lambda x, y: x | y, [F.col(c).isNotNull() for c in known if c != "raw"], F.lit(False))
    value = lambda key: F.max(F.when((F.col("key") == key) & some, F.struct(*known)))
    made = []
    for n, r in enumerate(rules):
        if isinstance(r, CrossFunction):
            passed = r.check(value)
            applicable = passed.isNotNull()
        elif r.kind == "before":
            a, b = when(r.total), when(r.parts[0])
            applicable, passed = a.isNotNull() & b.isNotNull(), a <= b
        elif r.kind == "sum":
            parts = [num(p) for p in r.parts]
            applicable = reduce(lambda x, y: x & y, [p.isNotNull() for p in parts], num(r.total).isNotNull() & F.lit(bool(parts)))
            passed = values.within(num(r.total), reduce(lambda x, y: x + y, parts, F.lit(0.0)), r.absolute, r.relative)
        else:
            leaf = F.col("group_key").isin(*r.parts)
            item = F.regexp_extract("key", r"\[(\d+)\]", 1).cast("int")
            cells = F.collect_list(F.when(leaf, F.struct(item.alias("i"), F.col("v_num").alias("v"))))
            count = F.max(F.when(leaf, item)) + 1
            rows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.filter(cells, lambda c: c["i"] == i))
            whole = F.forall(rows, lambda x: (F.size(x) == len(r.parts)) & F.forall(x, lambda c: c["v"].isNotNull()))
            total = F.aggregate(rows, F.lit(0.0), lambda acc, x: acc + F.aggregate(x, F.lit(1.0), lambda p, c: p * c["v"]))
            applicable = num(r.total).isNotNull() & F.coalesce(count > 0, F.lit(False)) & F.coalesce(whole, F.lit(False))
            passed = values.within(num(r.total), total, r.absolute, r.relative)
        ok = F.coalesce(applicable, F.lit(False))
        said = r.message if isinstance(r, CrossFunction) else MESSAGES[r.kind]
        made.append(F.struct(F.lit(n).alias("n"), F.lit(r.name).alias("rule"), F.array(*[F.lit(k) for k in r.keys]).alias("keys"), ok.alias("applicable"), F.when(ok, passed).alias("passed"), F.when(ok & ~passed, F.lit(said)).alias("message")))
    return fields.groupBy("doc_id").agg(F.array(*made).alias("r")).select("doc_id", F.explode("r").alias("r")).select("doc_id", "r.*")
