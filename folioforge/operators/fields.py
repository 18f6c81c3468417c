"""Replies to typed, validated fields: the schema left-joined to a JSON reply, all in one row's expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import dates, values
from folioforge.operators.schema import Field, key_of

CELL = "struct<key:string,group_key:string,kind:string,format:string,required:boolean,bits:int,unsigned:boolean,raw:string>"


def _member(object_: Column, name: str) -> Column:
    """A member of a map<string,string>: by exact name, else the first whose name differs only in case."""
    loose = F.map_values(F.map_filter(object_, lambda k, _: F.lower(k) == name.lower()))
    return F.coalesce(F.try_element_at(object_, F.lit(name)), F.get(loose, F.lit(0)))


def _cell(f: Field, key: Column, raw: Column) -> Column:
    return F.struct(key.alias("key"), F.lit(f.key).alias("group_key"), F.lit(f.kind).alias("kind"), F.lit(f.format).alias("format"), F.lit(f.required).alias("required"), F.lit(f.bits).alias("bits"), F.lit(f.unsigned).alias("unsigned"), raw.alias("raw")).cast(CELL)


def _walk(f: Field, key: Column, raw: Column) -> Column:
    """array<cell> of a field whose JSON text is `raw`; an absent field still has its scalar cells."""
    if f.kind == "object":
        members = F.from_json(raw, "map<string,string>")
        parts = [_walk(m, F.concat(key, F.lit("." + key_of(m.name))) if f.key else F.lit(key_of(m.name)), _member(members, key_of(m.name))) for m in f.fields]
        own = [F.array(_cell(f, key, raw))] if f.key else []
        return F.concat(*own, *parts)
    if f.kind == "array":
        items = F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
        each = F.flatten(F.transform(items, lambda x, i: _walk(f.elem, F.concat(key, F.lit("["), i.cast("string"), F.lit("]")), x)))
        return F.concat(F.array(_cell(f, key, raw)), each)
    return F.array(_cell(f, key, raw))


def walk(replies: DataFrame, schema: Field, *, id_col: str = "doc_id", reply_col: str = "reply") -> DataFrame:
    """One row per schema field, array element and object of every reply: doc_id, key, group_key, kind, format, required, bits, unsigned, raw, found.

    A reply that is not a JSON object leaves every field not found. Null, missing and blank values are not found;
    false, 0 and empty arrays are.
    """
    cells = _walk(schema, F.lit(""), F.col(reply_col))
    long = replies.select(F.col(id_col).alias("doc_id"), F.explode(cells).alias("c")).select("doc_id", "c.*")
    return long.withColumn("raw", F.when(F.col("kind").isin("object", "array"), F.col("raw")).otherwise(F.trim("raw"))).withColumn("found", ~values.blank(F.col("raw")))


def convert(fields: DataFrame, countries: list[str], date_order: str = "") -> DataFrame:
    """Adds v_str, v_int (exact), v_num, v_bool, v_ts, converted and ambiguous (day_first, month_first) to walked fields."""
    raw, kind, form = F.col("raw"), F.col("kind"), F.col("format")
    timed = (kind == "time") | form.isin("date", "datetime")
    read = fields.withColumns({"_date": F.when(timed, dates.read_date(raw, date_order)), "_number": F.when(kind == "float", values.parse_number(raw)), "_whole": F.when(kind == "int", values.whole_number(raw))})
    date, number = F.col("_date"), F.col("_number")
    text = (
        F.when(form == "email", values.normalise_email(raw)).when(form == "phone", values.normalise_phone(raw)).when(form == "currency", values.normalise_currency(raw))
        .when(form == "iban", values.normalise_iban(raw)).when(form == "swift", values.normalise_swift(raw, countries)).when(form == "uuid", values.normalise_uuid(raw))
        .when(form == "date", date["value"].cast("string")).when(form == "datetime", dates.instant(date).cast("string")).otherwise(raw)
    )
    whole = F.when((kind == "int") & values.fits(F.col("_whole"), F.col("bits"), F.col("unsigned")), F.col("_whole").cast("decimal(20,0)"))
    out = read.withColumns(
        {
            "v_str": F.when(kind == "string", text),
            "v_int": whole,
            "v_num": F.when(kind == "int", whole.cast("double")).otherwise(number),
            "v_bool": F.when(kind == "bool", values.parse_bool(raw)),
            "v_ts": dates.instant(date),
            "ambiguous": F.when(date["ambiguous"], F.struct(date["day_first"].alias("day_first"), date["month_first"].alias("month_first"))),
        }
    ).drop("_date", "_number", "_whole")
    answered = F.coalesce(F.col("v_str").isNotNull(), F.lit(False)) | F.col("v_num").isNotNull() | F.col("v_bool").isNotNull() | ((kind == "time") & F.col("v_ts").isNotNull())
    return out.withColumn("converted", F.col("found") & (answered | kind.isin("object", "array")))


def _rule(name: str, arg: str, passed: Column, message: Column) -> Column:
    return F.struct(F.lit(f"{name}={arg}" if arg else name).alias("rule"), passed.alias("passed"), F.when(~passed, message).alias("message"))


def _rules(f: Field) -> Column:
    found, converted = F.col("found"), F.col("converted")
    made = []
    for r in f.rules:
        if r.name == "required":
            made.append(_rule(r.name, "", found, F.lit("the field is required and was not found")))
        elif r.name == "format":
            made.append(_rule(r.name, r.arg, ~found | converted, F.lit(f"not a valid {r.arg}")))
        elif r.name == "enum":
            made.append(_rule(r.name, r.arg, ~found | F.col("raw").isin(*r.arg.split("|")), F.lit("not one of the allowed values")))
        else:
            size = F.char_length(F.coalesce("v_str", "raw")).cast("double") if f.kind == "string" else F.coalesce(F.size(F.from_json("raw", "array<string>")), F.lit(0)).cast("double") if f.kind == "array" else F.col("v_num")
            holds = size >= float(r.arg) if r.name == "min" else size <= float(r.arg)
            made.append(_rule(r.name, r.arg, ~found | F.coalesce(holds, F.lit(False)), F.when(size.isNull(), "not evaluated: the value was not converted").otherwise(F.lit(f"outside {r.name}={r.arg}"))))
    return F.array(*made) if made else F.array().cast("array<struct<rule:string,passed:boolean,message:string>>")


def validate(fields: DataFrame, schema: Field) -> DataFrame:
    """Adds rules array<struct<rule,passed,message>> in tag order, and valid: all passed, and converted if found."""

    def all_fields(f: Field) -> list[Field]:
        return [f, *[x for m in f.fields for x in all_fields(m)], *(all_fields(f.elem) if f.elem else [])]

    none = F.array().cast("array<struct<rule:string,passed:boolean,message:string>>")
    chosen = reduce(lambda rest, f: F.when(F.col("group_key") == f.key, _rules(f)).otherwise(rest), [f for f in all_fields(schema) if f.rules], none)
    return fields.withColumn("rules", chosen).withColumn("valid", F.forall("rules", lambda r: r["passed"]) & (~F.col("found") | F.col("converted")))
