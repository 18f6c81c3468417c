"""Confidence of fields from signals, caps, review reasons, and the document's answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of signals, caps of the confidence, the review threshold.
WEIGHTS = {"grounding": 0.30, "agreement": 0.25, "ocr": 0.20, "schema": 0.15, "format": 0.05, "crossfield": 0.05}
CAPS = {"rule": 0.40, "grounding": 0.35, "agreement": 0.50, "suspicious": 0.60}
REVIEW_BELOW = 0.70
CROSS = "array<struct<rule:string,passed:boolean,message:string>>"
SIGNAL = "array<struct<name:string,value:double,weight:double,note:string>>"


def round2(c: Column) -> Column:
    """Half up to two places."""
    return F.floor(c * 100 + 0.5) / 100


def signals() -> Column:
    """Present signals of a field row, in order; an inapplicable signal is absent, never zero."""
    total, passed = F.size("rules"), F.size(F.filter("rules", lambda r: r["passed"]))
    formed = (F.col("format") != "") & F.lit(True)
    format_value = F.when(formed, F.when(F.col("ambiguous").isNotNull(), 0.5).when(F.col("converted"), 1.0).otherwise(0.0))
    parts = {"grounding": F.col("grounding"), "ocr": F.col("ocr_conf"), "schema": F.when(total > 0, passed / total).otherwise(1.0), "format": format_value, "agreement": F.col("agreement")}
    made = [F.struct(F.lit(k).alias("name"), v.cast("double").alias("value"), F.lit(WEIGHTS[k]).alias("weight"), F.lit(None).cast("string").alias("note")) for k, v in parts.items()]
    return F.filter(F.array(*made), lambda s: s["value"].isNotNull()).cast(SIGNAL)


def confidence(found: Column, present: Column) -> Column:
    """struct<confidence, signals>: the weighted mean under caps; a cap that binds adds a zero-weight signal. Not found: 0, none."""
    weight = F.aggregate(present, F.lit(0.0), lambda a, s: a + s["weight"])
    mean = F.when(weight > 0, F.aggregate(present, F.lit(0.0), lambda a, s: a + s["value"] * s["weight"]) / weight).otherwise(0.0)
    conditions = {
        "rule": F.exists("rules", lambda r: ~r["passed"]),
        "grounding": F.coalesce(F.col("grounding") == 0.0, F.lit(False)),
        "agreement": F.coalesce(F.col("agreement") == 0.0, F.lit(False)),
        "suspicious": F.coalesce(F.col("suspicious"), F.lit(False)),
    }
    value, bound = mean, []
    for name, holds in conditions.items():
        binds = holds & (value > CAPS[name])
        bound.append(F.when(binds, F.struct(F.lit(f"capped:{name}").alias("name"), F.lit(CAPS[name]).alias("value"), F.lit(0.0).alias("weight"), F.lit(None).cast("string").alias("note"))))
        value = F.when(binds, F.lit(CAPS[name])).otherwise(value)
    capped = F.concat(present, F.array_compact(F.array(*bound)).cast(SIGNAL))
    return F.struct(F.when(found, round2(value)).otherwise(0.0).alias("confidence"), F.when(found, capped).otherwise(F.array().cast(SIGNAL)).alias("signals"))


def rescored(said: Column) -> Column:
    """The confidence that signals account for: the weighted mean of the evidence under the least cap that bound; 0 without any."""
    evidence, caps = F.filter(said, lambda s: ~s["name"].startswith("capped:")), F.filter(said, lambda s: s["name"].startswith("capped:"))
    weight = F.aggregate(evidence, F.lit(0.0), lambda a, s: a + s["weight"])
    total = F.aggregate(evidence, F.lit(0.0), lambda a, s: a + s["value"] * s["weight"])
    limit = F.coalesce(F.array_min(F.transform(caps, lambda s: s["value"])), F.lit(1.0))
    return F.when(weight > 0, round2(F.least(total / weight, limit))).otherwise(0.0)


def score(fields: DataFrame, scorer: Callable[[Column, Column], Column] = confidence) -> DataFrame:
    """Adds confidence, signals and reasons to evidence rows; columns that are missing count as inapplicable.

    `scorer` takes found and the signals that apply, may name any other column of the row, and returns struct<confidence,
    signals>; its signals must account for its score. What cross-field rules say of a field is added to them afterwards, a
    signal each, and the confidence worked out anew; the reason of a low confidence goes by the one before.
    """
    wanted = {"grounding": "double", "agreement": "double", "ocr_conf": "double", "cross": CROSS, "suspicious": "boolean", "suspicions": "array<string>"}
    for name, kind in wanted.items():
        if name not in fields.columns:
            fields = fields.withColumn(name, F.lit(None).cast(kind))
    scored = fields.withColumn("_p", signals()).withColumn("_s", scorer(F.col("found"), F.col("_p")))
    composite = F.col("kind").isin("object", "array")
    base = F.when(composite, F.when(F.col("found"), 1.0).otherwise(0.0)).otherwise(F.col("_s.confidence"))
    crossed = F.transform("cross", lambda c: F.struct(F.lit("crossfield").alias("name"), c["passed"].cast("double").alias("value"), F.lit(WEIGHTS["crossfield"]).alias("weight"), F.when(c["passed"], "consistent with other fields").otherwise(c["message"]).alias("note"))).cast(SIGNAL)
    out = scored.withColumn("_b", base).withColumn("signals", F.concat("_s.signals", F.coalesce(crossed, F.array().cast(SIGNAL))))
    out = out.withColumn("confidence", F.when(F.size("cross") > 0, rescored(F.col("signals"))).otherwise(F.col("_b")))
    missing = F.col("required") & ~F.col("found")
    reasons = F.array(
        F.when(missing, "required field missing").when(F.col("found") & (F.col("grounding") == 0.0), "value not in source"),
        F.when(F.col("agreement") == 0.0, "readings disagree"),
        F.when(F.col("ambiguous").isNotNull(), "ambiguous date"),
        F.when(F.col("found") & (F.col("_b") < REVIEW_BELOW), "low confidence"),
    )
    said = F.when(~composite & F.col("suspicious"), F.coalesce(F.col("suspicions"), F.array(F.lit("suspicious content")))).otherwise(F.array().cast("array<string>"))
    failed = F.transform(F.filter("cross", lambda c: ~c["passed"]), lambda c: F.concat(F.lit("cross-field rule failed: "), c["rule"]))
    out = out.withColumn("reasons", F.concat(F.array_compact(reasons), said, F.coalesce(failed, F.array().cast("array<string>"))))
    return out.drop("_p", "_s", "_b", "suspicions")


def with_cross_fields(fields: DataFrame, checks: DataFrame) -> DataFrame:
    """Adds cross, the verdicts (rule, passed, message) of the applicable rules that concern a field, in the order of the rules; a failure makes it invalid."""
    named = checks.filter("applicable").select("doc_id", F.explode("keys").alias("key"), F.struct("n", "rule", "passed", "message").alias("c"))
    said = named.groupBy("doc_id", "key").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: F.struct(c["rule"].alias("rule"), c["passed"].alias("passed"), c["message"].alias("message"))).alias("cross"))
    return fields.join(said, ["doc_id", "key"], "left").withColumn("valid", F.col("valid") & F.coalesce(F.forall("cross", lambda c: c["passed"]), F.lit(True)))


def answer(fields: DataFrame, threshold: float = REVIEW_BELOW) -> DataFrame:
    """One row per document: valid, confidence (required fields count once, optional ones half), needs_review, reasons (field, why), fields."""
    scalar = ~F.col("kind").isin("object", "array")
    weight = F.when(scalar, F.when(F.col("required"), 1.0).otherwise(0.5)).otherwise(0.0)
    picked = F.struct("key", "raw", "found", "confidence", "valid", "signals", "reasons")
    out = fields.groupBy("doc_id").agg(
        F.bool_and("valid").alias("valid"),
        F.sum(F.col("confidence") * weight).alias("_c"),
        F.sum(weight).alias("_w"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("reasons", lambda r: F.struct(F.col("key").alias("field"), r.alias("why"))))))).alias("reasons"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", picked.alias("value"))), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))).alias("fields"),
    )
    out = out.withColumn("confidence", F.when(F.col("_w") > 0, round2(F.col("_c") / F.col("_w"))).otherwise(0.0)).drop("_c", "_w")
    return out.withColumn("needs_review", (F.size("reasons") > 0) | ~F.col("valid") | (F.col("confidence") < threshold))


def explain(answers: DataFrame, key: str) -> DataFrame:
    """(doc_id, explanation): one field's value, confidence, signals and reasons as text."""
    f = F.col("fields")[key]
    lines = F.transform(f["signals"], lambda s: F.format_string("  %s %.2f x %.2f", s["name"], s["value"], s["weight"]))
    head = F.format_string("%s: %s (confidence %.2f, %s)", F.lit(key), F.coalesce(f["raw"], F.lit("not found")), f["confidence"], F.when(f["valid"], "valid").otherwise("invalid"))
    reasons = F.transform(f["reasons"], lambda r: F.concat(F.lit("  review: "), r))
    return answers.select("doc_id", F.array_join(F.concat(F.array(head), lines, reasons), "\n").alias("explanation"))

