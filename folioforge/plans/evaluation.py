"""Evaluation of extracted fields: judgements, tallies over grouping sets, calibration, risk and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.plans.joins import leaf_keys

BANDS = [("0.9-1.0", 0.9, 1.01), ("0.7-0.9", 0.7, 0.9), ("0.0-0.7", 0.0, 0.7)]


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


_VALUE = "struct<type:string,text:string>"


def flatten(expected: DataFrame, *, doc_col: str = "doc", json_col: str = "expected", depth: int = 6) -> DataFrame:
    """(doc, key, type, text): the leaves of JSON objects under keys such as a.b[0].c; nulls are absent, empty objects and arrays are leaves.

    type is string, number, bool, object or array, text the value as it is written (numbers keep their digits). Texts that are no
    JSON object give no rows; deeper nesting than `depth` stays as the JSON text of its container.
    """
    cell = "struct<key:string,type:string,text:string,v:variant>"
    made = lambda key, type_, text_, v: F.struct(key.alias("key"), type_.alias("type"), text_.alias("text"), v.alias("v")).cast(cell)
    null, key, v = F.lit(None).cast("string"), F.col("key"), F.col("v")
    kind = F.when(F.col("_s").startswith("OBJECT"), "object").when(F.col("_s").startswith("ARRAY"), "array").when(F.col("_s") == "STRING", "string").when(F.col("_s") == "BOOLEAN", "bool").otherwise("number")
    leaf = F.array(made(key, kind, F.when(F.col("_s") == "STRING", F.variant_get("v", "$", "string")).otherwise(F.col("_j")), F.lit(None).cast("variant")))
    nested = (F.col("_s").startswith("OBJECT") | F.col("_s").startswith("ARRAY")) & ~F.col("_j").isin("{}", "[]")
    within = lambda k: F.when(key == "", k).otherwise(F.concat(key, F.lit("."), k))
    members = F.transform(F.map_entries(F.from_json("_j", "map<string,variant>")), lambda e: made(within(e["key"]), null, null, e["value"]))
    items = F.transform(F.from_json("_j", "array<variant>"), lambda x, i: made(F.concat(key, F.lit("["), i.cast("string"), F.lit("]")), null, null, x))
    inner = F.filter(F.when(F.col("_s").startswith("OBJECT"), members).otherwise(items), lambda c: c["v"].isNotNull())
    root = expected.select(F.col(doc_col).alias("doc"), F.try_parse_json(F.col(json_col)).alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    level = root.select("doc", F.lit("").alias("key"), null.alias("type"), null.alias("text"), "v")
    for at in range(depth + 1):  # a row is a leaf, with its type, or a value that is still to be opened
        told = level.withColumn("_s", F.when(F.col("type").isNull(), F.schema_of_variant(v))).withColumn("_j", F.when(F.col("type").isNull(), F.to_json(v)))
        opened = F.when(nested, inner).when((F.col("_s") != "VOID") & (key != ""), leaf) if at < depth else F.when((F.col("_s") != "VOID") & (key != ""), leaf)
        after = F.when(F.col("type").isNotNull(), F.array(made(key, F.col("type"), F.col("text"), F.lit(None).cast("variant")))).otherwise(opened)
        level = told.select("doc", F.explode_outer(after).alias("c")).filter("c is not null").select("doc", "c.*")  # explode() would have them worked out once more, in a filter of its own
    return level.drop("v")


def same_typed(want: Column, got: Column, want_type: Column, got_type: Column) -> Column:
    """Whether an expected and a found value are equal, by type (string, number, bool, time, object, array): texts of values.

    Times are equal as instants where both sides are dates in an unambiguous form. Numbers are equal to nine digits, money
    texts in amount and currency, other texts folded; text is a number only beside a number, and never where it holds letters or a percent sign.
    """
    iso = lambda c: F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(c))
    plain = lambda c: F.when(~c.rlike(r"[\p{L}%]"), F.regexp_replace(F.regexp_replace(c, r"[ ,'’\x{a0}\x{2009}\x{202f}]", ""), r"[^\d.+\-]", "").try_cast("double"))
    code = lambda c: F.regexp_extract(c, r"^(?:([A-Z]{3})\s*)?[\d.,' ]+(?:\s*([A-Z]{3}))?$", 1)
    tail = lambda c: F.regexp_extract(c, r"^[\d.,' ]+\s*([A-Z]{3})$", 1)
    money = lambda c: F.nullif(F.concat(code(c), tail(c)), F.lit(""))
    amount = lambda c: plain(F.regexp_replace(c, "[A-Z]", ""))
    numeric = (want_type == "number") | (got_type == "number")
    near = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(1e-9), 1e-9 * F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(
        F.when(iso(want).isNotNull() | (got_type == "time"), iso(want) == iso(got))
        .when((want_type == "bool") | (got_type == "bool"), (want_type == got_type) & (want == got))
        .when(numeric, near(plain(want), plain(got)))
        .when(want_type.isin("object", "array") | got_type.isin("object", "array"), (want_type == got_type) & (want == got))
        .when(money(want).isNotNull(), (money(want) == money(got)) & (amount(want) == amount(got)))
        .otherwise(F.trim(text.folded(want)) == F.trim(text.folded(got))),
        F.lit(False),
    )


META = ("source", "licence", "redacted", "difficulty", "language")


def load(spark: SparkSession, root: str, categories: list[str]) -> DataFrame:
    """(category, name, source, licence, redacted, difficulty, language, pages, exclude, expected) of a corpus folder, one row per document.

    root/category/name.meta.yaml holds `key: value` lines, an `exclude` list in brackets or in lines behind dashes, and name.expected.json the
    expected values. Loading is strict: a document without ground truth, source, licence or difficulty raises when its row is read.
    """
    name = F.regexp_extract("path", r"([^/]+)\.(?:meta\.yaml|expected\.json)$", 1)
    category = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    files = lambda glob: spark.read.text([f"{root}/{c}" for c in categories], wholetext=True, pathGlobFilter=glob).withColumn("path", F.input_file_name()).select(category.alias("category"), name.alias("name"), "value")
    member = lambda k: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{k}:[ \t]*[\"']?([^\"'\n#]*)", 1)), F.lit(""))
    listed = F.regexp_extract("value", r"(?m)^exclude:[ \t]*\[(.*)\][ \t]*$", 1)
    lines = F.regexp_extract_all(F.regexp_extract("value", r"(?m)^exclude:[ \t]*\n((?:[ \t]*-[^\n]*\n?)*)", 1), F.lit(r"(?m)^[ \t]*-[ \t]*([^\n]+)$"), F.lit(1))
    exclude = F.filter(F.transform(F.concat(F.split(listed, ","), lines), lambda x: F.regexp_replace(F.trim(x), "[\"']", "")), lambda x: x != "")
    meta = files("*.meta.yaml").select("category", "name", *[member(k).alias(k) for k in META], member("pages").cast("int").alias("pages"), exclude.alias("exclude"))
    both = meta.join(files("*.expected.json").withColumnRenamed("value", "expected"), ["category", "name"], "full")
    lacks = F.filter(F.array(*[F.when(F.col(k).isNull(), k) for k in ("source", "licence", "difficulty", "expected")]), lambda x: x.isNotNull())
    checked = F.when(F.size(lacks) == 0, F.col("expected")).otherwise(F.raise_error(F.concat(F.col("category"), F.lit("/"), F.col("name"), F.lit(" lacks "), F.array_join(lacks, ", "))).cast("string"))
    return both.withColumn("expected", checked)


def without_excluded(judgements: DataFrame, corpus: DataFrame) -> DataFrame:
    """Judgements with `excluded` set for the keys that a document's metadata exclude (corpus: doc, exclude); report() drops and counts them."""
    named = corpus.select("doc", F.explode("exclude").alias("key")).distinct().withColumn("excluded", F.lit(True))
    return judgements.drop("excluded").join(named, ["doc", "key"], "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def observe(answers: DataFrame) -> DataFrame:
    """(doc, key, got, got_type, confidence, flagged): the leaf fields of answers (doc_id, fields), for judge(); got is NULL where none was found, flagged where the field itself has a reason for review."""
    each = answers.select(F.col("doc_id").alias("doc"), F.explode("fields").alias("key", "f"))
    kept = leaf_keys(each.select("doc", "key"))
    return each.join(kept, ["doc", "key"]).select("doc", "key", F.when(F.col("f.found"), F.col("f.raw")).alias("got"), F.lit("string").alias("got_type"), F.col("f.confidence").alias("confidence"), (F.size("f.reasons") > 0).alias("flagged"))


def render(report: DataFrame) -> DataFrame:
    """(line): a report as a Markdown table, its groups in order, with two decimals; a ratio without cases reads 0.00 (0/0)."""
    shown = lambda c, a, b: F.format_string("%.2f (%d/%d)", c, a, b)
    c = F.col
    right = c("correct") + c("wrong")
    cells = [F.coalesce(c(k), F.lit("all")) for k in ("category", "difficulty", "field")] + [
        shown(c("exact"), c("correct"), c("expected")), shown(c("precision"), c("correct"), c("produced")), shown(c("recall"), right, c("expected")), shown(c("fabrication"), c("fabricated"), c("absent")),
    ]
    return report.orderBy("level", "category", "difficulty", "field").select(F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |")).alias("line"))


def judge(expected: DataFrame, observed: DataFrame, same: Column | None = None) -> DataFrame:
    """Expected (doc, key, want) full-outer-joined with observed (doc, key, got, confidence, flagged): one row per leaf key.

    wanted: a value is expected; produced: one was given; correct: both and equal. `same` compares want and got.
    """
    joined = expected.join(observed, ["doc", "key"], "full")
    equal = same if same is not None else F.col("want") == F.col("got")
    wanted, produced = F.col("want").isNotNull(), F.col("got").isNotNull()
    return joined.select(
        "doc", "key", F.regexp_replace("key", r"\[[^\]]*\]", "[]").alias("field"), wanted.alias("wanted"), produced.alias("produced"), (wanted & produced & F.coalesce(equal, F.lit(False))).alias("correct"),
        F.coalesce("flagged", F.lit(False)).alias("flagged"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def tallies() -> list[Column]:
    w, p, c = F.col("wanted"), F.col("produced"), F.col("correct")
    return [
        F.count_if(w).alias("expected"), F.count_if(~w).alias("absent"), F.count_if(p).alias("produced"), F.count_if(c).alias("correct"), F.count_if(w & p & ~c).alias("wrong"), F.count_if(w & ~p).alias("missed"), F.count_if(~w & p).alias("fabricated"),
    ]


def with_metrics(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({"exact": ratio(c("correct"), c("expected")), "precision": ratio(c("correct"), c("produced")), "recall": ratio(c("correct") + c("wrong"), c("expected")), "fabrication": ratio(c("fabricated"), c("absent"))})


def report(judgements: DataFrame, category: str, difficulty: str) -> DataFrame:
    """Metrics overall, by category, by category and difficulty, by category and field, in one pass over the judgements."""
    cols = [F.col(category).alias("category"), F.col(difficulty).alias("difficulty"), "field", "wanted", "produced", "correct"]
    base = (judgements.filter("not excluded") if "excluded" in judgements.columns else judgements).select(*cols)
    grouped = base.groupingSets([[], ["category"], ["category", "difficulty"], ["category", "field"]], "category", "difficulty", "field").agg(F.grouping_id().cast("int").alias("level"), *tallies())
    return with_metrics(grouped)


def calibration(judgements: DataFrame) -> DataFrame:
    """(bin, n, accuracy, mean_confidence, gap) of produced values in ten equal bins; gap is the bin's share of the calibration error."""
    bins = judgements.filter("produced").groupBy(F.least(F.floor(F.col("confidence") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("confidence").alias("mean_confidence"))
    total = bins.agg(F.sum("n").alias("total"))
    return bins.join(F.broadcast(total)).select("bin", "n", "accuracy", "mean_confidence", (F.col("n") / F.col("total") * F.abs(F.col("accuracy") - F.col("mean_confidence"))).alias("gap"))  # ten rows and one


def bands(judgements: DataFrame) -> DataFrame:
    chosen = F.when(F.col("confidence") >= 0.9, BANDS[0][0]).when(F.col("confidence") >= 0.7, BANDS[1][0]).otherwise(BANDS[2][0])
    return judgements.filter("produced").groupBy(chosen.alias("band")).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def risk_curve(judgements: DataFrame, step: int = 5) -> DataFrame:
    """(threshold, coverage, error) for thresholds 0, 0.05 .. 1, from one histogram of confidences and a running sum over its 21 bins."""
    n = 100 // step
    slot = F.least(F.floor(F.col("confidence") * n + 1e-9), F.lit(n)).cast("int")
    counts = judgements.filter("produced").groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("bad"))
    grid = judgements.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("slot"))
    from pyspark.sql import Window

    up = Window.orderBy(F.desc("slot"))  # 21 rows
    summed = grid.join(counts, "slot", "left").select("slot", F.sum(F.coalesce("n", F.lit(0))).over(up).alias("kept"), F.sum(F.coalesce("bad", F.lit(0))).over(up).alias("bad"))
    whole = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return summed.select((F.col("slot") / n).alias("threshold"), ratio(F.col("kept"), F.max("kept").over(whole)).alias("coverage"), ratio(F.col("bad"), F.col("kept")).alias("error"))


def risk_at(curve: DataFrame, threshold: float) -> DataFrame:
    """The last point of the curve at or below a threshold."""
    return curve.filter(F.col("threshold") <= threshold + 1e-9).agg(F.max_by(F.struct("threshold", "coverage", "error"), "threshold").alias("p")).select("p.*")


def review_precision(judgements: DataFrame) -> DataFrame:
    """Share of flagged rows that deserved it: nothing produced, or wrong."""
    return judgements.agg(F.count_if("flagged").alias("flagged"), ratio(F.count_if(F.col("flagged") & (~F.col("produced") | ~F.col("correct"))), F.count_if("flagged")).alias("review_precision"))


def cost(events: DataFrame, in_price: float, out_price: float, page_price: float, by: str) -> DataFrame:
    """Per group: tokens, cost, cost a document, and the nearest-rank median and 95th percentile of the latency."""
    spent = F.sum(F.col("input_tokens") * in_price + F.col("output_tokens") * out_price + F.col("pages") * page_price)
    return events.groupBy(by).agg(F.count("*").alias("docs"), spent.alias("cost"), (spent / F.count("*")).alias("cost_per_doc"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency)").alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency)").alias("p95"))


def compare(baseline: DataFrame, current: DataFrame, on: str = "category", metrics: tuple = ("exact", "precision", "recall", "fabrication")) -> DataFrame:
    """(category, metric, before, after, change, better); lower is better for fabrication and ece."""
    a = baseline.select(on, *[F.col(m).alias(f"a_{m}") for m in metrics])
    b = current.select(on, *[F.col(m).alias(f"b_{m}") for m in metrics])
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias("before"), F.col(f"b_{m}").alias("after")) for m in metrics])
    long = a.join(b, on).select(on, F.explode(cells).alias("x")).select(on, "x.*").withColumn("change", F.col("after") - F.col("before"))
    return long.withColumn("better", F.when(F.col("metric").isin("fabrication", "ece"), F.col("change") < 0).otherwise(F.col("change") > 0))
