"""Words to text, and findings of suspicious content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.functions.expr import let

FINDING_KINDS = ("zero-width", "bidi", "off-page", "background-colour", "instruction")
# Phrases that address a model; one strong phrase is a finding, or two weak ones.
STRONG = [
    "ignore previous", "ignore all previous", "ignore the previous", "ignore the above", "ignore any previous", "ignore prior", "ignore your", "ignore the schema", "disregard previous", "disregard the above", "disregard all",
    "disregard your", "forget previous", "forget everything", "previous instructions", "prior instructions", "above instructions", "new instructions", "system prompt", "you are an ai", "you are a language model", "as an ai",
    "<|im_start|>", "<|im_end|>", "[/inst]",
]
WEAK = ["you must", "do not ", "respond with", "output only", "return only", "instead of", "override", "instruction", "must be set", "set the value"]


def marker(page: Column) -> Column:
    return F.format_string("[page %d]\n", page)


def plain_text(words: DataFrame) -> DataFrame:
    """(doc_id, text): pages under their markers, lines by line hint, words by their order, one sort per document in the aggregate.

    A document's words meet in one task at once, so that its lines and pages are not dealt out again. For words whose lines are known. Hyphens at the end of a line join with the next line where letters stand on
    both sides; the hyphen goes if the next letter is small.
    """
    words = words.select("doc_id", "page", "line", "i", "text").repartition("doc_id")
    lines = words.groupBy("doc_id", "page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda w: w["text"]), " ").alias("t"))
    pages = lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("t"))
    joined = F.regexp_replace(F.regexp_replace(F.col("t"), r"(?<=\p{L})[-\x{2010}\x{2011}\x{2012}]\n(?=\p{Ll})|\x{ad}\n(?=\p{L})", ""), r"(?<=\p{L}[-\x{2010}\x{2011}\x{2012}])\n(?=\p{Lu})", "")
    body = F.concat(marker(F.col("page")), joined)
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", body.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def _finding(kind: str, **more: Column) -> list[Column]:
    columns = {"kind": F.lit(kind), "page": F.lit(None).cast("int"), "cp": F.lit(None).cast("int"), "meta_key": F.lit(None).cast("string"), "n": F.lit(1)} | more
    return [v.alias(k) for k, v in columns.items()]


def invisible_findings(docs: DataFrame) -> DataFrame:
    """One finding per document, kind and code point of invisible or direction-changing characters, counted."""
    marks = f"[{text.ZERO_WIDTH}{text.BIDI}]"
    each = docs.filter(F.col("text").rlike(marks)).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(marks), F.lit(0))).alias("ch"))
    kind = F.when(F.col("ch").isin(*text.BIDI), "bidi").otherwise("zero-width")
    return each.groupBy("doc_id", kind.alias("kind"), F.ascii("ch").alias("cp")).agg(F.count("*").cast("int").alias("n")).select("doc_id", "kind", F.lit(None).cast("int").alias("page"), "cp", F.lit(None).cast("string").alias("meta_key"), "n")


def off_page_findings(words: DataFrame, width: float, height: float) -> DataFrame:
    """Words wholly outside their page, counted per page with the box around them."""
    outside = (F.col("maxx") < 0) | (F.col("minx") > width) | (F.col("maxy") < 0) | (F.col("miny") > height)
    return words.filter(outside).groupBy("doc_id", "page").agg(F.count("*").cast("int").alias("n"), F.struct(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")).alias("box")).withColumn("kind", F.lit("off-page"))


def near_colour(a: Column, b: Column, most: float = 0.06) -> Column:
    """Every channel within `most`; NULL colours are unknown and match nothing."""
    return F.coalesce((F.abs(a["r"] - b["r"]) <= most) & (F.abs(a["g"] - b["g"]) <= most) & (F.abs(a["b"] - b["b"]) <= most), F.lit(False))


def instruction_findings(metadata: DataFrame) -> DataFrame:
    """Metadata values (doc_id, meta_key, value) that address a model, on folded text."""
    holds = lambda v, items: [F.contains(v, F.lit(p)) for p in items]
    weak = lambda v: reduce(lambda x, y: x + y, [h.cast("int") for h in holds(v, WEAK)])
    hit = let(F.trim(text.folded(F.col("value"))), lambda v: reduce(lambda x, y: x | y, holds(v, STRONG)) | (weak(v) >= 2))
    safe = F.substring(F.regexp_replace("meta_key", r"[^A-Za-z0-9_.\-]", ""), 1, 64)
    return metadata.filter(hit).select("doc_id", *_finding("instruction", meta_key=safe))


def why(kind: Column, page: Column, cp: Column, meta_key: Column, n: Column) -> Column:
    """A sentence for a finding: its kind and its code point, page, count or metadata field, never text of the document."""
    point, place = F.concat(F.lit("U+"), F.lpad(F.hex(cp), 4, "0")), F.concat(F.lit("page "), page.cast("string"))
    times = F.concat(F.lit(", "), n.cast("string"), F.lit(" times"))
    field = F.when(F.coalesce(meta_key, F.lit("")) != "", F.concat(F.lit(" field "), meta_key)).otherwise("")
    at = F.coalesce(F.concat(F.lit(" on "), place), F.lit(""))
    return (
        F.when(kind == "zero-width", F.concat(F.lit("character without width "), point, at, times))
        .when(kind == "bidi", F.concat(F.lit("character that changes the direction of text "), point, at, times))
        .when(kind == "off-page", F.concat(F.lit("text outside the page"), at, times))
        .when(kind == "background-colour", F.concat(F.lit("text in the colour of its background"), at, times))
        .when(kind == "instruction", F.concat(F.lit("metadata"), field, F.lit(" that addresses a model")))
        .otherwise("suspicious content")
    )


def background_findings(words: DataFrame, most: float = 0.06) -> DataFrame:
    """Words (doc_id, page, box, colour and background structs) in the colour of their background, counted per page with the box around them."""
    hidden = words.filter(near_colour(F.col("colour"), F.col("background"), most))
    box = F.struct(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    return hidden.groupBy("doc_id", "page").agg(F.count("*").cast("int").alias("n"), box.alias("box")).withColumn("kind", F.lit("background-colour"))


def merge_findings(findings: DataFrame) -> DataFrame:
    """One finding per document, kind, page, code point and metadata field: counts added, boxes united."""
    box = F.struct(*[(F.min if k.startswith("min") else F.max)(F.col(f"box.{k}")).alias(k) for k in ("minx", "miny", "maxx", "maxy")])
    return findings.groupBy("doc_id", "kind", "page", "cp", "meta_key").agg(F.sum("n").cast("int").alias("n"), F.when(F.count("box") > 0, box).alias("box"))


def suspicions(findings: DataFrame) -> DataFrame:
    """(doc_id, suspicious, suspicions): the distinct sentences of a document's findings, sorted."""
    said = findings.select("doc_id", why(F.col("kind"), F.col("page"), F.col("cp"), F.col("meta_key"), F.col("n")).alias("why"))
    return said.groupBy("doc_id").agg(F.lit(True).alias("suspicious"), F.array_sort(F.collect_set("why")).alias("suspicions"))
