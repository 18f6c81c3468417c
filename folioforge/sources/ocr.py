"""Replies of OCR services to words, as Spark expressions over their JSON, and hOCR pages."""

from __future__ import annotations

import html.parser
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.layout import reading_order
from folioforge.operators.providers import ProviderError

TEXTRACT = "struct<Blocks:array<struct<Id:string,BlockType:string,Text:string,Confidence:double,Page:int,Geometry:struct<BoundingBox:struct<Left:double,Top:double,Width:double,Height:double>>,Relationships:array<struct<Type:string,Ids:array<string>>>>>>"
VERTICES = "struct<vertices:array<struct<x:double,y:double>>,normalizedVertices:array<struct<x:double,y:double>>>"
BREAK = "struct<detectedBreak:struct<type:string>>"
GOOGLE = f"struct<pages:array<struct<width:double,height:double,confidence:double,blocks:array<struct<paragraphs:array<struct<words:array<struct<confidence:double,boundingBox:{VERTICES},property:{BREAK},symbols:array<struct<text:string,property:{BREAK}>>>>>>>>>>>"
AZURE = "struct<pages:array<struct<pageNumber:int,unit:string,width:double,height:double,words:array<struct<content:string,confidence:double,polygon:array<double>,span:struct<offset:int,length:int>>>,lines:array<struct<content:string,polygon:array<double>,spans:array<struct<offset:int,length:int>>>>>>>"


def textract_words(replies: DataFrame, width: float, height: float) -> DataFrame:
    """Words of (doc_id, reply): lines claim words through their CHILD ids; words that no line claims are lines of their own."""
    blocks = replies.select("doc_id", F.inline(F.from_json("reply", TEXTRACT)["Blocks"]))
    box = F.col("Geometry.BoundingBox")
    words = blocks.filter("BlockType = 'WORD'").select(
        "doc_id", "Id", F.coalesce("Page", F.lit(1)).alias("page"), F.col("Text").alias("text"), (F.col("Confidence") / 100).alias("conf"),
        (box["Left"] * width).alias("minx"), (box["Top"] * height).alias("miny"), ((box["Left"] + box["Width"]) * width).alias("maxx"), ((box["Top"] + box["Height"]) * height).alias("maxy"),
    )
    lines = blocks.filter("BlockType = 'LINE'").select("doc_id", F.col("Id").alias("line_id"), box["Top"].alias("top"), F.explode("Relationships").alias("r")).filter("r.Type = 'CHILD'").select("doc_id", "line_id", "top", F.explode("r.Ids").alias("Id"))
    claimed = words.join(lines, ["doc_id", "Id"])
    alone = words.join(lines, ["doc_id", "Id"], "left_anti").withColumns({"line_id": F.col("Id"), "top": F.col("miny") / height})
    both = claimed.select(*alone.columns).unionByName(alone)
    numbered = both.withColumn("line", F.dense_rank().over(Window.partitionBy("doc_id", "page").orderBy("top", "line_id")).cast("int"))
    return reading_order(numbered.drop("top", "line_id"), height, "Id")


LINE_END = ("LINE_BREAK", "EOL_SURE_SPACE")  # fixed values: kinds of breaks that end a line


def google_words(replies: DataFrame, dpi: float = 300.0) -> DataFrame:
    """Words of (doc_id, reply) with a fullTextAnnotation: boxes from pixels or shares of the page, in points; a missing confidence is the page's.

    A line ends at a word with a break of LINE_END, and at the end of a paragraph; `joined` words run into the next one without a
    space; `order` counts a page's words by line and, within it, from the left.
    Words without text are left out.
    """
    pages = replies.select("doc_id", F.posexplode(F.from_json("reply", GOOGLE)["pages"]).alias("p", "pg"))
    words = pages.select("doc_id", (F.col("p") + 1).alias("page"), "pg.width", "pg.height", F.col("pg.confidence").alias("_c"), F.posexplode("pg.blocks").alias("b", "block"))
    words = words.select("*", F.posexplode("block.paragraphs").alias("g", "par")).select("*", F.posexplode("par.words").alias("w", "word"))
    scale = 72.0 / dpi
    shares = F.size(F.coalesce("word.boundingBox.normalizedVertices", F.array())) > 0
    xs = F.when(shares, F.transform("word.boundingBox.normalizedVertices", lambda v: F.coalesce(v["x"], F.lit(0.0)) * F.col("width"))).otherwise(F.transform("word.boundingBox.vertices", lambda v: F.coalesce(v["x"], F.lit(0.0))))
    ys = F.when(shares, F.transform("word.boundingBox.normalizedVertices", lambda v: F.coalesce(v["y"], F.lit(0.0)) * F.col("height"))).otherwise(F.transform("word.boundingBox.vertices", lambda v: F.coalesce(v["y"], F.lit(0.0))))
    stop = F.coalesce(F.element_at(F.transform(F.concat(F.array(F.lit(None).cast(BREAK)), F.coalesce("word.symbols.property", F.array().cast(f"array<{BREAK}>"))), lambda p: p["detectedBreak"]["type"]), -1), "word.property.detectedBreak.type")
    flat = words.select(
        "doc_id", "page", (F.col("b") * 1_000_000 + F.col("g") * 10_000 + F.col("w")).alias("i"), F.array_join(F.transform("word.symbols", lambda s: s["text"]), "").alias("text"), F.coalesce("word.confidence", "_c").alias("conf"),
        (F.array_min(xs) * scale).alias("minx"), (F.array_min(ys) * scale).alias("miny"), (F.array_max(xs) * scale).alias("maxx"), (F.array_max(ys) * scale).alias("maxy"), F.concat_ws(".", "b", "g").alias("paragraph"),
        "b", "g", "w", F.coalesce(stop.isin(*LINE_END), F.lit(False)).alias("_end"), F.coalesce(stop == "HYPHEN", F.lit(False)).alias("joined"),
    )
    along = Window.partitionBy("doc_id", "page").orderBy("b", "g", "w")
    begins = (F.col("w") == 0) | F.lag("_end", 1, True).over(along)
    numbered = flat.withColumn("_begins", begins.cast("int")).withColumn("line", (F.sum("_begins").over(along) - 1).cast("int")).filter("text <> ''")
    across = Window.partitionBy("doc_id", "page").orderBy("line", "minx", "b", "g", "w")
    return numbered.withColumn("order", F.row_number().over(across)).drop("b", "g", "w", "_end", "_begins")


def azure_words(replies: DataFrame) -> DataFrame:
    """Words of (doc_id, reply) with an analyzeResult in inches: a word belongs to the line whose span holds its offset, else to the first whose box holds its centre, else it is a line of its own."""
    pages = replies.select("doc_id", F.inline(F.from_json("reply", AZURE)["pages"]))
    spans = F.flatten(F.transform("lines", lambda line, k: F.transform(line["spans"], lambda s: F.named_struct(F.lit("k"), k, F.lit("a"), s["offset"], F.lit("b"), s["offset"] + s["length"]))))
    words = pages.select("doc_id", F.col("pageNumber").alias("page"), spans.alias("_s"), F.col("lines").alias("_l"), F.size("lines").alias("_n"), F.posexplode("words").alias("i", "w"))
    held = F.filter("_s", lambda s: (F.col("w.span.offset") >= s["a"]) & (F.col("w.span.offset") < s["b"]))
    across, down = (lambda c, odd=odd: F.filter(c, lambda _, k: k % 2 == odd) for odd in (0, 1))
    xs, ys = across(F.col("w.polygon")), down(F.col("w.polygon"))
    x, y = (F.array_min(xs) + F.array_max(xs)) / 2, (F.array_min(ys) + F.array_max(ys)) / 2
    within = lambda c, v: (F.array_min(c) <= v) & (v <= F.array_max(c))
    near = F.filter(F.transform("_l", lambda line, k: F.when(within(across(line["polygon"]), x) & within(down(line["polygon"]), y), k)), lambda k: k.isNotNull())
    return words.select(
        "doc_id", "page", "i", F.col("w.content").alias("text"), F.col("w.confidence").alias("conf"), (F.array_min(xs) * 72).alias("minx"), (F.array_min(ys) * 72).alias("miny"), (F.array_max(xs) * 72).alias("maxx"), (F.array_max(ys) * 72).alias("maxy"),
        F.coalesce(F.get(held, F.lit(0))["k"], F.get(near, F.lit(0)), F.col("_n") + F.col("i")).alias("line"),
    )


def refused(service: str, kind: Column, pages: Column, size: Column, stored: Column | None = None) -> Column:
    """Why a service cannot read a whole document, asked before any call: unsupported or no_content; NULL if it can.

    A document is refused rather than read in part. `stored` says that the document lies where the service's
    asynchronous job can fetch it, which lifts the limit of pages of a service that has such a job.
    """
    kinds, most, job = DOCUMENT_LIMITS[service]
    long = pages > most if most else F.lit(False)
    if job and stored is not None:
        long = long & ~stored
    return F.when(~kind.isin(*kinds) | long, "unsupported").when(F.coalesce(size, F.lit(0)) == 0, "no_content")


# Kinds of whole documents that a service reads, pages in one call, whether a job reads more.
DOCUMENT_LIMITS = {"google": (("pdf",), 5, False), "azure": (("pdf",), None, False), "textract": (("pdf", "tiff"), 1, True)}


def azure_problems(replies: DataFrame) -> DataFrame:
    """(doc_id, error) of replies (doc_id, reply, pages) that must not be used: fewer pages than the document has, or a unit other than inches."""
    read = replies.select("doc_id", "pages", F.from_json("reply", AZURE)["pages"].alias("got"))
    other = F.exists("got", lambda p: F.coalesce(p["unit"], F.lit("inch")) != "inch")
    bad = F.when(F.col("got").isNull() | (F.size("got") < F.col("pages")), "bad_response").when(other, "unsupported")
    return read.select("doc_id", bad.alias("error")).filter("error is not null")


def textract_job(start: Callable[[], str], fetch: Callable[[str, str | None], dict], wait: Callable[[], None], tries: int = 600) -> list[dict]:
    """All blocks of an asynchronous job: it is polled until it ends, then read page by page of results.

    A job that fails, ends with part of its pages, hands out one token twice or does not end within `tries` polls is an error.
    """
    job = start()
    for _ in range(tries):
        got = fetch(job, None)
        if got.get("JobStatus") != "IN_PROGRESS":
            break
        wait()
    if got.get("JobStatus") != "SUCCEEDED":
        raise ProviderError("timeout" if got.get("JobStatus") == "IN_PROGRESS" else "bad_response", str(got.get("JobStatus")))
    blocks, seen = list(got.get("Blocks") or []), set()
    while token := got.get("NextToken"):
        if token in seen:
            raise ProviderError("bad_response", "a token came twice")
        seen.add(token)
        got = fetch(job, token)
        blocks += got.get("Blocks") or []
    return blocks


def mean_confidence(words: DataFrame) -> DataFrame:
    """Per page, over the words that carry one."""
    return words.groupBy("doc_id", "page").agg(F.avg("conf").alias("confidence"))


class _Hocr(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words: list[list] = []
        self.page, self.line, self.depth, self.word = 0, -1, 0, None

    def handle_starttag(self, tag, attributes):
        a = dict(attributes)
        kind, title = (a.get("class") or "").split(" ")[0], a.get("title") or ""
        if kind == "ocr_page":
            self.page += 1
        elif kind in ("ocr_line", "ocr_header", "ocr_caption", "ocr_textfloat"):
            self.line += 1
        elif kind == "ocrx_word":
            box = re.search(r"bbox (-?\d+) (-?\d+) (-?\d+) (-?\d+)", title)
            conf = re.search(r"x_wconf (\d+(?:\.\d+)?)", title)
            self.word = [max(1, self.page), self.line, "", *(map(float, box.groups()) if box else (0.0,) * 4), float(conf[1]) / 100 if conf else None]
            self.depth = 0
        if self.word is not None and tag == "span":
            self.depth += 1

    def handle_data(self, data):
        if self.word is not None:
            self.word[2] += data

    def handle_endtag(self, tag):
        if self.word is not None and tag == "span":
            self.depth -= 1
            if not self.depth:
                if self.word[2].strip():
                    self.words.append([*self.word[:2], self.word[2].strip(), *self.word[3:]])
                self.word = None


def hocr_words(replies: DataFrame, dpi: float = 300.0) -> DataFrame:
    """Words of (doc_id, reply) in hOCR: pixels to points, a missing confidence is its page's mean."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page", "line", "text", "minx", "miny", "maxx", "maxy", "conf"]
        for pdf in batches:
            for doc, reply in zip(pdf["doc_id"], pdf["reply"], strict=True):
                reader = _Hocr()
                reader.feed(reply or "")
                frame = pd.DataFrame(reader.words, columns=columns)
                frame["conf"] = frame["conf"].astype(float)
                frame["conf"] = frame["conf"].fillna(frame.groupby("page")["conf"].transform("mean"))
                frame[["minx", "miny", "maxx", "maxy"]] *= 72.0 / dpi
                frame.insert(0, "doc_id", doc)
                frame.insert(1, "i", range(len(frame)))
                yield frame

    return replies.select("doc_id", "reply").mapInPandas(run, "doc_id long, i long, page int, line int, text string, minx double, miny double, maxx double, maxy double, conf double")


def classify_error(status: int) -> str:
    """The kind of an HTTP status."""
    return {400: "bad_request", 401: "auth", 403: "auth", 404: "bad_request", 408: "timeout", 413: "too_large", 415: "unsupported", 422: "bad_request", 429: "rate_limited", 504: "timeout"}.get(status, "unavailable" if status >= 500 else "bad_response")
