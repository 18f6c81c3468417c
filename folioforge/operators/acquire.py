"""Which reading serves which page: text layers, office files, OCR and images for models, as routing columns over documents and pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("auto", "text", "ocr", "vision", "both")
OFFICE = ("docx", "xlsx", "csv")


@dataclass(frozen=True)
class Providers:
    """What can be called: OCR of whole documents, OCR of page images, a model that reads images."""

    document_ocr: bool = False
    ocr: bool = False
    vision: bool = True


def _images(mode: str, given: Providers) -> Column:
    """The reading of what has no text layer."""
    if mode == "vision":
        return F.lit("vision") if given.vision else F.lit(None).cast("string")
    if given.document_ocr:
        return F.lit("document_ocr")
    if given.ocr:
        return F.lit("ocr")
    return F.lit("vision") if given.vision and mode in ("auto", "both") else F.lit(None).cast("string")


def route(files: DataFrame, mode: str = "auto", given: Providers = Providers()) -> DataFrame:
    """Adds route (text, office, document_ocr, ocr, vision) and an error for files (doc_id, kind, error).

    Office files are read as such in every mode, PDFs by their text layer unless the mode asks for OCR or vision; all
    else by OCR of the document, of its pages, or by a model, in that order. Where nothing can read it the error is no_provider.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode} is none of {', '.join(MODES)}")
    layer = (F.col("kind") == "pdf") & F.lit(mode not in ("ocr", "vision"))
    found = F.when(F.col("error").isNull(), F.when(F.col("kind").isin(*OFFICE), "office").when(layer, "text").otherwise(_images(mode, given)))
    return files.withColumn("route", found).withColumn("error", F.coalesce("error", F.when(F.col("route").isNull(), "no_provider")))


def read_pages(pages: DataFrame, mode: str = "auto", given: Providers = Providers()) -> DataFrame:
    """(doc_id, page, reading, why) of pages with a text layer (doc_id, page, why: NULL where the layer can be used).

    A usable page is read as text. The others of a document that has a usable page are read by OCR or else by a model, or not at
    all (reading NULL, listed by unread()). Documents without a usable page fall through to the reading of images; in
    mode text they have no content.
    """
    one = pages.groupBy(F.col("doc_id").alias("_d")).agg(F.bool_or(F.col("why").isNull()).alias("_some"))
    known = pages.join(one, F.col("doc_id") == F.col("_d")).drop("_d")
    single = F.lit("ocr") if given.ocr else F.lit("vision") if given.vision and mode != "text" else F.lit(None).cast("string")
    whole = F.lit(None).cast("string") if mode == "text" else _images(mode, given)
    usable = F.col("why").isNull() & F.lit(mode not in ("ocr", "vision"))
    return known.select("doc_id", "page", F.when(usable, "text").when(F.col("_some") & F.lit(mode not in ("ocr", "vision")), single).otherwise(whole).alias("reading"), "why")


def unread(readings: DataFrame) -> DataFrame:
    """(doc_id, pages, error): the pages that nothing read, in order; no_content where no page of the document was read."""
    lost = F.array_sort(F.collect_list(F.when(F.col("reading").isNull(), F.col("page"))))
    return readings.groupBy("doc_id").agg(lost.alias("pages"), F.when(F.count("reading") == 0, "no_content").alias("error"))


def primary(readings: DataFrame) -> DataFrame:
    """(doc_id, reading): that of a document's first page that was read."""
    return readings.filter("reading is not null").groupBy("doc_id").agg(F.min_by("reading", "page").alias("reading"))


def second(primary_readings: DataFrame, mode: str, given: Providers = Providers()) -> DataFrame:
    """Adds second: in mode both a model reads images, or OCR where a model read first; NULL where that cannot be called, which is no error."""
    other = F.when(F.col("reading") == "vision", F.lit("ocr") if given.ocr or given.document_ocr else F.lit(None)).otherwise(F.lit("vision") if given.vision else F.lit(None))
    return primary_readings.withColumn("second", other if mode == "both" else F.lit(None).cast("string"))


def method(reading: Column, provider: Column) -> Column:
    """How a value came to be, for its provenance."""
    return F.when(reading == "text", "text-layer").when(reading == "office", "office").when(reading.isin("ocr", "document_ocr"), F.concat(F.lit("ocr:"), provider)).when(reading == "vision", F.concat(F.lit("model:"), provider))


def usage(calls: DataFrame) -> DataFrame:
    """(doc_id, input_tokens, output_tokens, pages): sums over a document's calls."""
    return calls.groupBy("doc_id").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "pages")])
