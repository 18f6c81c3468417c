"""Sources and their kinds, decided by content, under limits that are tested before content is read."""

from __future__ import annotations

import io
import zipfile
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEDIA = {
    "pdf": "application/pdf", "png": "image/png", "jpeg": "image/jpeg", "tiff": "image/tiff", "webp": "image/webp", "csv": "text/csv",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}


@dataclass(frozen=True)
class Limits:
    """Ceilings of one document; zero or less means the default."""

    source: int = 64 << 20
    decompressed: int = 512 << 20
    stream: int = 64 << 20
    text: int = 32 << 20
    pages: int = 1000
    depth: int = 64
    objects: int = 500_000
    pixels: int = 50_000_000

    def normalised(self) -> Limits:
        return Limits(**{k: v if v > 0 else getattr(Limits(), k) for k, v in vars(self).items()})


class LimitError(Exception):
    """Names the limit and its option, never content."""

    def __init__(self, limit: str, most: int):
        super().__init__(f"the document exceeds the {limit} limit of {most}; raise it with max_{limit}")
        self.limit = limit


class Malformed(Exception):
    pass


class Budget:
    """A cumulative count that fails without adding."""

    def __init__(self, limit: str, most: int):
        self.limit, self.most, self.used = limit, most, 0

    def add(self, n: int) -> None:
        if n > self.most - self.used:
            raise LimitError(self.limit, self.most)
        self.used += n


def inflate(raw: bytes, limits: Limits, total: Budget, wbits: int = 15) -> bytes:
    """zlib (or raw deflate with wbits -15) under the limits of a stream and of the document."""
    z = zlib.decompressobj(wbits)
    out = z.decompress(raw, limits.stream + 1)
    if len(out) > limits.stream:
        raise LimitError("stream", limits.stream)
    total.add(len(out))
    return out


def read_files(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, path, size, content, error): content is only read below the size limit, which is pushed to the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.filter(F.col("length") <= limits.source).select("path", F.col("length").alias("size"), "content", F.lit(None).cast("string").alias("error"))
    large = files.filter(F.col("length") > limits.source).select("path", F.col("length").alias("size"), F.lit(None).cast("binary").alias("content"), F.lit(str(LimitError("source", limits.source))).alias("error"))
    return small.unionByName(large).withColumn("doc_id", F.xxhash64("path"))


def magic_kind(content: Column) -> Column:
    """Kinds that their first bytes tell: images, `zip`, `pdf`; NULL otherwise."""
    head = F.hex(F.substring(content, 1, 12))
    window = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
        .when(head.rlike("^52494646.{8}57454250"), "webp").when(head.startswith("504B0304") | head.startswith("504B0506"), "zip").when(window.contains("%PDF-"), "pdf")
    )


def zip_kind(content: bytes, limits: Limits = Limits()) -> tuple[str | None, str | None]:
    """(kind, error) of a ZIP container: from its content types, else its part names; the first match wins."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            entries = z.infolist()
            if len(entries) > limits.objects:
                return None, str(LimitError("objects", limits.objects))
            if any(e.flag_bits & 1 for e in entries):
                return None, "encrypted"
            names = [e.filename for e in entries]
            said = z.open("[Content_Types].xml").read(limits.stream + 1) if "[Content_Types].xml" in names else b""
            found = [(said.find(needle), kind) for needle, kind in ((b"wordprocessingml.document", "docx"), (b"spreadsheetml.sheet", "xlsx")) if needle in said]
            if found:
                return min(found)[1], None
            for name in names:
                if name == "word/document.xml":
                    return "docx", None
                if name == "xl/workbook.xml":
                    return "xlsx", None
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, zlib.error):
        return None, "malformed"
    return None, "unsupported"


def is_csv(content: bytes) -> bool:
    """Up to 64 KiB of UTF-8 without controls, strict quotes, two rows and fields at least, rectangular over 100 rows."""
    head = content[: 64 << 10]
    if len(content) > len(head):
        head = head[: head.rfind(b"\n") + 1]
    try:
        text = head.decode("utf-8-sig")
    except UnicodeDecodeError:
        return False
    if any(ord(c) < 32 and c not in "\t\n\r" or c == "\x7f" for c in text):
        return False
    try:
        rows = strict_csv(text)[:100]
    except Malformed:
        return False
    return len(rows) >= 2 and len(rows[0]) >= 2 and all(len(r) == len(rows[0]) for r in rows)


def strict_csv(text: str) -> list[list[str]]:
    """Comma-separated rows; a quote inside a bare field, or text after a closing quote, is an error; blank lines are skipped."""
    rows, row, field, state = [], [], [], "start"
    text = text.replace("\r\n", "\n")
    for ch in text + ("" if text.endswith("\n") or not text else "\n"):
        if state == "quoted":
            state = "closing" if ch == '"' else state
            if ch != '"':
                field.append(ch)
        elif ch == '"' and state in ("start", "closing"):
            if state == "closing":
                field.append(ch)
            state = "quoted"
        elif ch in ",\n":
            if not (ch == "\n" and state == "start" and not row):
                row.append("".join(field))
            field, state = [], "start"
            if ch == "\n":
                if row:
                    rows.append(row)
                row = []
        elif ch == '"' or state == "closing":
            raise Malformed("quote")
        else:
            field.append(ch)
            state = "bare"
    if state == "quoted":
        raise Malformed("quote")
    return rows


def pdf_encrypted(content: Column) -> Column:
    """The last trailer of the final 4 KiB names an encryption dictionary."""
    tail = F.decode(F.when(F.length(content) > 4096, F.substring(content, F.length(content) - 4095, F.lit(4096))).otherwise(content), "ISO-8859-1")
    return F.regexp_extract(tail, r"(?s).*trailer(.*)$", 1).rlike(r"/Encrypt\s+\d")


def identify(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds kind, pages (1 for single images, else 0: not known), media, and error where nothing fits. Magic bytes stay in the JVM; Python sees only containers and what may be CSV."""
    from pyspark.sql.functions import pandas_udf

    limits = limits.normalised()

    @pandas_udf("struct<kind:string,error:string>")
    def deeper(contents, magic):
        import pandas as pd

        out = []
        for c, m in zip(contents, magic, strict=True):
            if m == "zip":
                out.append(zip_kind(c, limits))
            elif m is None and c:
                out.append(("csv", None) if is_csv(c) else (None, "unsupported"))
            else:
                out.append((None, None if m else "unsupported"))
        return pd.DataFrame(out, columns=["kind", "error"])

    known = files.withColumn("_m", magic_kind(F.col("content")))
    seen = known.withColumn("_d", deeper(F.when(F.col("_m").isNull() | (F.col("_m") == "zip"), F.col("content")), F.col("_m")))
    kind = F.when(F.col("_m").isNotNull() & (F.col("_m") != "zip"), F.col("_m")).otherwise(F.col("_d.kind"))
    media = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    error = F.coalesce(F.col("error"), F.when((kind == "pdf") & pdf_encrypted(F.col("content")), "encrypted"), F.when(kind.isNull(), F.coalesce("_d.error", F.lit("unsupported"))))
    out = seen.withColumns({"kind": kind, "pages": F.when(kind.isin("png", "jpeg", "webp"), 1).otherwise(0), "media": F.try_element_at(media, kind), "error": error})
    return out.drop("_m", "_d")


def image_size(content: bytes) -> tuple[int, int]:
    """Width and height from the header of a PNG or JPEG, before any pixel is decoded."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and content[12:16] == b"IHDR":
        return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")
    at = 2
    while content[:3] == b"\xff\xd8\xff" and at + 9 < len(content):
        if content[at] != 0xFF:
            break
        mark, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        at += 2 + size
    raise Malformed("image")


def check_pixels(width: int, height: int, limits: Limits = Limits()) -> None:
    if height and width > limits.pixels // height:
        raise LimitError("pixels", limits.pixels)

