"""Words of DOCX, XLSX and CSV files: exact text, no geometry, confidence 1, one line number per paragraph, row or record."""

from __future__ import annotations

import io
import re
import xml.parsers.expat
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from folioforge.sources.detect import Budget, LimitError, Limits, Malformed, strict_csv

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main "
X = "http://schemas.openxmlformats.org/spreadsheetml/2006/main "
REL = "http://schemas.openxmlformats.org/package/2006/relationships "
ALTERNATE = "http://schemas.openxmlformats.org/markup-compatibility/2006 AlternateContent"
# Elements of a body that hold no text to read.
SKIPPED = {"pPr", "sectPr", "tblPr", "tblGrid", "trPr", "tcPr", "del", "delText", "moveFrom", "instrText"}
MAX_WORDS, MAX_COLUMNS = 1 << 18, 16_384
WORD_SCHEMA = "doc_id long, page int, i long, text string, line int, conf double, hidden_runs int, skipped string, error string"


class Words:
    """Collects words; blank ones are dropped, and the line number only advances past lines that have words."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.line, self.open = 1, False

    def add(self, page: int, text: str) -> None:
        if not any(c.isprintable() and not c.isspace() for c in text):
            return
        if len(self.rows) >= MAX_WORDS:
            raise LimitError("words", MAX_WORDS)
        self.rows.append((page, len(self.rows), text, self.line))
        self.open = True

    def end_line(self) -> None:
        if self.open:
            self.line, self.open = self.line + 1, False


class Container:
    """A ZIP of stored or deflated parts; the first of equal names counts, sizes are tested while reading."""

    def __init__(self, content: bytes, limits: Limits):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, OSError) as e:
            raise Malformed("zip") from e
        self.limits, self.total = limits, Budget("decompressed", limits.decompressed)
        self.parts: dict[str, zipfile.ZipInfo] = {}
        entries = self.zip.infolist()
        if len(entries) > limits.objects:
            raise LimitError("objects", limits.objects)
        for e in entries:
            self.parts.setdefault(e.filename, e)

    def read(self, name: str) -> bytes:
        e = self.parts.get(name)
        if e is None:
            raise Malformed(f"no {name}")
        if e.flag_bits & 1 or e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise Malformed("encrypted or unknown compression")
        if e.file_size > self.limits.stream:
            raise LimitError("stream", self.limits.stream)
        try:
            out = self.zip.open(e).read(self.limits.stream + 1)
        except (zipfile.BadZipFile, OSError, EOFError, RuntimeError, ValueError) as err:
            raise Malformed(name) from err
        except Exception as err:
            raise Malformed(name) from err
        if len(out) > self.limits.stream:
            raise LimitError("stream", self.limits.stream)
        self.total.add(len(out))
        return out


def walk_xml(raw: bytes, start, text, end, limits: Limits) -> None:
    """Streams elements; document types are refused, entities are not expanded, depth is bounded."""
    parser = xml.parsers.expat.ParserCreate(namespace_separator=" ")
    depth = 0

    def opened(name, attributes):
        nonlocal depth
        depth += 1
        if depth > limits.depth * 4:
            raise LimitError("depth", limits.depth)
        start(name, attributes)

    def closed(name):
        nonlocal depth
        depth -= 1
        end(name)

    def doctype(*_):
        raise Malformed("document type")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = opened, closed, text, doctype
    try:
        parser.Parse(raw, True)
    except xml.parsers.expat.ExpatError as e:
        raise Malformed("xml") from e


def read_csv(content: bytes, limits: Limits = Limits()) -> Words:
    try:
        rows = strict_csv(content.decode("utf-8-sig"))
    except UnicodeDecodeError as e:
        raise Malformed("utf-8") from e
    words = Words()
    for row in rows:
        for cell in row:
            words.add(1, cell)
        words.end_line()
    return words


def read_docx(content: bytes, limits: Limits = Limits()) -> tuple[Words, int, list[str]]:
    """(words, hidden runs, skipped parts). A paragraph is a line unless it is inside a table row, which is one line."""
    box, words = Container(content, limits), Words()
    stack: list[str] = []
    run: list[str] = []
    state = {"skip": 0, "row": 0, "hidden": 0, "run_hidden": False, "in_text": False, "branch": []}

    def flush() -> None:
        if run:
            words.add(1, "".join(run))
            run.clear()

    def start(name: str, attributes: dict) -> None:
        local = name.removeprefix(W) if name.startswith(W) else ""
        parent = stack[-1] if stack else ""
        stack.append(name)
        if state["skip"]:
            state["skip"] += 1
            return
        if parent == ALTERNATE:
            state["branch"][-1] += 1
        if local in SKIPPED or parent == ALTERNATE and state["branch"][-1] > 1:
            state["skip"] = 1
        elif name == ALTERNATE:
            state["branch"].append(0)
        elif local == "t":
            state["in_text"] = True
        elif local == "tab":
            run.append("\t")
        elif local in ("br", "cr"):
            flush()
            words.end_line()
        elif local == "tr":
            state["row"] += 1
        elif local == "r":
            state["run_hidden"] = False
        elif local in ("vanish", "webHidden") and attributes.get(W + "val", "1") not in ("0", "false", "off") and not state["run_hidden"]:
            state["run_hidden"] = True
            state["hidden"] += 1

    def text(data: str) -> None:
        if state["in_text"] and not state["skip"]:
            run.append(data)

    def end(name: str) -> None:
        stack.pop()
        if state["skip"]:
            state["skip"] -= 1
            return
        local = name.removeprefix(W) if name.startswith(W) else ""
        if name == ALTERNATE:
            state["branch"].pop()
        elif local == "t":
            state["in_text"] = False
        elif local == "p":
            flush()
            if not state["row"]:
                words.end_line()
        elif local == "tr":
            state["row"] -= 1
            if not state["row"]:
                words.end_line()

    walk_xml(box.read("word/document.xml"), start, text, end, limits)
    flush()
    others = [n for n in box.parts if re.fullmatch(r"word/(header|footer)\d*\.xml|word/(footnotes|endnotes|comments)\.xml", n)]
    return words, state["hidden"], sorted(n for n in others if _has_text(box.read(n), limits))


def _has_text(raw: bytes, limits: Limits) -> bool:
    seen = {"in": False, "any": False}
    walk_xml(raw, lambda n, _: seen.update({"in": n == W + "t"}), lambda d: seen.update({"any": seen["any"] or seen["in"] and bool(d.strip())}), lambda n: seen.update({"in": False}), limits)
    return seen["any"]


def _column(reference: str) -> int | None:
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return None
    n = 0
    for ch in letters[0]:
        n = n * 26 + ord(ch) - 64
    return n


def read_xlsx(content: bytes, limits: Limits = Limits()) -> Words:
    """A page per worksheet in workbook order, a line per row, cells by column; values as stored, number formats not applied."""
    box, words = Container(content, limits), Words()
    targets: dict[str, str] = {}
    order: list[str] = []
    rel_id = "http://schemas.openxmlformats.org/officeDocument/2006/relationships id"
    nothing = lambda *_: None
    if "xl/workbook.xml" in box.parts and "xl/_rels/workbook.xml.rels" in box.parts:
        walk_xml(box.read("xl/_rels/workbook.xml.rels"), lambda n, a: targets.update({a.get("Id", ""): a.get("Target", "")}) if n == REL + "Relationship" else None, nothing, nothing, limits)
        walk_xml(box.read("xl/workbook.xml"), lambda n, a: order.append(targets.get(a.get(rel_id, ""), "")) if n == X + "sheet" else None, nothing, nothing, limits)
    sheets = [t.removeprefix("/") if t.startswith("/") else f"xl/{t}" for t in order if t]
    sheets = [s for s in sheets if s in box.parts and "/worksheets/" in s] or sorted((n for n in box.parts if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    if len(sheets) > limits.pages:
        raise LimitError("pages", limits.pages)
    shared: list[str] = []
    if "xl/sharedStrings.xml" in box.parts:
        part: dict = {"si": None, "t": False, "phonetic": 0}

        def s_start(n, _):
            if n == X + "si":
                part["si"] = []
            part["phonetic"] += n == X + "rPh"
            part["t"] = n == X + "t" and not part["phonetic"]

        def s_end(n):
            if n == X + "si":
                shared.append("".join(part["si"]))
            part["phonetic"] -= n == X + "rPh"
            part["t"] = False

        walk_xml(box.read("xl/sharedStrings.xml"), s_start, lambda d: part["si"].append(d) if part["t"] else None, s_end, limits)
    for page, name in enumerate(sheets, 1):
        row: list[tuple[int, int, str]] = []
        cell: dict = {"type": "", "at": 0, "value": [], "take": False}

        def start(n, a, row=row, cell=cell):
            if n == X + "row":
                row.clear()
            elif n == X + "c":
                cell.update(type=a.get("t", ""), at=_column(a.get("r", "")) or (row[-1][0] + 1 if row else 1), value=[])
            cell["take"] = n == X + "v" or n == X + "t" and cell["type"] == "inlineStr"

        def text(d, cell=cell):
            if cell["take"]:
                cell["value"].append(d)

        def end(n, row=row, cell=cell, page=page):
            cell["take"] = False
            if n == X + "c" and cell["at"] <= MAX_COLUMNS:
                value = "".join(cell["value"])
                if cell["type"] == "s":
                    value = shared[int(value)] if value.strip().isdigit() and int(value) < len(shared) else ""
                elif cell["type"] == "b":
                    value = "TRUE" if value.strip() == "1" else "FALSE"
                row.append((cell["at"], len(row), value))
            elif n == X + "row":
                for _, _, value in sorted(row):
                    words.add(page, value)
                words.end_line()

        walk_xml(box.read(name), start, text, end, limits)
    return words


def read_words(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """WORD_SCHEMA rows of files (doc_id, kind, content) of kinds docx, xlsx and csv; a file that cannot be read gives one row with its error."""
    limits = limits.normalised()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, kind, content in zip(pdf["doc_id"], pdf["kind"], pdf["content"], strict=True):
                hidden, skipped, error, words = 0, [], None, Words()
                try:
                    if kind == "docx":
                        words, hidden, skipped = read_docx(content, limits)
                    else:
                        words = (read_xlsx if kind == "xlsx" else read_csv)(content, limits)
                except LimitError as e:
                    error = str(e)
                except Malformed:
                    error = "malformed"
                rows = [(doc, p, i, t, line, 1.0, hidden, ",".join(skipped), None) for p, i, t, line in words.rows] if not error else []
                yield pd.DataFrame(rows or [(doc, None, None, None, None, None, hidden, "", error or "no content")], columns=["doc_id", "page", "i", "text", "line", "conf", "hidden_runs", "skipped", "error"])

    return files.filter("kind in ('docx', 'xlsx', 'csv')").select("doc_id", "kind", "content").mapInPandas(run, WORD_SCHEMA)
