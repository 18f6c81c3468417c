"""Positioned words to text with a map from every character back to its word, page and box."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioforge.functions.text import BIDI, MANY, ONE, ZERO_WIDTH

# Gaps between blocks as multiples of the median height, share of the width, depth of cuts, overlap of a line, gap between words.
ROW_GAP, COLUMN_GAP, COLUMN_SHARE, DEPTH, OVERLAP, WORD_GAP, WIDE = 1.2, 1.2, 0.03, 12, 0.5, 0.2, 0.8
HYPHENS = "-­‐‑‒"
SEGMENT = "struct<start:int,end:int,src_start:int,src_end:int,page:int,word:int,line:int,minx:double,miny:double,maxx:double,maxy:double,verbatim:boolean>"
RESULT = f"doc_id long, text string, segments array<{SEGMENT}>, pages array<struct<page:int,marker_start:int,body_start:int,end:int>>, findings array<struct<kind:string,page:int,cp:int,n:int>>"
_HIDDEN = re.compile(f"[{ZERO_WIDTH}{BIDI}]")


@cache
def _changing() -> frozenset[str]:
    """The characters that canonical_units() may change: folded ones, marks and white space."""
    return frozenset(ch for ch in map(chr, range(sys.maxunicode + 1)) if ch in ONE or ch in MANY or ch.isspace() or unicodedata.combining(ch))


def canonical_units(text: str) -> list[tuple[str, int, int]]:
    """(canonical characters, source start, source end) units of a word: folds, composed marks, a run of white space as one space; one unit where nothing changes."""
    if _changing().isdisjoint(text):
        return [(text, 0, len(text))] if text else []
    units: list[tuple[str, int, int]] = []
    for i, ch in enumerate(text):
        to = ONE.get(ch) or MANY.get(ch) or ch
        if to.isspace():
            to = " "
        if units:
            last, a, _ = units[-1]
            if to == " " and last == " ":
                units[-1] = (" ", a, i + 1)
                continue
            if unicodedata.combining(ch) and len(last) == 1:
                joined = unicodedata.normalize("NFC", last + ch)
                if len(joined) == 1:
                    units[-1] = (joined, a, i + 1)
                    continue
        units.append((to, i, i + 1))
    return units


class Box:
    __slots__ = ("conf", "i", "line", "maxx", "maxy", "minx", "miny", "text")

    def __init__(self, i: int, text: str, minx, miny, maxx, maxy, line: int, conf: float):
        self.i, self.text, self.minx, self.miny, self.maxx, self.maxy, self.line, self.conf = i, text, minx, miny, maxx, maxy, line, conf

    @property
    def placed(self) -> bool:
        return self.maxx > self.minx or self.maxy > self.miny


def median_height(words: list[Box]) -> float:
    heights = sorted(w.maxy - w.miny for w in words if w.maxy > w.miny)
    return heights[len(heights) // 2] if heights else 10.0


def _split(words: list[Box], low: str, high: str, gap: float) -> list[list[Box]]:
    """Groups along an axis wherever nothing covers a stretch of over `gap`."""
    ordered = sorted(words, key=attrgetter(low, "i"))
    lows, highs = map(attrgetter(low), ordered), map(attrgetter(high), ordered)
    groups, reach = [[]], None
    for w, start, end in zip(ordered, lows, highs, strict=True):
        if reach is None:
            reach = end
        elif start - reach > gap:
            groups.append([])
        groups[-1].append(w)
        if end > reach:
            reach = end
    return groups


def blocks(words: list[Box], width: float, depth: int = 0) -> list[list[Box]]:
    """Blocks in reading order by recursive cuts: rows first, then columns; lines nearly as wide as the region part its columns."""
    if len(words) < 2 or depth >= DEPTH:
        return [words]
    height = median_height(words)
    rows = _split(words, "miny", "maxy", ROW_GAP * height)
    if len(rows) > 1:
        return [b for r in rows for b in blocks(r, width, depth + 1)]
    gap = max(COLUMN_SHARE * width, COLUMN_GAP * height)
    columns = _split(words, "minx", "maxx", gap)
    if len(columns) > 1:
        return [b for c in columns for b in blocks(c, width, depth + 1)]
    region = max(w.maxx for w in words) - min(w.minx for w in words)
    rows = lines(words)
    wide = [line for line in rows if max(w.maxx for w in line) - min(w.minx for w in line) >= WIDE * region and all(b.minx - a.maxx <= gap for a, b in zip(line, line[1:], strict=False))]
    if wide and len(wide) < len(rows):
        marks = {id(w) for line in wide for w in line}
        rest = [w for w in words if id(w) not in marks]
        edges = sorted((min(w.miny for w in line), line) for line in wide) if len({min(w.miny for w in line) for line in wide}) == len(wide) else []
        if rest and edges and len(_split(rest, "minx", "maxx", gap)) > 1:
            out: list[list[Box]] = []
            for top, line in edges:
                above = [w for w in rest if w.miny < top]
                rest = [w for w in rest if w.miny >= top]
                out += blocks(above, width, depth + 1) if above else []
                out.append(line)
            return out + (blocks(rest, width, depth + 1) if rest else [])
    return [words]


def lines(words: list[Box]) -> list[list[Box]]:
    """Lines of a block: by hint where all words have one, one line without geometry, else by vertical overlap."""
    if words and all(w.line >= 0 for w in words):
        by: dict[int, list[Box]] = {}
        for w in words:
            by.setdefault(w.line, []).append(w)
        return list(by.values())
    if not any(w.placed for w in words):
        return [words]
    made: list[list] = []
    for w in sorted(words, key=lambda w: (w.miny, w.minx, w.i)):
        for line in made:
            top, bottom = line[0], line[1]
            shared = min(bottom, w.maxy) - max(top, w.miny)
            if shared > OVERLAP * min(bottom - top, w.maxy - w.miny):
                line[0], line[1] = min(top, w.miny), max(bottom, w.maxy)
                line[2].append(w)
                break
        else:
            made.append([w.miny, w.maxy, [w]])
    made.sort(key=lambda m: (m[0], min(w.minx for w in m[2])))
    return [sorted(m[2], key=lambda w: (w.minx, w.i)) for m in made]


def normalise(pages: list[tuple[int, float, float, list[Box]]]) -> dict:
    """Text, segments that tile it, page spans and findings of one document."""
    out: list[str] = []
    segments: list[list] = []
    spans, found = [], {}
    at = 0

    def push(text: str, a: int, b: int, page: int, w: Box | None, verbatim: bool) -> None:
        nonlocal at
        if not text:
            return
        word = w.i if w else -1
        last = segments[-1] if segments else None
        if last and verbatim and last[11] and last[5] == word and last[4] == page and last[3] == a:
            last[1], last[3] = at + len(text), b
        else:
            box = (w.minx, w.miny, w.maxx, w.maxy) if w and w.placed else (None,) * 4
            segments.append([at, at + len(text), a, b, page, word, w.line if w else -1, *box, verbatim])
        out.append(text)
        at += len(text)

    def note(kind: str, page: int, cp: int | None) -> None:
        found[kind, page, cp] = found.get((kind, page, cp), 0) + 1

    for n, (number, width, height, words) in enumerate(pages):
        start = at
        push(("\n\n" if n else "") + f"[page {number}]\n", 0, 0, number, None, False)
        body = at
        usual = median_height(words)
        groups = blocks(words, width) if any(w.placed for w in words) else [words]
        for k, block in enumerate(g for g in groups if g):
            if k:
                push("\n\n", 0, 0, number, None, False)
            rows = lines(block)
            pending = False  # the last word's hyphen joined the lines
            for j, line in enumerate(rows):
                if j and not pending:
                    push("\n", 0, 0, number, None, False)
                before = None
                for m, w in enumerate(line):
                    for ch in () if w.text.isascii() else _HIDDEN.findall(w.text):
                        if ch in BIDI:
                            note("bidi", number, ord(ch))
                        else:
                            note("zero-width", number, ord(ch))
                    if w.placed and width and height and (w.maxx < 0 or w.minx > width or w.maxy < 0 or w.miny > height):
                        note("off-page", number, None)
                    if before is not None and (not (before.placed and w.placed) or w.minx - before.maxx > WORD_GAP * usual) and not out[-1].endswith(" "):
                        push(" ", 0, 0, number, None, False)
                    units = canonical_units(w.text)
                    following = rows[j + 1][0].text if m == len(line) - 1 and j + 1 < len(rows) else ""
                    joins = bool(following) and following[0].isalpha() and len(w.text) > 1 and w.text[-1] in HYPHENS and w.text[-2].isalpha()
                    if joins and (following[0].islower() or w.text[-1] == "­"):
                        last, a, b = units[-1]
                        units = units[:-1] if len(units) > 1 or b - a == 1 else [(last[:-1], a, b - 1)]
                    for text, a, b in units:
                        push(text, a, b, number, w, text == w.text[a:b])
                    pending, before = joins, w
        spans.append((number, start, body, at))
    return {"text": "".join(out), "segments": [tuple(s) for s in segments], "pages": spans, "findings": [(k, p, c, n) for (k, p, c), n in found.items()]}


def normalise_words(words: DataFrame, page_width: float = 612.0, page_height: float = 792.0) -> DataFrame:
    """RESULT rows from words (doc_id, page, i, text, minx, miny, maxx, maxy, line, conf): one group, one document.

    Offsets count characters. A document's words are one group by nature; documents are spread by doc_id.
    """

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort([table[k].to_numpy() for k in ("i", "page")])
        cells = {k: table[k].take(pa.array(order)).to_pylist() for k in ("page", "i", "text", "line", *BOX)}
        pages: dict[int, list[Box]] = {}
        place = [[0.0 if v is None or v != v else float(v) for v in cells[k]] for k in BOX]
        for page, i, text, line, *box in zip(cells["page"], cells["i"], cells["text"], cells["line"], *place, strict=True):
            if page is not None and page == page:
                pages.setdefault(int(page), []).append(Box(int(i), text or "", *box, -1 if line is None or line != line else int(line), 1.0))
        made = normalise([(number, page_width, page_height, boxes) for number, boxes in pages.items()])
        listed = lambda name: pa.ListArray.from_arrays(pa.array([0, len(made[name])], pa.int32()), _structs(made[name], types.field(name).type.value_type))
        parts = [table["doc_id"].combine_chunks()[:1].cast(pa.int64()), pa.array([made["text"]], pa.string()), *map(listed, ("segments", "pages", "findings"))]
        return pa.Table.from_arrays(parts, names=types.names)

    types = to_arrow_schema(T._parse_datatype_string(RESULT))
    return words.select("doc_id", "page", "i", "text", *BOX, "line").groupBy("doc_id").applyInArrow(run, RESULT)


def _structs(rows: list[tuple], kind: pa.StructType) -> pa.StructArray:
    """Rows as an array of structs, built column by column."""
    columns = zip(*rows, strict=True) if rows else [()] * kind.num_fields
    return pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))


def locate(segments: Column, start: Column, end: Column) -> Column:
    """Segments that overlap a span; verbatim ones are cut to it, others stay whole."""
    hit = F.filter(segments, lambda s: (s["end"] > start) & (s["start"] < end))

    def cut(s: Column) -> Column:
        a, b = F.greatest(s["start"], start), F.least(s["end"], end)
        return F.when(s["verbatim"], s.withField("src_start", s["src_start"] + a - s["start"]).withField("src_end", s["src_end"] - s["end"] + b).withField("start", a).withField("end", b)).otherwise(s)

    return F.transform(hit, cut)


BOX = ("minx", "miny", "maxx", "maxy")
REGIONS = "array<struct<page:int,line:int,box:struct<minx:double,miny:double,maxx:double,maxy:double>>>"


def regions_of(segments: Column, start: Column, end: Column) -> Column:
    """array<struct<page, line, box>>: a box around the placed words of a span for each run of one page and line, in order."""
    placed = F.filter(segments, lambda s: (s["end"] > start) & (s["start"] < end) & (s["word"] >= 0) & s["minx"].isNotNull())

    def joined(made: Column, s: Column) -> Column:
        last, own = F.element_at(made, -1), F.struct(*[s[b].alias(b) for b in BOX])
        same = (F.size(made) > 0) & (F.try_element_at(made, F.lit(-1))["page"] == s["page"]) & (F.try_element_at(made, F.lit(-1))["line"] == s["line"])
        wider = F.struct(*[(F.least if b.startswith("min") else F.greatest)(last["box"][b], s[b]).alias(b) for b in BOX])
        grown = F.concat(F.slice(made, F.lit(1), F.size(made) - 1), F.array(F.struct(s["page"].alias("page"), s["line"].alias("line"), wider.alias("box"))))
        return F.when(same, grown).otherwise(F.concat(made, F.array(F.struct(s["page"].alias("page"), s["line"].alias("line"), own.alias("box"))))).cast(REGIONS)

    return F.aggregate(placed, F.array().cast(REGIONS), joined)


def page_at(pages: Column, offset: Column) -> Column:
    """The page whose marker or body holds an offset."""
    return F.get(F.filter(pages, lambda p: (p["marker_start"] <= offset) & (offset < p["end"])), F.lit(0))["page"]


def inserted(segments: Column, start: Column, end: Column) -> Column:
    """Whether a span touches text that no word gave."""
    return F.exists(segments, lambda s: (s["word"] < 0) & (s["end"] > start) & (s["start"] < end))


def page_text(text: Column, page: Column) -> Column:
    """A page's body, its marker left out."""
    return F.substring(text, page["body_start"] + 1, page["end"] - page["body_start"])


def tiles(made: dict) -> Iterator[bool]:
    """Whether the segments of a result lie end to end over its text."""
    at = 0
    for s in made["segments"]:
        yield s[0] == at and s[1] > s[0]
        at = s[1]
    yield at == len(made["text"])
