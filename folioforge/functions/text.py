"""Text folding and search, as Column expressions; spans count characters, byte offsets are derived."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.expr import let

# Code points without width or that only direct the order of text.
ZERO_WIDTH = "\u00ad\u200b\u200c\u200d\u2060\u2061\u2062\u2063\u2064\ufeff\u180e\u034f\u115f\u1160"
BIDI = "\u061c\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
# Ranges whose compatibility forms are folded: Latin-1 signs, superscripts, letter-like, number forms, enclosed, spaces, ligatures, full width, mathematical letters.
FOLDED_RANGES = [(0x00A0, 0x00BE), (0x0132, 0x0133), (0x013F, 0x0140), (0x0149, 0x0149), (0x017F, 0x017F), (0x2000, 0x200A), (0x2024, 0x2026), (0x202F, 0x202F), (0x205F, 0x205F), (0x2070, 0x209C), (0x2100, 0x218B), (0x2460, 0x24EA), (0x3000, 0x3000), (0xFB00, 0xFB06), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF)]


def _compatibility() -> tuple[dict[str, str], dict[str, str]]:
    """One-to-one and one-to-many folds, built from the Unicode database over FOLDED_RANGES."""
    one, many = {}, {}
    for low, high in FOLDED_RANGES:
        for cp in range(low, high + 1):
            ch = chr(cp)
            if ch in ZERO_WIDTH or unicodedata.category(ch) == "Cn" or not unicodedata.decomposition(ch).startswith("<"):
                continue
            to = unicodedata.normalize("NFKC", ch)
            if to != ch:
                (one if len(to) == 1 and cp < 0x10000 else many)[ch] = to
    return one, many


ONE, MANY = _compatibility()


def _compositions() -> dict[str, str]:
    """Canonical compositions of a letter and a combining mark of U+0300 to U+036F, from the Unicode database."""
    made = {}
    for cp in range(0xC0, 0x2000):
        pair = unicodedata.normalize("NFD", chr(cp))
        while len(pair) > 1 and "\u0300" <= pair[-1] <= "\u036f":
            head = unicodedata.normalize("NFC", pair[:-1])
            whole = unicodedata.normalize("NFC", head + pair[-1])
            if len(head) == 1 and len(whole) == 1:
                made[head + pair[-1]] = whole
            pair = pair[:-1]
    return made


def _ranges(chars) -> str:
    """Characters as ranges for a class of a regular expression, which tests the parts of a class one after the other."""
    points = sorted({ord(ch) for ch in chars})
    ends = [(p, q) for p, q in zip([None, *points], [*points, None], strict=True) if p is None or q is None or q != p + 1]
    return "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for (_, low), (high, _) in zip(ends, ends[1:], strict=False))


_ODD = r"[^\x00-\x9F]"
_MARKS = r"\x{300}-\x{36F}"
_SINGLE = f"(?={_ODD})[{_ranges(ONE)}]"
_MULTIPLE = _ranges(ch for ch in MANY if ord(ch) < 0x10000) + r"\x{1D400}-\x{1D7FF}"
_RARE = f"(?={_ODD})[{_MULTIPLE}{_MARKS}]"
_CLUSTERS = f"[^{_MARKS}][{_MARKS}]+|(?={_ODD})(?:[{_MULTIPLE}]|[{_MARKS}]+)"  # characters with marks behind them, other rare ones, and marks at the start
_FOLDS = "\x1e".join(f"{k}\x1f{v}" for k, v in (MANY | _compositions()).items())
_SPACE = r"\s\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}"
_SPACES = f"(?: (?=[{_SPACE}])|[{_SPACE}&&[^ ]])[{_SPACE}]*"  # runs but for a space alone


def canonical(c: Column) -> Column:
    """Compatibility forms folded, marks composed with their letters, every run of white space one space; not trimmed.

    Texts of ASCII alone skip the folds, and of others only the rare characters are taken out; the table of folds is one constant.
    """
    table = F.str_to_map(F.lit(_FOLDS), F.lit("\x1e"), F.lit("\x1f"))

    def cluster(x: Column) -> Column:
        """A character and the marks behind it, composed from left to right."""
        head = F.substring(x, 1, 1)
        return F.aggregate(F.split(F.substring(x, F.lit(2), F.length(x)), ""), F.coalesce(F.try_element_at(table, head), head), lambda acc, mark: F.coalesce(F.try_element_at(table, F.concat(acc, mark)), F.concat(acc, mark)))

    def taken_out(t: Column) -> Column:
        whole = lambda found: F.array_join(F.transform(F.split(t, _CLUSTERS, -1), lambda gap, i: F.concat(gap, F.coalesce(cluster(F.get(found, i)), F.lit("")))), "")
        return F.when(t.rlike(_RARE), let(F.regexp_extract_all(t, F.lit(_CLUSTERS), F.lit(0)), whole)).otherwise(t)

    single = lambda t: F.when(t.rlike(_SINGLE), F.translate(t, "".join(ONE), "".join(ONE.values()))).otherwise(t)
    return F.regexp_replace(let(c, lambda t: F.when(t.rlike(_ODD), let(single(t), taken_out)).otherwise(t)), _SPACES, " ")


def without_ignorable(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?={_ODD})[{_ranges(ZERO_WIDTH + BIDI)}\x{{e0000}}-\x{{e007f}}]", "")


def folded(c: Column) -> Column:
    """Canonical, without ignorable code points, case folded (sharp s as ss)."""
    return F.replace(F.lower(F.replace(without_ignorable(canonical(c)), F.lit("ẞ"), F.lit("ss"))), F.lit("ß"), F.lit("ss"))


_IN_WORD = r"\p{L}\p{Nd}_"
_WORD = f"[{_IN_WORD}]"
_HELD = "\uf8fe"  # stands for the literal that is searched; texts that hold it are searched by a pattern of their own


def find_bounded(text: Column, literal: Column) -> Column:
    """1-based place of the first occurrence of `literal` that does not cut a word at either edge; 0 if none.

    The literal's occurrences become one character, and constant patterns test what stands beside it. Texts in
    which every such occurrence cuts a word are searched again by the literal's own pattern, as occurrences may overlap.
    """
    opens, closes = literal.rlike(f"^{_WORD}"), literal.rlike(f"{_WORD}$")

    def placed(held: Column) -> Column:
        def at(head: bool, tail: bool) -> Column:
            before = f"(?<![{_IN_WORD}{_HELD if tail else ''}])" if head else ""
            after = f"(?![{_IN_WORD}{_HELD if head else ''}])" if tail else ""
            return F.regexp_instr(held, F.lit(before + _HELD + after))

        spot = F.when(opens & closes, at(True, True)).when(opens, at(True, False)).when(closes, at(False, True)).otherwise(at(False, False))
        return let(spot, lambda k: F.when(k > 0, k + (F.length(literal) - 1) * F.regexp_count(F.substring(held, F.lit(1), k - 1), F.lit(_HELD))).otherwise(0))

    quoted = F.regexp_replace(literal, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    own = F.regexp_instr(text, F.concat(F.when(opens, rf"(?<!{_WORD})").otherwise(""), quoted, F.when(closes, rf"(?!{_WORD})").otherwise("")))
    plain = F.when(F.contains(text, F.lit(_HELD)), own).otherwise(let(placed(F.replace(text, literal, F.lit(_HELD))), lambda k: F.when(k > 0, k).otherwise(own)))
    return F.when(F.length(literal) > 0, F.when(F.contains(text, literal), plain).otherwise(0)).otherwise(0)


def byte_offset(text: Column, chars: Column) -> Column:
    """UTF-8 bytes before a 0-based character offset."""
    return F.octet_length(F.substring(text, F.lit(1), chars))


NUMBER_TOKEN = r"(?<![\p{L}_\d.,])[-\x{2212}]?\d+(?:(?:[.,]|[ '\x{a0}\x{2009}\x{202f}\x{2019}](?=\d{3}(?!\d)))\d+)*"


def number_tokens(text: Column) -> Column:
    """Every printed number of a text, as it stands."""
    return F.regexp_extract_all(text, F.lit(NUMBER_TOKEN), F.lit(0))


def numbers_in(text: Column) -> Column:
    """array<struct<t, v, before, after>>: every printed number, its readings, and up to 8 characters on either side of it, to the next numbers."""

    def placed(tokens: Column) -> Column:
        return let(F.split(text, NUMBER_TOKEN, -1), lambda gaps: F.transform(tokens, lambda t, i: F.struct(t.alias("t"), number_readings(t).alias("v"), F.right(F.get(gaps, i), F.lit(8)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(8)).alias("after"))))

    return let(number_tokens(text), placed)


def number_readings(token: Column) -> Column:
    """All values a printed number can have: the last separator as decimal point, and as grouping where groups allow it."""

    def read(bare: Column) -> Column:
        decimal = F.when(bare.rlike(r"^-?(\d+|\d+([.,]\d{2,3})*[.,]\d{3})[.,]\d+$"), F.concat(F.regexp_replace(F.regexp_extract(bare, r"^(.*)[.,]\d+$", 1), "[.,]", ""), F.lit("."), F.regexp_extract(bare, r"[.,](\d+)$", 1)).cast("double"))
        grouped = F.when(bare.rlike(r"^-?\d+([.,]\d{2,3})*[.,]\d{3}$"), F.regexp_replace(bare, "[.,]", "").cast("double"))
        whole = F.when(bare.rlike(r"^-?\d+$"), bare.cast("double"))
        return F.array_distinct(F.array_compact(F.array(whole, decimal, grouped)))

    return let(F.regexp_replace(F.regexp_replace(token, r"[ '\x{a0}\x{2009}\x{202f}\x{2019}]", ""), r"\x{2212}", "-"), read)


def nearly(a: Column, b: Column) -> Column:
    """Equal to nine digits."""
    return F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
