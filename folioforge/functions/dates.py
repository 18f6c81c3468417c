"""Dates and times out of printed text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.expr import chain, let

# Month names and the short forms that are read.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
CLOCK = r"\s(\d{1,2}):(\d{2})(?::(\d{2})(\.\d{1,9})?)?\s?(am|pm|a\.m\.|p\.m\.)?\s?(z|utc|gmt|ut|[+\-]\d{2}:?(?:\d{2})?)?$"
PIVOT = 69  # two-digit years from here on are of the 1900s


def _part(t: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(t, pattern, group)


def _year(y: Column) -> Column:
    n = F.try_to_number(y, F.lit("9999")).cast("int")
    return F.when(F.length(y) == 4, n).when(F.length(y) == 2, F.when(n >= PIVOT, 1900 + n).otherwise(2000 + n))


def _month(name: Column) -> Column:
    short = F.substring(name, 1, 3)
    return F.coalesce(*[F.when(short == m[:3], F.lit(k)) for k, m in enumerate(MONTHS, 1)])


def _date(y: Column, m: Column, d: Column) -> Column:
    """A date, or NULL where there is none such."""
    return F.to_date(F.try_make_timestamp(y, m.cast("int"), d.cast("int"), F.lit(0), F.lit(0), F.lit(0)))


def _number(c: Column) -> Column:
    return F.when(c.rlike(r"^\d+$"), c.cast("int"))


def read_date(c: Column, order: str = "") -> Column:
    """struct<value date, ambiguous boolean, day_first date, month_first date, seconds double, zone_minutes int> of a text; NULL if it is no date.

    Four-digit years in front are year, month, day. Otherwise a part over 12 settles day and month, as does `order`
    (dmy or mdy); ymd does not settle d/m/y. What stays open has a NULL value and both readings.
    """
    clock = CLOCK

    def read(x: Column) -> Column:
        t, body = x["t"], x["body"]
        hour, minute, second = _number(_part(t, clock, 1)), _number(_part(t, clock, 2)), F.coalesce(_number(_part(t, clock, 3)), F.lit(0))
        half = F.substring(_part(t, clock, 5), 1, 1)
        hour24 = F.when(half == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
        clocked = t.rlike(clock)
        sound = ~clocked | ((hour24 <= 23) & (minute <= 59) & (second <= 60))
        seconds = F.when(clocked, hour24 * 3600 + minute * 60 + second + F.coalesce(F.when(_part(t, clock, 4) != "", F.concat(F.lit("0"), _part(t, clock, 4)).cast("double")), F.lit(0.0)))
        offset = _part(t, clock, 6)
        zone = F.when(offset.rlike(r"^[+\-]"), F.when(offset.startswith("-"), -1).otherwise(1) * (_number(F.substring(offset, 2, 2)) * 60 + F.coalesce(_number(F.regexp_extract(offset, r"^.\d{2}:?(\d{2})$", 1)), F.lit(0)))).when(offset != "", 0)
        ymd = r"^(\d{4})([-/. ])(\d{1,2})\2(\d{1,2})$"
        compact = r"^(\d{4})(\d{2})(\d{2})$"
        named = [  # pattern, then groups of year, month name, day
            (rf"^{_DAY}(?: of)?[ \-./]({_MONTH})[ \-./](\d{{4}}|\d{{2}})$", 3, 2, 1),
            (rf"^({_MONTH})[ \-./]{_DAY}[ \-./](\d{{4}}|\d{{2}})$", 3, 1, 2),
            (rf"^(\d{{4}})[ \-./]{_DAY}[ \-./]({_MONTH})$", 1, 3, 2),
            (rf"^(\d{{4}})[ \-./]({_MONTH})[ \-./]{_DAY}$", 1, 2, 3),
        ]
        numeric = r"^(\d{1,2})([-/. \\])(\d{1,2})\2(\d{4}|\d{2})$"
        a, b, y = _number(_part(body, numeric, 1)), _number(_part(body, numeric, 3)), _year(_part(body, numeric, 4))
        by_day, by_month = _date(y, b, a), _date(y, a, b)
        open_ = body.rlike(numeric) & (a <= 12) & (b <= 12) & (a != b) & F.lit(order not in ("dmy", "mdy"))
        settled = by_day if order == "dmy" else by_month if order == "mdy" else F.when(a > 12, by_day).when(b > 12, by_month).when(a == b, by_day)
        if order in ("dmy", "mdy"):
            settled = F.coalesce(settled, F.when(a > 12, by_day), F.when(b > 12, by_month))
        value = F.coalesce(
            F.when(body.rlike(ymd), _date(_year(_part(body, ymd, 1)), _number(_part(body, ymd, 3)), _number(_part(body, ymd, 4)))),
            F.when(body.rlike(compact), _date(_year(_part(body, compact, 1)), _number(_part(body, compact, 2)), _number(_part(body, compact, 3)))),
            *[F.when(body.rlike(p), _date(_year(_part(body, p, gy)), _month(_part(body, p, gm)), _number(_part(body, p, gd)))) for p, gy, gm, gd in named],
            F.when(body.rlike(numeric) & ~open_, settled),
        )
        made = lambda v: F.struct(
            F.when(sound, v).alias("value"), F.coalesce(open_, F.lit(False)).alias("ambiguous"), F.when(open_, by_day).alias("day_first"), F.when(open_, by_month).alias("month_first"),
            seconds.alias("seconds"), zone.cast("int").alias("zone_minutes"),
        )
        return let(value, lambda v: F.when(sound & (v.isNotNull() | open_), made(v)))

    whole = F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"[,\s]+", " "), r"(?<=\d)[Tt](?=\d)", " ")))
    return chain(whole, lambda t: F.struct(t.alias("t"), F.regexp_replace(t, clock, "").alias("body")), read)


def read_timestamp(c: Column, order: str = "") -> Column:
    """The instant in UTC (microseconds; finer digits are cut), midnight where no clock is printed."""
    return let(read_date(c, order), instant)


def instant(d: Column) -> Column:
    """The instant of what read_date() gives."""
    shift = F.coalesce(d["seconds"], F.lit(0.0)) - F.coalesce(d["zone_minutes"], F.lit(0)) * 60
    return F.timestamp_micros(F.unix_micros(d["value"].cast("timestamp")) + F.floor(shift * 1_000_000).cast("bigint"))


# The spoken days of a month.
ORDINALS = (
    "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth "
    "twenty-first twenty-second twenty-third twenty-fourth twenty-fifth twenty-sixth twenty-seventh twenty-eighth twenty-ninth thirtieth thirty-first"
).split()
_SPOKEN = r"(?:\d{1,2}(?:st|nd|rd|th)?|" + "|".join(x.replace("-", "[- ]") for x in reversed(ORDINALS)) + ")"
_DIGITS = r"\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2(?:\d{4}|\d{2})"
WRITTEN = rf"(?<![\p{{L}}\p{{Nd}}_])(?:{_DIGITS}|{_SPOKEN}(?: of)?,? {_MONTH},? \d{{2,4}}|{_MONTH} {_SPOKEN},? \d{{2,4}})(?![\p{{L}}\p{{Nd}}_])"


def written_dates(folded: Column, order: str = "") -> Column:
    """array<array<int>>: the readings, as yyyymmdd, of every date that stands in a folded text.

    Digits with the year in front, or behind a day and a month in `order` (dmy, mdy, or either way round), and days as digits,
    ordinals or words beside a month's name. Years of two digits are 1969 to 2068.
    """
    full = lambda y: F.when(F.length(y) > 2, y.cast("int")).otherwise(y.cast("int") + F.when(y.cast("int") <= 68, 2000).otherwise(1900))
    made = lambda y, m, d: y * 10000 + m * 100 + d

    def read(t: Column) -> Column:
        def digits(p: Column) -> Column:
            a, b, c = (F.get(p, F.lit(k)) for k in range(3))
            day_first, month_first = made(full(c), b.cast("int"), a.cast("int")), made(full(c), a.cast("int"), b.cast("int"))
            behind = F.array(day_first) if order == "dmy" else F.array(month_first) if order == "mdy" else F.array(day_first, month_first)
            return F.when(F.length(a) == 4, F.array(made(a.cast("int"), b.cast("int"), c.cast("int")))).otherwise(behind)

        name = F.regexp_extract(t, rf"(?<!\p{{L}}){_MONTH}", 0)
        month = F.floor((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.substring(name, 1, 3)) + 2) / 3).cast("int")
        day_text = F.regexp_extract(F.replace(t, name, F.lit("")), rf"^\s*({_SPOKEN})", 1)
        day = F.coalesce(F.nullif(F.regexp_extract(day_text, r"^\d+", 0), F.lit("")).cast("int"), F.array_position(F.array(*[F.lit(x) for x in ORDINALS]), F.replace(day_text, F.lit(" "), F.lit("-"))).cast("int"))
        return F.when(t.rlike(r"^\d+[-/.]\d+[-/.]\d+$"), let(F.split(t, "[-/.]"), digits)).otherwise(F.array(made(full(F.regexp_extract(t, r"(\d+)$", 1)), month, day)))

    return F.transform(F.regexp_extract_all(folded, F.lit(WRITTEN), F.lit(0)), read)
