"""Free-form datetimes in text: a grammar of layouts as column expressions.

A value is a date (year first, or day and month in either order, or a month's name before
or after the day), then maybe a time (24 hours or AM/PM, fractions), then maybe a zone.
Each kind of date is one pattern that rewrites the value into ``year|month|day|...``, so a
value costs one replacement. Whether 03/04/2024 is in March or April is decided for a whole
column, by which order fits more of its values (``day_first``), in one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.functions.columns import q

# English month names; three letters, or "sept", stand for them.
MONTHS = "january february march april may june july august september october november december".split()

_WEEKDAY = r"^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_TIME = r"(?:(?:\s*T|,?\s+|\s+at\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([ap]\.?m\.?)?)?"
_ZONE = r"\s*(z|utc|gmt|[+-]\d{2}:?(?:\d{2})?)?$"
_REST = "".join(f"|${i}" for i in range(4, 10))
_SUFFIX = r"(?:st|nd|rd|th)?"

#: kind -> (pattern, replacement); the first three fields are in the order of the kind's name.
LAYOUTS = {
    "ymd": (_WEEKDAY + r"(\d{4})(?:[-/.]|\s+)(\d{1,2})(?:[-/.]|\s+)(\d{1,2})" + _TIME + _ZONE, "$1|$2|$3" + _REST),
    "number": (_WEEKDAY + r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + _TIME + _ZONE, "$3|$1|$2" + _REST),
    "name": (_WEEKDAY + r"([a-z]{3,9})\.?\s+(\d{1,2})" + _SUFFIX + r",?\s+(\d{4})" + _TIME + _ZONE, "$3|$1|$2" + _REST),
    "day": (_WEEKDAY + r"(\d{1,2})" + _SUFFIX + r"[\s-]+([a-z]{3,9})\.?,?[\s-]+(\d{4})" + _TIME + _ZONE, "$3|$2|$1" + _REST),
    "year": (_WEEKDAY + r"(\d{4})[\s-]+([a-z]{3,9})\.?[\s-]+(\d{1,2})" + _TIME + _ZONE, "$1|$2|$3" + _REST),
}


def _text(c: Column) -> Column:
    return F.trim(c.cast("string"))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _fields(c: Column) -> Column:
    """Kind and fields of a value as an array; null where no layout fits.

    Every layout begins with a letter or digit and has four digits in a row and 8 characters at least: other text is
    spared the layouts' patterns.
    """
    text, out = _text(c), None
    for kind, (pattern, fields) in LAYOUTS.items():
        fits, found = text.rlike("(?i)" + pattern), F.regexp_replace(text, "(?i)" + pattern, f"{kind}|{fields}")
        out = F.when(fits, found) if out is None else out.when(fits, found)
    likely = (F.length(text) >= 8) & text.rlike(r"(?s)^[0-9A-Za-z].*(?<![0-9])[0-9]{4}|^[0-9]{4}")
    return F.split(F.when(likely, out), r"\|")


def _month(word: Column) -> Column:
    """1 to 12 for a number or a name; else null."""
    low = F.lower(word)
    long = F.array_position(F.array(*map(F.lit, MONTHS)), low)
    short = F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.when(low == "sept", "sep").otherwise(low))
    return F.coalesce(word.try_cast("int"), F.nullif(F.greatest(long, short), F.lit(0)).cast("int"))


def _made(parts: Column, day_first: bool) -> Column:
    """The timestamp of a value's fields, null where no such time exists."""
    kind, year, second, third, hour, minute, sec, fraction, half, zone = (F.get(parts, F.lit(i)) for i in range(10))
    swapped = (kind == "number") & F.lit(day_first)
    month, day = F.when(swapped, third).otherwise(second), F.when(swapped, second).otherwise(third)
    h = F.when(hour == "", 0).otherwise(F.coalesce(hour.try_cast("int"), F.lit(0)))
    clock = F.when(h.between(1, 12), h % 12 + F.when(F.lower(half).startswith("p"), 12).otherwise(0))
    secs = F.concat(F.when(sec == "", "0").otherwise(sec), F.lit("."), F.rpad(F.substring(fraction, 1, 6), 6, "0")).try_cast("decimal(8,6)")
    digits = F.regexp_replace(zone, "[^0-9]", "")
    offset = F.concat(F.substring(zone, 1, 1), F.substring(digits, 1, 2), F.lit(":"), F.rpad(F.substring(digits, 3, 2), 2, "0"))
    # an offset beyond 18 hours is no zone
    known = F.when(zone.rlike("^[+-]"), F.when(F.substring(digits, 1, 2).try_cast("int") < 18, offset)).otherwise(F.lit("+00:00"))
    values = F.struct(
        year.try_cast("int").alias("y"), _month(month).alias("m"), day.try_cast("int").alias("d"),
        F.when(half == "", h).otherwise(clock).alias("h"), F.when(minute == "", 0).otherwise(F.coalesce(minute.try_cast("int"), F.lit(0))).alias("i"), secs.alias("s"),
        (zone == "").alias("here"), known.alias("zone"),
    )

    def stamp(v: Column) -> Column:
        given = [v[n] for n in "ymdhis"]
        local = F.try_make_timestamp(*given)
        return F.when(v["here"], local).when(local.isNotNull() & v["zone"].isNotNull(), F.try_make_timestamp(*given, v["zone"]))

    return _once(values, stamp)


def parse_datetime(c: Column, day_first: bool = False) -> Column:
    """Text to timestamp; null where no layout fits or no such day or time exists."""
    return _once(_fields(c), lambda parts: _made(parts, day_first))


def readings(c: Column) -> Column:
    """(other, month_first, day_first): whether a value is a time whatever the order, and in either order; null where
    no layout fits."""

    def flags(parts: Column) -> Column:
        number = F.get(parts, F.lit(0)) == "number"
        month = F.coalesce(_made(parts, False).isNotNull(), F.lit(False))
        day = F.coalesce(F.when(number, _made(parts, True).isNotNull()), F.lit(False))  # other kinds have one order
        found = F.struct((month & ~number).alias("other"), (month & number).alias("month_first"), day.alias("day_first"))
        return F.when(parts.isNotNull(), found)

    return _once(_fields(c), flags)


def day_first(df: DataFrame, cols: Sequence[str]) -> Collection[str]:
    """The columns whose values are dates with the day first more often than with the month first; one scan."""
    if not cols:
        return []
    read = df.select(*(readings(q(c)).alias(f"r{i}") for i, c in enumerate(cols)))
    counts = [F.count_if(f"r{i}.{n}").alias(f"{n}{i}") for i in range(len(cols)) for n in ("month_first", "day_first")]
    row = read.agg(*counts).first()
    return [c for i, c in enumerate(cols) if row[f"day_first{i}"] > row[f"month_first{i}"]]
