"""Calendar-date normalisation of free-form date strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import bind, strip

MONTH = (
    "(?:january|february|march|april|may|june|july|august|september|october|november|december"
    "|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)"
)
WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+)?"
ZONE = r"(?:\s*(?:z|utc|gmt|[ecmp][sd]t|[+-][0-9]{2}:?[0-9]{2}|[+-][0-9]{2}))?"
CLOCK = (
    r"(?:(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:[.,][0-9]+)?)?(?:\s*[ap]m)?"
    r"|(?:1[0-2]|0?[1-9])\s*[ap]m)" + ZONE
)
AFTER = rf"(?:(?:\s*t\s*|,?\s+|,?\s+at\s+|\s+-\s+){CLOCK}|t(?:[01][0-9]|2[0-3]){ZONE})?"
BEFORE = rf"(?:{CLOCK},?\s+)?"
DAY = r"([0-9]{1,2})(?:st|nd|rd|th)?"

# (pattern, group of the year, of the month, of the day); the first that matches the whole text wins.
NUMERIC_FORMS = (
    (rf"([0-9]{{4}})([-/.])([0-9]{{1,2}})\2([0-9]{{1,2}}){AFTER}", 1, 3, 4),
    (r"([0-9]{4})([0-9]{2})([0-9]{2})(?:t?[0-9]{6}|t[0-9]{4})?" + ZONE, 1, 2, 3),
    # Day first only where the first number cannot be a month.
    (rf"(1[3-9]|2[0-9]|3[01])([-/.])([0-9]{{1,2}})\2([0-9]{{4}}){AFTER}", 4, 3, 1),
    (rf"([0-9]{{1,2}})([-/.])([0-9]{{1,2}})\2([0-9]{{4}}){AFTER}", 4, 1, 3),
    (rf"(1[3-9]|2[0-9]|3[01])([-/.])([0-9]{{1,2}})\2([0-9]{{2}}){AFTER}", 4, 3, 1),
    (rf"([0-9]{{1,2}})([-/.])([0-9]{{1,2}})\2([0-9]{{2}}){AFTER}", 4, 1, 3),
)
NAMED_FORMS = (
    (rf"{BEFORE}{WEEKDAY}{DAY}(?:\s+of)?[\s-]+({MONTH})\.?,?[\s-]+([0-9]{{4}}|[0-9]{{2}}){AFTER}", 3, 2, 1),
    (rf"{BEFORE}{WEEKDAY}({MONTH})\.?[\s-]+{DAY},?[\s-]+([0-9]{{4}}){AFTER}", 3, 1, 2),
    (rf"{BEFORE}([0-9]{{4}})[\s-]+({MONTH})\.?[\s-]+{DAY}{AFTER}", 1, 2, 3),
    (rf"{WEEKDAY}({MONTH})\s+{DAY}\s+{CLOCK}\s+([0-9]{{4}})", 3, 1, 2),
)


def _month_number(name: Column) -> Column:
    at = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.substring(name, 1, 3))
    return ((at + F.lit(2)) / F.lit(3)).cast("int").cast("string")


# Two digits stand for a year of this century below this number, and of the last one from it on.
PIVOT = 76


def _year(digits: Column) -> Column:
    century = F.when(digits.cast("int") < PIVOT, "20").otherwise("19")
    return F.when(F.length(digits) == 2, F.concat(century, digits)).otherwise(digits)


def normalize_date(text: Column) -> Column:
    """``YYYY-MM-DD`` of the calendar date written in ``text``, or ``text`` itself.

    The written date is kept whatever the zone says. Ambiguous numeric dates are month-first; years of two digits are read
    by PIVOT. Texts without year, month and day stay as they are: completing them would depend on the current day.
    """

    def parsed(low: Column) -> Column:
        found = []
        for forms, month_of in ((NUMERIC_FORMS, lambda month: month), (NAMED_FORMS, _month_number)):
            for pattern, year, month, day in forms:
                whole = rf"^{pattern}\z"
                part = [F.regexp_extract(low, whole, group) for group in (year, month, day)]
                iso = F.concat_ws("-", _year(part[0]), F.lpad(month_of(part[1]), 2, "0"), F.lpad(part[2], 2, "0"))
                found.append(F.when(low.rlike(whole), F.try_to_date(iso, "yyyy-MM-dd")))
        return F.coalesce(*found)

    date = bind(F.lower(strip(text)), parsed)
    return F.when(text.rlike("[0-9]{2}"), F.coalesce(F.date_format(date, "yyyy-MM-dd"), text)).otherwise(text)
