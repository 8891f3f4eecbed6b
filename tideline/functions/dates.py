"""Dates, read day first: in running text by three patterns tried in order, and as whole fields in many notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import collapse

YEAR = "(?:19|20)[0-9]{2}"
NUMERIC = rf"(?iU)\b([0-9]{{1,2}})[/-]([0-9]{{1,2}})[/-]({YEAR})\b"
NAMED = rf"(?iU)\b([0-9]{{1,2}})\s+((?:jan|feb|mar|apr|may|jun|jul|aug|sept|sep|oct|nov|dec)[a-z]*)\s+({YEAR})\b"
ISO = rf"(?iU)\b({YEAR})-([0-9]{{1,2}})-([0-9]{{1,2}})\b"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date, or NULL if there is no such day; the parts are strings."""
    return F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")).try_cast("date")


def _number(s: Column) -> Column:
    return s.try_cast("int")


def day_first(year: Column, first: Column, second: Column) -> Column:
    """``first`` is the day unless ``second`` can't be a month; then they change places."""
    return F.when(_number(second) <= 12, _date(year, second, first)).otherwise(_date(year, first, second))


def numeric_date(text: Column) -> Column:
    g = [F.regexp_extract(text, NUMERIC, i) for i in (1, 2, 3)]
    return F.when(g[0] != "", day_first(g[2], g[0], g[1]))


def named_date(text: Column) -> Column:
    g = [F.regexp_extract(text, NAMED, i) for i in (1, 2, 3)]
    return F.when(g[0] != "", _date(g[2], _month_number(g[1]), g[0]))


def iso_date(text: Column, iso_dayfirst: bool = True) -> Column:
    """Year first. By default the second number is the day where it can be; ``iso_dayfirst=False`` reads true ISO dates."""
    g = [F.regexp_extract(text, ISO, i) for i in (1, 2, 3)]
    return F.when(g[0] != "", day_first(g[0], g[1], g[2]) if iso_dayfirst else _date(g[0], g[1], g[2]))


_MONTH = r"((?:jan|feb|mar|apr|may|jun|jul|aug|sept|sep|oct|nov|dec)[a-z]*)"
_SEP = r"[-/., ]"
#: What may stand around the date of a field: the day of the week, and a time of day with its zone.
_BEFORE = r"^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[,. ]+)?"
_AFTER = r"(?:(?:t|[ ,]+)[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?(?: ?[ap]m)?(?: ?(?:z|utc|gmt|[+-][0-9]{2}:?[0-9]{2}))?)?$"
#: Notation -> the groups of year, then of month and day; two numbers beside a year are read day first.
_FIELDS = [
    (rf"([0-9]{{1,2}}){_SEP}([0-9]{{1,2}}){_SEP}([0-9]{{4}}|[0-9]{{2}})", "day_first"),
    (rf"([0-9]{{4}}){_SEP}([0-9]{{1,2}}){_SEP}([0-9]{{1,2}})", "year_first"),
    (rf"([0-9]{{1,2}})(?:st|nd|rd|th)?{_SEP}*{_MONTH}{_SEP}*([0-9]{{4}}|[0-9]{{2}})", "day_name"),
    (rf"{_MONTH}{_SEP}*([0-9]{{1,2}})(?:st|nd|rd|th)?{_SEP}+([0-9]{{4}})", "name_day"),
    (rf"([0-9]{{4}}){_SEP}*{_MONTH}{_SEP}*([0-9]{{1,2}})", "year_name"),
    (r"([0-9]{4})([0-9]{2})([0-9]{2})(?:t?[0-9]{6})?", "compact"),
    (rf"{_MONTH}{_SEP}*([0-9]{{4}})()", "name_year"),
    (r"([0-9]{4})[-/.]([0-9]{1,2})()", "year_month"),
]


def _month_number(word: Column) -> Column:
    numbers = {n: str(i) for i, name in enumerate(MONTHS, 1) for n in (name, name[:3])} | {"sept": "9"}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), F.lower(word))


def _four_digits(year: Column) -> Column:
    """Two digits are a year from 1969 to 2068."""
    return F.when(F.length(year) == 2, F.concat(F.when(year < "69", "20").otherwise("19"), year)).otherwise(year)


def field_date(text: Column, iso_dayfirst: bool = True) -> Column:
    """The date of a field that holds a date and perhaps a time, and nothing else; NULL for anything else.

    Numbers are read day first, after a year too unless ``iso_dayfirst`` is false; the time and its zone don't move the date.
    """
    t = collapse(text)
    out = []
    for pattern, kind in _FIELDS:
        rx = rf"(?i){_BEFORE}{pattern}{_AFTER}"
        a, b, c = (F.regexp_extract(t, rx, i) for i in (1, 2, 3))
        found = {
            "day_first": lambda: day_first(_four_digits(c), a, b),
            "year_first": lambda: day_first(a, b, c) if iso_dayfirst else _date(a, b, c),
            "day_name": lambda: _date(_four_digits(c), _month_number(b), a),
            "name_day": lambda: _date(c, _month_number(a), b),
            "year_name": lambda: _date(a, _month_number(b), c),
            "compact": lambda: _date(a, b, c),
            "name_year": lambda: _date(b, _month_number(a), F.lit("1")),
            "year_month": lambda: _date(a, b, F.lit("1")),
        }[kind]()
        out.append(F.when(a != "", found))
    return F.coalesce(*out)


def extract_date(text: Column, iso_dayfirst: bool = True) -> Column:
    """The first match of each pattern is tried, in order; a match that is no date goes on to the next pattern."""
    return F.coalesce(numeric_date(text), named_date(text), iso_date(text, iso_dayfirst))
