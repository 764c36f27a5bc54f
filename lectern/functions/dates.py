"""Date functions. Each takes ``as_of``, the day that counts as today; none reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import col
from lectern.functions.vocabulary import MONTHS, SERVICE_WEEKDAYS, WEEKDAYS


#: What stands for a date that can't be read. Fixed value.
UNKNOWN = "Unknown Date"


def _choice(c: Column, of: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, n in of.items():
        out = F.when(c == name, F.lit(n)).otherwise(out)
    return out


def ymd(y: Column, m: Column, d: Column) -> Column:
    """The date, or null where there is none."""
    return F.try_to_date(F.concat_ws("-", y.cast("string"), m.cast("string"), d.cast("string")), "y-M-d")


def service_date(as_of: Column) -> Column:
    """The latest day of service that is not after ``as_of``."""
    back = [F.pmod(F.weekday(as_of) - F.lit(w), F.lit(7)) for w in SERVICE_WEEKDAYS]
    return F.date_sub(as_of, F.least(*back))


def resolve_date(expr: Column | str, as_of: Column) -> Column:
    """The day that a phrase names: "last sunday", "most recent sermon", "may 18 2025".

    "last" leaves ``as_of`` out and "this" looks back too and takes it in; a day without year is
    the latest that isn't in the future. Null where the phrase names none. A month in "last
    month" is no weekday. The 29th of February needs a year.
    """
    e = F.lower(F.trim(col(expr)))
    e = F.regexp_replace(F.regexp_replace(e, r"\b(most recent|recent|latest)\b", "last"), r"\bpast\b", "last")
    day = r"^(last|this)\s+(monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tue|wed|thu|fri|sat|sun)\b"
    since = F.pmod(F.weekday(as_of) - _choice(F.regexp_extract(e, day, 2), WEEKDAYS), F.lit(7))
    since = F.when((F.regexp_extract(e, day, 1) == "last") & (since == 0), 7).otherwise(since)
    iso, full, short = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^([a-z]+)\s+(\d{1,2}),?\s+(\d{4})$", r"^([a-z]+)\s+(\d{1,2})$"
    part = lambda p, i: F.regexp_extract(e, p, i)
    names = {k: v for k, v in MONTHS.items() if k != "sept"}
    here = ymd(F.year(as_of), _choice(part(short, 1), names), part(short, 2))
    leap = (_choice(part(short, 1), names) == 2) & (part(short, 2).try_cast("int") == 29)
    here = F.when(~leap, F.when(here <= as_of, here).otherwise(ymd(F.year(as_of) - 1, _choice(part(short, 1), names), part(short, 2))))
    return (
        F.when(F.coalesce(e, F.lit("")) == "", None)
        .when(F.rlike(e, F.lit(r"\blast\s+(service|message|sermon)\b")), service_date(as_of))
        .when(F.rlike(e, F.lit(day)), F.date_sub(as_of, since))
        .when(F.rlike(e, F.lit(iso)), ymd(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(F.rlike(e, F.lit(full)), ymd(part(full, 3), _choice(part(full, 1), names), part(full, 2)))
        .when(F.rlike(e, F.lit(short)), here)
    )


def resolve_range(expr: Column | str, as_of: Column) -> Column:
    """(first, last) of "last week", "this month", "may 2023" and the like; null otherwise.

    A month without year is its latest occurrence, and no range ends after ``as_of``: one that
    lies in the future is empty, its first day after its last.
    """
    e = F.lower(F.trim(col(expr)))
    monday, first = F.to_date(F.date_trunc("week", as_of)), F.to_date(F.date_trunc("month", as_of))
    names = "|".join(sorted(MONTHS, key=len, reverse=True))
    m = _choice(F.regexp_extract(e, rf"\b({names})\b", 1), MONTHS)
    y = F.regexp_extract(e, r"\b(\d{4})\b", 1).try_cast("int")
    y = F.coalesce(y, F.when(m > F.month(as_of), F.year(as_of) - 1).otherwise(F.year(as_of)))
    start = ymd(y, m, F.lit(1))
    span = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    return (
        F.when(F.contains(e, F.lit("last week")), span(F.date_sub(monday, 7), F.date_sub(monday, 1)))
        .when(F.contains(e, F.lit("this week")), span(monday, as_of))
        .when(F.contains(e, F.lit("last month")), span(F.to_date(F.add_months(first, -1)), F.date_sub(first, 1)))
        .when(F.contains(e, F.lit("this month")), span(first, as_of))
        .when(m.isNotNull() & start.isNotNull(), span(start, F.least(F.last_day(start), as_of)))
    )


def date_number(d: Column) -> Column:
    """yyyymmdd as a number."""
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def number_date(n: Column) -> Column:
    """The date of a yyyymmdd number; null where there is none."""
    i = n.cast("int")
    return F.when(i > 0, ymd(F.lpad((i / 10000).cast("int").cast("string"), 4, "0"), (i / 100).cast("int") % 100, i % 100))


def iso_date(c: Column | str) -> Column:
    """The date of a yyyy-mm-dd string; null for anything else, sentinels included."""
    return F.when(F.rlike(col(c), F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(col(c), "yyyy-MM-dd"))


def date_hint(d: Column) -> Column:
    return F.date_format(d, "MMMM d yyyy")


def range_hint(a: Column, b: Column) -> Column:
    """"May 2023" for a whole month, otherwise both days."""
    whole = (F.dayofmonth(a) == 1) & (b == F.last_day(a))
    return F.when(whole, F.date_format(a, "MMMM yyyy")).otherwise(F.concat(date_hint(a), F.lit(" to "), date_hint(b)))


def normalise_date(c: Column | str) -> Column:
    """yyyy-mm-dd of a date found in a transcript, or "Unknown Date".

    Numbers are month first, unless that gives no date.
    """
    s = F.regexp_replace(F.regexp_replace(col(c), r"(?i)(\d)(st|nd|rd|th)\b", "$1"), r"[.]", "/")
    num, name = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"(?i)^([a-z]+)\s+(\d{1,2}),?\s+(\d{4})$"
    p = lambda r, i: F.regexp_extract(s, r, i)
    d = F.coalesce(ymd(p(num, 3), p(num, 1), p(num, 2)), ymd(p(num, 3), p(num, 2), p(num, 1)), ymd(p(name, 3), _choice(F.lower(p(name, 1)), MONTHS), p(name, 2)))
    return F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit(UNKNOWN))


def derived_dates(c: Column | str) -> list[Column]:
    """year, date_numeric and day_of_week of a date string; 0, 0 and '' where it is none."""
    d = iso_date(c)
    return [
        F.coalesce(F.year(d), F.lit(0)).alias("year"),
        F.coalesce(date_number(d), F.lit(0)).alias("date_numeric"),
        F.coalesce(F.lower(F.date_format(d, "EEEE")), F.lit("")).alias("day_of_week"),
    ]
