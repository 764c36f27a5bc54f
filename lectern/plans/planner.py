"""From a question to a retrieval plan. A plan is a small value; nothing runs here."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lectern.functions import dates
from lectern.operators import filters

#: Results by default and for broad questions. Fixed values.
N, N_BROAD = 7, 12


@dataclass
class Rewrite:
    """What a question asks for; a language model may fill it in instead of ``rewrite``."""

    query: str
    date_expression: str | None = None
    date_range: str | None = None
    year: int | None = None
    day_of_week: str | None = None
    recency: str | None = None
    n: int | None = None
    listing_intent: bool = False
    assumption: str | None = None


@dataclass
class Plan:
    """n results under ``where``; if that finds nothing, under each of ``fallbacks`` in turn."""

    n: int = N
    where: dict | None = None
    fallbacks: list[dict | None] = field(default_factory=list)
    listing: bool = False
    recency_weight: float = 0.0
    #: The day or span in words, searched for along with the question.
    hint: str | None = None


DAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"


def rewrite(message: str, history: list[str] | None = None) -> Rewrite:
    """A rewrite by rules: dates, weekdays, years and the wish for a list, as the words say it."""
    low = message.lower()
    out = Rewrite(message.strip())
    if m := re.search(rf"\b(?:last|past)\s+(\d+)\s+({DAYS})s?\b", low):
        out.recency, out.n, out.day_of_week = "last_n", int(m[1]), m[2]
    elif m := re.search(rf"\b(?:latest|most recent|newest)\b(?:.*?\b({DAYS})\b)?", low):
        out.recency, out.day_of_week = "latest", m[1]
    elif m := re.search(rf"\b(?:last|this|past)\s+(?:{DAYS})\b|\b\d{{4}}-\d\d-\d\d\b|\b[a-z]+ \d{{1,2}},? \d{{4}}\b", low):
        out.date_expression = m[0]
    elif m := re.search(r"\b(?:last|this)\s+(?:week|month)\b", low):
        out.date_range = m[0]
    elif m := re.search(r"\b(?:in|during|from)\s+((?:19|20)\d\d)\b", low):
        out.year = int(m[1])
    elif m := re.search(r"\bin\s+((?:january|february|march|april|may|june|july|august|september|october|november|december)(?:\s+\d{4})?)\b", low):
        out.date_range = m[1]
    if out.day_of_week is None and (m := re.search(rf"\b({DAYS})\s+(?:sermons?|messages?|services?)\b", low)):
        out.day_of_week = m[1]
    out.listing_intent = bool(re.search(r"\b(?:list|which|what)\b.*\b(?:sermons|messages|lessons)\b", low))
    return out


def source_kind(message: str, history: list[str] | None = None) -> str | None:
    """'sermon' or 'lesson' by the message, else by the newest of the last six turns that tells."""
    for t in [message, *reversed((history or [])[-6:])]:
        low = (t or "").lower()
        if re.search(r"\bsermon\b|\bmessage\b", low):
            return "sermon"
        if re.search(r"\blesson\b", low):
            return "lesson"
    return None


def _resolved(spark: SparkSession, as_of: dt.date, r: Rewrite) -> tuple:
    """The phrase's day, its range and the last service, by the same columns as in batch."""
    day = F.lit(as_of.isoformat()).cast("date")
    span = dates.resolve_range(F.lit(r.date_range).cast("string"), day)
    one = dates.resolve_date(F.lit(r.date_expression).cast("string"), day)
    hints = F.coalesce(dates.range_hint(span["first"], span["last"]), dates.date_hint(one))
    row = spark.range(1).select(dates.resolve_date(F.lit(r.date_expression).cast("string"), day).alias("d"), dates.resolve_range(F.lit(r.date_range).cast("string"), day).alias("r"), dates.service_date(day).alias("s"), hints.alias("h")).first()
    return row.d, row.r, row.s, row.h


def number(d: dt.date) -> int:
    return d.year * 10000 + d.month * 100 + d.day


def plan(spark: SparkSession, r: Rewrite, as_of: dt.date, kind: str | None = None, latest=lambda day, n: []) -> Plan:
    """The plan of a rewritten question. ``latest(day, n)`` gives the n latest stored dates
    (yyyymmdd) of a weekday, newest first.

    A lesson has no weekday, so a question about lessons drops it; a weekday without a source
    means sermons.
    """
    day_name = None if kind == "lesson" else r.day_of_week
    if day_name and kind is None:
        kind = "sermon"
    base = filters.merge_filters(filters.source_filter(kind), filters.weekday_filter(day_name))
    day, span, service, hint = _resolved(spark, as_of, r)
    within = filters.range_filter(number(span["first"]), number(span["last"])) if span else None
    weight = 0.4 if r.recency else 0.2 if r.date_range else 0.0
    both = lambda *f: filters.merge_filters(base, *f)
    if r.listing_intent and (r.year or within):
        return Plan(N_BROAD, both(filters.year_filter(r.year), within), [both()], True, weight)
    if r.recency == "latest" and day_name:
        newest = latest(day_name, 1)
        return Plan(N, both(filters.day_filter(newest[0] if newest else None)), [both()], False, weight)
    if r.recency == "latest":
        return Plan(N, both(filters.day_filter(number(service))), [both(), None], False, weight)
    if r.recency == "last_n" and day_name and r.n:
        days = latest(day_name, r.n)
        return Plan(N_BROAD, both(filters.range_filter(days[-1], days[0])) if days else both(), [], False, weight)
    if r.year:
        return Plan(N_BROAD, both(filters.year_filter(r.year)), [], False, weight)
    if within:
        return Plan(N_BROAD, both(within), [both()], False, weight, hint)
    if day is not None:
        return Plan(N, both(filters.day_filter(number(day))), [both()], False, weight, hint)
    return Plan(N, base, [], False, weight)


