"""Column functions over dates: period keys, parsing, ranges, recency."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_key(d: Column, granularity: str = "month") -> Column:
    """2024-11, 2024-W46 (ISO) or 2024-Q4."""
    if granularity == "month":
        return F.date_format(d, "yyyy-MM")
    if granularity == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    if granularity == "quarter":
        return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))
    raise ValueError(f"granularity: {granularity!r}")


def parse_published(raw: Column) -> Column:
    """ISO 8601 with or without zone, a plain date, compact stamps, or RFC 822; null if nothing fits."""
    text = F.trim(raw)
    bare = F.regexp_replace(text, "^[A-Za-z]{3}, *", "")
    forms = [(text, f) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd'T'HHmmss", "yyyyMMdd'T'HHmm")]
    forms += [(bare, "d MMM yyyy HH:mm:ss Z"), (bare, "d MMM yyyy HH:mm:ss zzz")]
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for c, f in forms])


def period_range(start: Column, end: Column, granularity: str = "month") -> Column:
    """Array of the keys of every period that the days from start to end touch."""
    unit, step = {"month": ("month", "1 month"), "week": ("week", "7 days"), "quarter": ("quarter", "3 months")}[granularity]
    days = F.sequence(F.date_trunc(unit, start).cast("date"), F.date_trunc(unit, end).cast("date"), F.expr(f"interval {step}"))
    return F.when(start <= end, F.transform(days, lambda d: period_key(d, granularity)))


def recency(age_days: Column, half_life: float) -> Column:
    """A true half-life."""
    return F.exp(-math.log(2) * age_days / half_life)


def recency_fold(age_days: Column, days: float) -> Column:
    """Falls by e over the given days: the summary ranking's form."""
    return F.exp(-age_days / days)


def relative_range(phrase: Column, today: Column) -> Column:
    """struct<start, end> of a relative phrase, or null."""
    p = F.lower(F.trim(phrase))
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    monday, first = F.date_trunc("week", today).cast("date"), F.date_trunc("month", today).cast("date")
    return (
        F.when(p == "yesterday", pair(F.date_sub(today, 1), F.date_sub(today, 1))).when(p == "today", pair(today, today))
        .when(p == "last week", pair(F.date_sub(today, 7), F.date_sub(today, 1))).when(p == "this week", pair(monday, today))
        .when(p == "last month", pair(F.add_months(today, -1), today)).when(p == "this month", pair(first, today))
    )
