"""Date expressions in questions as columns: what they are, and the days they cover by a given today.

A small grammar, evaluated by Spark's own functions:

    range  = "between"|"from" point "and"|"to"|"through" point | "since"|"after"|"until"|"till"|"before"|"up to" point | point
    point  = day | month | quarter | year | relative

A named month, quarter or year covers all its days. Without a year the latest one that has begun is meant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
ORDINALS = ("first", "second", "third", "fourth")

_MONTH = "(?:" + "|".join(MONTHS) + r"|jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec)\b\.?"
_FULL = "(" + "|".join(MONTHS) + ")"
_NUMBER = r"(?:\d{1,3}|an?|" + "|".join(NUMBERS) + ")"
_UNIT = "(?:day|week|month|quarter|year)s?"
_DAY = r"\d{1,2}(?:st|nd|rd|th)?(?!\d)"
_BEFORE = r"(?<=\b(?:in|on|since|until|till|before|after|from|to|and|during|by|of|through|between)\s{1,3})"
_POINT = "(?:" + "|".join([
    r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", r"\d{1,2}[-/]\d{1,2}[-/](?:\d{4}|\d{2})(?!\d)", rf"(?:early|mid|late)[\s-]+{_MONTH}(?:,?\s+\d{{4}})?", rf"{_MONTH}\s+{_DAY}(?:,?\s+\d{{4}})?", rf"\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?{_MONTH}(?:,?\s+\d{{4}})?",
    rf"{_MONTH},?\s+\d{{4}}", rf"{_BEFORE}{_MONTH}", r"q[1-4](?:,?\s+(?:of\s+)?\d{4})?", rf"(?:{'|'.join(ORDINALS)}|[1-4](?:st|nd|rd|th))\s+quarter(?:,?\s+(?:of\s+)?\d{{4}})?",
    rf"{_NUMBER}\s+{_UNIT}\s+ago", rf"(?:last|past|previous)\s+(?:{_NUMBER}\s+)?{_UNIT}", rf"(?:this|current)\s+{_UNIT}", r"(?:the\s+)?day\s+before\s+yesterday", "yesterday", "today", "now", r"year\s+to\s+date", "ytd",
    r"\d{4}[-/]\d{2}(?!\d)", r"\d{1,2}/\d{1,2}(?!\d)", rf"{_BEFORE}(?:19|20)\d{{2}}(?!\d)",
]) + ")"
#: Every date expression of a text, the longest reading first.
EXPRESSION = rf"(?i)\b(?:(?:between|from)\s+(?:the\s+)?{_POINT}\s+(?:and|to|through)\s+(?:the\s+)?{_POINT}|(?:since|after|until|till|before|up\s+to)\s+(?:the\s+)?{_POINT}|{_POINT})"


def expressions(text: Column) -> Column:
    """The date expressions of a text, in order."""
    return F.regexp_extract_all(text, F.lit(EXPRESSION), F.lit(0))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed, and standing in the plan, once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _plain(phrase: Column) -> Column:
    """Lower case, single spaces, digits for number words, full month names, no commas, ordinal endings or articles."""
    p = F.regexp_replace(F.regexp_replace(F.lower(phrase), r"[,?!]|\.(?=\s|$)", " "), r"(\d)(st|nd|rd|th)\b", "$1")
    p = F.regexp_replace(p, r"\bthe\b|\bof\b", " ")
    for i, w in enumerate(NUMBERS):
        p = F.regexp_replace(p, rf"\b{w}\b", str(i + 1))
    for i, w in enumerate(ORDINALS):
        p = F.regexp_replace(p, rf"\b{w}\b(?=\s+quarter)", str(i + 1))
    for m in MONTHS:
        short = "sept?" if m == "september" else m[:3]
        p = F.regexp_replace(p, rf"\b{short}\b", m) if m != "may" else p
    p = F.regexp_replace(p, r"\ban?\b(?=\s+(?:day|week|month|quarter|year))", "1")
    return F.trim(F.regexp_replace(p, r"\s+", " "))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string")), F.lit("yyyy-M-d")).cast("date")


def _shift(today: Column, n: Column, unit: Column) -> Column:
    """today, n units before."""
    months = F.when(unit == "month", 1).when(unit == "quarter", 3).otherwise(12)
    return F.when(unit == "day", F.date_sub(today, n)).when(unit == "week", F.date_sub(today, n * 7)).otherwise(F.add_months(today, -n * months))


def _point(p: Column, today: Column) -> Column:
    """struct<start, end> of one point in plain words; null if it is none."""
    part = lambda pattern, i: F.nullif(F.regexp_extract(p, f"^{pattern}$", i), F.lit(""))
    number = lambda pattern, i: part(pattern, i).try_cast("int")
    name = lambda pattern, i: F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), part(pattern, i)), F.lit(0)).cast("int")
    pair = lambda a, b: F.struct(a.cast("date").alias("start"), b.cast("date").alias("end"))
    this_year, one = F.year(today), F.lit(1)

    def latest(year: Column, month: Column, day: Column) -> Column:
        """The date in the given year, or the latest that isn't after today."""
        here = F.when(year.isNotNull(), _date(year, month, day)).otherwise(_date(this_year, month, day))
        return let(here, lambda d: F.when(year.isNull() & (d > today), _date(this_year - 1, month, day)).otherwise(d))

    def span(first: Column, end: Callable[[Column], Column]) -> Column:
        return let(first, lambda d: F.when(d.isNotNull(), pair(d, end(d))))

    def one_day(d: Column) -> Column:
        return span(d, lambda x: x)

    out = []
    for word, back in (("yesterday", 1), ("today", 0), ("now", 0), ("day before yesterday", 2)):
        out.append(F.when(p == word, pair(F.date_sub(today, back), F.date_sub(today, back))))
    ago = r"(\d+) (day|week|month|quarter|year)s? ago"
    out.append(one_day(_shift(today, number(ago, 1), part(ago, 2))))
    last = r"(?:last|past|previous) (?:(\d+) )?(day|week|month|quarter|year)s?"
    unit = part(last, 2)
    out.append(F.when(unit.isNotNull(), pair(_shift(today, F.coalesce(number(last, 1), one), unit), F.when(unit.isin("day", "week"), F.date_sub(today, 1)).otherwise(today))))
    for u in ("week", "month", "quarter", "year"):
        out.append(F.when(p.rlike(f"^(this|current) {u}$") if u != "year" else p.rlike("^((this|current) year|year to date|ytd)$"), pair(F.date_trunc(u, today), today)))
    out.append(F.when(p.rlike("^(this|current) day$"), pair(today, today)))
    iso, us, short = r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", r"(\d{1,2})[-/](\d{1,2})[-/](\d{4}|\d{2})", r"(\d{1,2})/(\d{1,2})"
    out.append(one_day(_date(number(iso, 1), number(iso, 2), number(iso, 3))))
    year = number(us, 3)
    out.append(one_day(_date(F.when(year < 100, year + 2000).otherwise(year), number(us, 1), number(us, 2))))
    out.append(F.when(p.rlike(f"^{short}$"), one_day(latest(F.lit(None).cast("int"), number(short, 1), number(short, 2)))))
    for pattern, m, d, y in ((rf"{_FULL} (\d{{1,2}})(?: (\d{{4}}))?", 1, 2, 3), (rf"(\d{{1,2}}) {_FULL}(?: (\d{{4}}))?", 2, 1, 3)):
        out.append(one_day(F.when(name(pattern, m).isNotNull(), latest(number(pattern, y), name(pattern, m), number(pattern, d)))))
    month = rf"{_FULL}(?: (\d{{4}}))?"
    out.append(span(F.when(name(month, 1).isNotNull(), latest(number(month, 2), name(month, 1), one)), F.last_day))
    dashed = r"(\d{4})[-/](\d{2})"
    out.append(span(_date(number(dashed, 1), number(dashed, 2), one), F.last_day))
    third = rf"(early|mid|late)[ -]{_FULL}(?: (\d{{4}}))?"
    first, which = F.when(name(third, 2).isNotNull(), latest(number(third, 3), name(third, 2), one)), part(third, 1)
    from_day = F.when(which == "early", 0).when(which == "mid", 10).otherwise(20)
    out.append(let(first, lambda d: F.when(d.isNotNull(), pair(F.date_add(d, from_day), F.when(which == "late", F.last_day(d)).otherwise(F.date_add(d, from_day + 9))))))
    for quarter in (r"q([1-4])(?: (\d{4}))?", r"([1-4]) quarter(?: (\d{4}))?"):
        q = number(quarter, 1)
        out.append(span(F.when(q.isNotNull(), latest(number(quarter, 2), q * 3 - 2, one)), lambda d: F.date_sub(F.add_months(d, 3), 1)))
    year = number("((?:19|20)\\d{2})", 1)
    out.append(span(_date(year, one, one), lambda d: F.date_sub(F.add_months(d, 12), 1)))
    return F.coalesce(*out)


def date_range(phrase: Column, today: Column) -> Column:
    """struct<start, end>, the days of a date expression by today; an open side is null, as is what is no expression."""
    two, one = r"^(?:between|from) (.+?) (?:and|to|through) (.+)$", r"^(since|after|until|till|before|up to) (.+)$"
    part = lambda p, pattern, i: F.nullif(F.regexp_extract(p, pattern, i), F.lit(""))
    none = F.lit(None).cast("date")
    pair = lambda s, e: F.struct(s.alias("start"), e.alias("end"))

    def ranged(p: Column) -> Column:
        points = F.transform(F.array(part(p, two, 1), part(p, two, 2), part(p, one, 2), p), lambda q: _point(q, today))
        word = part(p, one, 1)

        def joined(v: Column) -> Column:
            a, b, x = v[0], v[1], v[2]
            return (
                F.when(a.isNotNull() & b.isNotNull(), pair(a["start"], b["end"])).when(word.isNotNull() & x.isNull(), None).when(word == "since", pair(x["start"], today)).when(word == "after", pair(F.date_add(x["end"], 1), today))
                .when(word == "before", pair(none, F.date_sub(x["start"], 1))).when(word.isNotNull(), pair(none, x["end"])).otherwise(v[3])
            )

        return let(points, joined)

    return let(F.regexp_replace(_plain(phrase), "^(?:in|on|during|for|over) ", ""), ranged)
