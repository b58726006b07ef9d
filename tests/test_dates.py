"""A table of phrases with the days they cover on Wednesday 2024-03-13."""

import datetime

from pyspark.sql import functions as F

from tidegraph.functions import dates as T

CASES = """
today|2024-03-13|2024-03-13
now|2024-03-13|2024-03-13
yesterday|2024-03-12|2024-03-12
the day before yesterday|2024-03-11|2024-03-11
3 days ago|2024-03-10|2024-03-10
three days ago|2024-03-10|2024-03-10
a week ago|2024-03-06|2024-03-06
2 weeks ago|2024-02-28|2024-02-28
one month ago|2024-02-13|2024-02-13
a quarter ago|2023-12-13|2023-12-13
two years ago|2022-03-13|2022-03-13
last week|2024-03-06|2024-03-12
past 10 days|2024-03-03|2024-03-12
last month|2024-02-13|2024-03-13
previous three months|2023-12-13|2024-03-13
last quarter|2023-12-13|2024-03-13
last year|2023-03-13|2024-03-13
this week|2024-03-11|2024-03-13
this month|2024-03-01|2024-03-13
this quarter|2024-01-01|2024-03-13
current year|2024-01-01|2024-03-13
year to date|2024-01-01|2024-03-13
YTD|2024-01-01|2024-03-13
2024-02-29|2024-02-29|2024-02-29
2023-02-29||
2024/2/9|2024-02-09|2024-02-09
02/09/2024|2024-02-09|2024-02-09
2-9-24|2024-02-09|2024-02-09
3/5|2024-03-05|2024-03-05
11/30|2023-11-30|2023-11-30
November 2024|2024-11-01|2024-11-30
Feb. 2024|2024-02-01|2024-02-29
2024-02|2024-02-01|2024-02-29
March 5th, 2024|2024-03-05|2024-03-05
Sept 1, 2022|2022-09-01|2022-09-01
5 March 2024|2024-03-05|2024-03-05
the 2nd of May 2021|2021-05-02|2021-05-02
February 30 2024||
March 5|2024-03-05|2024-03-05
December 25|2023-12-25|2023-12-25
in January|2024-01-01|2024-01-31
in October|2023-10-01|2023-10-31
March|2024-03-01|2024-03-31
early January 2024|2024-01-01|2024-01-10
mid-January 2024|2024-01-11|2024-01-20
late February|2024-02-21|2024-02-29
Q1 2024|2024-01-01|2024-03-31
q4|2023-10-01|2023-12-31
first quarter of 2023|2023-01-01|2023-03-31
3rd quarter|2023-07-01|2023-09-30
in 2023|2023-01-01|2023-12-31
since January|2024-01-01|2024-03-13
since March 1, 2024|2024-03-01|2024-03-13
after 2024-02-29|2024-03-01|2024-03-13
after Q3 2023|2023-10-01|2024-03-13
until last week||2024-03-12
before March 2024||2024-02-29
up to 2023||2023-12-31
between 2024-01-05 and 2024-02-05|2024-01-05|2024-02-05
from January to February|2024-01-01|2024-02-29
between Q1 2023 and Q2 2023|2023-01-01|2023-06-30
from 3 weeks ago through yesterday|2024-02-21|2024-03-12
since nothing||
soon||
"""


def test_phrases(spark):
    rows = [line.split("|") for line in CASES.strip().split("\n")]
    day = lambda s: datetime.date.fromisoformat(s) if s else None
    today = F.lit("2024-03-13").cast("date")
    df = spark.createDataFrame([(p,) for p, _, _ in rows], "p string").select("p", T.date_range(F.col("p"), today).alias("r"), T.expressions(F.concat(F.lit("What of it "), "p", F.lit(" then?"))).alias("found"))
    got = {r.p: r for r in df.collect()}
    assert {p: (r.r and r.r.start, r.r and r.r.end) for p, r in got.items()} == {p: (day(a), day(b)) for p, a, b in rows}
    for p, a, b in rows:
        if (a or b) and p not in ("March", "q4"):
            bare = p.removeprefix("in ").removeprefix("the 2nd").strip() or p
            assert got[p].found and (got[p].found[0] in p) and len(got[p].found[0]) >= min(len(bare), len(p)) - 4, (p, got[p].found)
    text = spark.createDataFrame([("It may march on; marching 12 units, 3/4 inch, in May 2020, or 1999 things",), (None,), ("",)], "t string")
    assert [r.e for r in text.select(T.expressions(F.col("t")).alias("e")).collect()] == [["3/4", "May 2020"], None, []]
