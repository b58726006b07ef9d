"""Queries of date expressions and of sessions, with their SQL.

Orders' dates, written in twelve ways, are the expressions; conversations, some after another in one session, its turns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.functions import dates as T
from tidegraph.operators import extraction as E
from tidegraph.operators.retrieval import REFERENCES, SAME_PERIOD
from tidegraph.plans.catalogue import query
from tidegraph.streaming import sessions as S

TODAY = "2000-06-14"
_FORMS = """case k when 0 then 'on ' || iso when 1 then 'in ' || month || ' ' || y when 2 then 'since ' || month || ' ' || d || ', ' || y when 3 then 'between ' || iso || ' and ' || later when 4 then 'Q' || q || ' ' || y
  when 5 then d || ' ' || month || ' ' || y when 6 then m || '/' || d || '/' || y when 7 then 'until ' || iso when 8 then n || ' days ago' when 9 then 'last ' || n || ' weeks' when 10 then 'before ' || month || ' ' || y else 'in ' || y end"""


@query(f"""with o as (select o_orderkey, o_orderstatus, cast(o_orderdate as date) as day, o_orderkey % 12 as k, 1 + o_custkey % 50 as n from orders),
  f as (select *, cast(date_trunc('month', day) as date) as mon, cast(date_trunc('quarter', day) as date) as quar, cast(date_trunc('year', day) as date) as yr from o)
  select o_orderkey, cast(case k when 0 then day when 1 then mon when 2 then day when 3 then day when 4 then quar when 5 then day when 6 then day when 8 then date '{TODAY}' - cast(n as int) when 9 then date '{TODAY}' - cast(7 * n as int) when 11 then yr end as date) as start_day,
    cast(case k when 0 then day when 1 then last_day(mon) when 2 then date '{TODAY}' when 3 then day + 40 when 4 then quar + interval 3 month - interval 1 day when 5 then day when 6 then day when 7 then day
      when 8 then date '{TODAY}' - cast(n as int) when 9 then date '{TODAY}' - 1 when 10 then mon - 1 else yr + interval 1 year - interval 1 day end as date) as end_day from f""")
def question_time_ranges(t):
    """The period that a question about each order's date asks of."""
    day = F.col("o_orderdate").cast("date")
    parts = t.orders.select(
        "o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 12).alias("k"), day.cast("string").alias("iso"), F.date_add(day, 40).cast("string").alias("later"), F.date_format(day, "MMMM").alias("month"), F.year(day).alias("y"), F.month(day).alias("m"),
        F.dayofmonth(day).alias("d"), F.quarter(day).alias("q"), (1 + F.col("o_custkey") % 50).alias("n"),
    )
    asked = parts.withColumn("question", F.concat(F.lit("What moved prices of "), "o_orderstatus", F.lit(" "), F.expr(_FORMS), F.lit("?")))
    found = E.with_sub_queries(asked.select("o_orderkey", "question"), "question", F.lit(TODAY).cast("date")).select("o_orderkey", F.element_at("ranges", 1).alias("r"))
    return found.select("o_orderkey", F.col("r.start").alias("start_day"), F.col("r.end").alias("end_day"))


@query("""with o as (select distinct cast(o_orderdate as date) as day from orders)
  select cast(day as varchar) as phrase, day as start_day, day as end_day from o""")
def spoken_days(t):
    """Every day of an order, spelled out with its ordinal, back as a day."""
    day = F.col("day")
    end = F.when(F.dayofmonth(day).isin(1, 21, 31), "st").when(F.dayofmonth(day).isin(2, 22), "nd").when(F.dayofmonth(day).isin(3, 23), "rd").otherwise("th")
    said = F.concat(F.lit("the "), F.dayofmonth(day).cast("string"), end, F.lit(" of "), F.date_format(day, "MMM"), F.lit(". "), F.year(day).cast("string"))
    days = t.orders.select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select(day.cast("string").alias("phrase"), T.date_range(said, F.lit(TODAY).cast("date")).alias("r")).select("phrase", F.col("r.start").alias("start_day"), F.col("r.end").alias("end_day"))


@query(rf"""with t as (select conv_id % 7 as s, cast(row_number() over (partition by conv_id % 7 order by conv_id, turn, role) - 1 as int) as i, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') || case when turn % 4 = 1 then ' and its price in the same period' else '' end as query,
    case when turn % 2 = 0 then 'Acme ' || conv_id end as name, case when turn % 3 = 0 then '2024-01-0' || (1 + conv_id % 9) end as a, case when turn % 6 = 0 then '2024-02-01' end as b, text as answer from conversations),
  l as (select s, list('Turn ' || (i + 1) || ': Asked about ' || coalesce(name, 'general query') || ' (' || case when a is not null then a || ' -> ' || coalesce(b, 'None') else 'no time filter' end || '): ' || substr(coalesce(answer, ''), 1, 300) order by i) as lines,
    list(coalesce(name, 'general') || ' (' || coalesce(a, '') || '..' || coalesce(b, '') || ')' order by i) as heads from t group by s),
  w as (select *, last_value(name ignore nulls) over p as last_name, last_value(case when a is not null then {{'a': a, 'b': b}} end ignore nulls) over p as last_days from t window p as (partition by s order by i rows between unbounded preceding and 1 preceding))
  select cast(s as varchar) as session_id, i as turn_index, case when last_name is null then query else regexp_replace(query, '{REFERENCES}', last_name, 'g') end as rewritten,
    case when a is null and regexp_matches(query, '{SAME_PERIOD}') then last_days.a else a end as start, case when a is null and regexp_matches(query, '{SAME_PERIOD}') then last_days.b else b end as "end",
    cast(case when i < 8 then i + 1 else 3 + (i - 8) % 6 end as int) as kept,
    sha256(case when i = 0 then '' else '[CONVERSATION HISTORY]' || case when i >= 9 then chr(10) || 'Earlier in this session: ' || array_to_string(heads[1 : 6 * ((i - 9) // 6 + 1)], chr(10)) else '' end || chr(10) || array_to_string(lines[greatest(i - 2, 1) : i], chr(10)) end) as history
  from w join l using (s)""")
def session_memory(t):
    """Every turn with the session's memory before it: entity and period carried over, last turns, summary of older ones."""
    from pyspark.sql import Window

    c = t.conversations
    n, k, text = F.col("conv_id"), F.col("turn"), F.col("text")
    at = F.row_number().over(Window.partitionBy(n % 7).orderBy("conv_id", "turn", "role")) - 1
    name = F.when(k % 2 == 0, F.concat(F.lit("Acme "), n.cast("string")))
    asked = F.concat(F.regexp_replace(text, r"[^\x00-\x7F]", "x"), F.when(k % 4 == 1, " and its price in the same period").otherwise(""))
    turns = c.select(
        (n % 7).alias("session_id"), at.alias("turn_index"), asked.alias("query"), name.alias("canonical_name"), name.alias("display_name"), F.lit("ORG").alias("entity_type"),
        F.when(k % 3 == 0, F.concat(F.lit("2024-01-0"), (1 + n % 9).cast("string"))).alias("date_start"), F.when(k % 6 == 0, "2024-02-01").alias("date_end"), text.alias("answer"),
    )
    return S.session_turns(turns, digests=True).select("session_id", "turn_index", "rewritten", "start", "end", "kept", "history")
