"""Queries of the graph's views, counts and changes, with their SQL.

Stand-ins as in `search`: orders are events and their chunks, lineitem mentions, shocks, evidence, impacts and channels. The old
graph lacks orders of status P and knows other confidences for F; the new one lacks orders of the lowest priority.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators import graph as G
from tidegraph.plans.catalogue import Tables, query


def views(t: Tables, old: bool) -> dict[str, DataFrame]:
    orders = t.orders.where("o_orderstatus <> 'P'" if old else "o_orderpriority <> '5-LOW'")
    item = t.lineitem.withColumns({"event_id": F.col("l_orderkey"), "at": F.col("l_orderkey") * 10 + F.col("l_linenumber")})
    period = F.when(F.col("o_custkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise("")
    chunks = orders.select(F.col("o_orderkey").alias("chunk_id"), period.alias("period_key"), F.col("o_orderdate").cast("date").alias("published"))
    confidence = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(F.col("o_totalprice")) if old else F.col("o_totalprice")
    events = orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("event_type"), confidence.alias("confidence"))
    mentions = item.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("display_name"), F.nullif("l_returnflag", F.lit("N")).alias("entity_type"), F.lit(None).cast("string").alias("ticker"))
    impacts = item.select(F.col("at").alias("impact_id"), "event_id", F.col("l_returnflag").alias("target_type"), F.col("l_suppkey").cast("string").alias("target_id"), F.col("l_linestatus").alias("direction"), F.col("l_quantity").alias("strength"))
    channels = item.select("event_id", F.concat(F.lit(" "), "l_returnflag").alias("channel_name"), F.col("l_linestatus").alias("direction"), F.col("l_quantity").alias("strength"), F.lit(None).cast("double").alias("confidence"))
    return G.graph_views(chunks, mentions, events, item.select("event_id", F.col("l_linestatus").alias("shock_type")), item.select("event_id", F.col("at").alias("evidence_id"), F.lit("").alias("evidence_text")), impacts, channels)


def _sql(p: str, where: str, confidence: str) -> str:
    """CTEs p_<view>(k, h): keys and the other columns, both as text."""
    return f"""{p}o as materialized (select *, {confidence} as conf, case when o_custkey % 5 <> 0 then strftime(o_orderdate, '%Y-%m') else '' end as period from orders where {where}),
  {p}e as materialized (select o.o_orderkey as e, period, concat_ws('|', cast(o_orderdate as date), o_orderpriority, conf, s.t, s.i) as h from {p}o o left join (
    select l_orderkey as k, string_agg(l_linestatus, ',' order by l_linestatus) as t, min(l_orderkey * 10 + l_linenumber) as i from lineitem group by 1) s on s.k = o.o_orderkey where period <> ''),
  {p}periods as (select distinct period as k, '' as h from {p}o where period <> ''),
  {p}entities as (select l_partkey::varchar as k, coalesce(max(nullif(l_returnflag, 'N')), '') as h from lineitem group by l_partkey),
  {p}macro_events as (select e::varchar as k, period || h as h from {p}e), {p}assets as (select distinct lower(l_returnflag) || ':' || l_suppkey as k, '' as h from lineitem),
  {p}channels as (select distinct lower(l_returnflag) as k, '' as h from lineitem), {p}in_period as (select e || '|' || period as k, '' as h from {p}e),
  {p}impacts as (select k, h from (select l_orderkey * 10 + l_linenumber as k, l_orderkey || '|' || l_linestatus || '|' || l_quantity || '|' || lower(l_returnflag) || l_suppkey as h,
    row_number() over (partition by l_orderkey * 10 + l_linenumber order by l_orderkey desc, l_linestatus desc, l_quantity desc, lower(l_returnflag) || ':' || l_suppkey desc) as rn from lineitem where l_orderkey in (select e from {p}e)) where rn = 1),
  {p}involves as (select distinct l_orderkey || '|' || l_partkey as k, '' as h from lineitem where l_orderkey in (select e from {p}e)),
  {p}transmits_via as (select l_orderkey || '|' || lower(l_returnflag) as k, max((l_linestatus, l_quantity))::varchar as h from lineitem where l_orderkey in (select e from {p}e) group by 1)"""


_OLD = _sql("a_", "o_orderstatus <> 'P'", "case when o_orderstatus = 'F' then 1.0 else o_totalprice end")
_NEW = _sql("b_", "o_orderpriority <> '5-LOW'", "o_totalprice")


@query(f"with {_NEW} " + " union all ".join(f"select '{v}' as view, count(*) as n from b_{v}" for v in G.COUNTED))
def graph_counts(t):
    return G.graph_counts(views(t, False))


@query(f"with {_OLD}, {_NEW}, d as (" + " union all ".join(f"select '{v}' as view, case when a.k is null then 'insert' when b.k is null then 'delete' else 'update' end as op from a_{v} a full join b_{v} b on a.k::varchar = b.k::varchar where a.k is null or b.k is null or a.h <> b.h" for v in G.KEYS) + ") select view, op, count(*) as n from d group by all")
def graph_changes(t):
    """What a sync from the old graph to the new one writes and removes, view by view."""
    found = G.graph_changes(views(t, True), views(t, False))
    rows = [d.select(F.lit(name).alias("view"), "op") for name, d in found.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("view", "op").agg(F.count("*").alias("n"))
