"""Queries of normalised model responses, with their SQL.

Responses are made of the documents: one or two events each, whose enum fields are allowed values, values that lack their last
letter, or nothing like one, dealt by the text's size; summary and spans are words of the text. Some responses have a tail
that doesn't parse, some are cut short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators import normalise as N
from tidegraph.plans.catalogue import Tables, query


def _value(values, n, odd):
    """The n-th value, without its last letter where odd % 3 = 1, `zq` where it is 2."""
    v = F.get(F.array(*[F.lit(x) for x in values]), (n % len(values)).cast("int"))
    return F.when(odd % 3 == 0, v).when(odd % 3 == 1, v.substr(F.lit(1), F.length(v) - 1)).otherwise(F.lit("zq"))


def responses(t: Tables) -> DataFrame:
    n, d, zero = F.coalesce("n_chars", F.lit(0)), F.col("doc_id"), F.lit(0)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x20]+"), F.lit(0))
    text = lambda at, k: F.array_join(F.slice("w", at, k), " ")

    def event(k: int):
        x = n + k
        channel = lambda j: F.struct(_value(N.MACRO_CHANNELS, x + j, d + j).alias("channel_name"), _value(N.DIRECTIONS, x, d).alias("direction"), _value(N.STRENGTHS, x + j, zero).alias("strength"))
        impact = lambda j: F.struct(F.lit("ticker").alias("target_type"), F.when(d % 5 != j, text(1 + j, 1)).alias("target_id"), _value(N.DIRECTIONS, x + j, zero).alias("direction"), _value(N.STRENGTHS, x, zero + 1).alias("strength"), _value(N.HORIZONS, x, d + j).alias("horizon"), text(1, 2).alias("rationale"))
        return F.struct(
            _value(N.SHOCK_TYPES, x, d + k).alias("event_type"), F.array(_value(N.SHOCK_TYPES, x, zero), _value(N.SHOCK_TYPES, x + 1, d)).alias("shock_types"), text(1 + k, 5).alias("summary"), _value(N.HORIZONS, x + 1, d + 1).alias("time_horizon"),
            ((x % 100) / 100).alias("confidence"), F.array(channel(0), channel(1), channel(12)).alias("channels"), F.array(impact(0), impact(1)).alias("asset_impacts"), F.array(text(1, 3), text(2, 3), text(1, 3)).alias("evidence_spans"),
        )

    rows = t.documents.select("doc_id", "n_chars", words.alias("w"))
    json = F.to_json(F.struct(F.when(n % 2 == 0, F.array(event(0), event(1))).otherwise(F.array(event(0))).alias("events")))
    raw = F.when(d % 11 == 3, F.concat(json, F.lit(' and {"more": "'))).when(d % 13 == 5, F.substring(json, 1, 40)).otherwise(json)
    return rows.select(d.alias("run_id"), (d % 400).alias("article_id"), d.alias("chunk_id"), (d % 19 != 7).alias("success"), raw.alias("raw_json"), F.lit("timeout").alias("error_text"))


def tables(t: Tables) -> dict[str, DataFrame]:
    return N.normalise(responses(t).where("success"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sql_value(values, n: str, odd: str) -> str:
    v = f"{_list(values)}[({n}) % {len(values)} + 1]"
    return f"case ({odd}) % 3 when 0 then {v} when 1 then substr({v}, 1, length({v}) - 1) else 'zq' end"


def _sql_clean(values, n: str, odd: str) -> str:
    """What the value should become: itself again, as one letter less is closest to it."""
    return f"case when ({odd}) % 3 < 2 then {_list(values)}[({n}) % {len(values)} + 1] end"


def _sql_action(odd: str) -> str:
    return f"['kept', 'snapped', 'dropped'][({odd}) % 3 + 1]"


_BASE = rf"""w as (select doc_id as d, coalesce(n_chars, 0) as n, regexp_extract_all(coalesce(text, ''), '[^\x00-\x20]+') as w from documents),
  ev as materialized (select *, n + idx as x, md5(d || '::' || idx) as event_id from (select *, unnest(case when n % 2 = 0 then [0, 1] else [0] end) as idx from w)
    where d % 19 <> 7 and (d % 11 = 3 or d % 13 <> 5)),
  ch as (select *, unnest([0, 1, 12]) as j from ev), im as (select *, unnest([0, 1]) as j, array_to_string(w[1 + j : 1 + j], ' ') as target from ev),
  channels as materialized (select *, row_number() over (partition by event_id, channel_name order by j) as rn from (
    select event_id, j, {_sql_clean(N.MACRO_CHANNELS, 'x + j', 'd + j')} as channel_name, {_sql_clean(N.DIRECTIONS, 'x', 'd')} as direction, {_sql_clean(N.STRENGTHS, 'x + j', '0')} as strength from ch)
    where channel_name is not null and direction is not null),
  impacts as materialized (select *, row_number() over (partition by event_id, target_id order by j) as rn from (
    select event_id, j, x, w, target as target_id, {_sql_clean(N.DIRECTIONS, 'x + j', '0')} as direction, {_sql_clean(N.STRENGTHS, 'x', '1')} as strength, {_sql_clean(N.HORIZONS, 'x', 'd + j')} as horizon, d from im)
    where d % 5 <> j and target_id <> '' and horizon is not null),
  fields as materialized (select d, event_id, idx, 'macro_event' as kind, 'event_type' as label, {_sql_value(N.SHOCK_TYPES, 'x', 'd + idx')} as raw, {_sql_clean(N.SHOCK_TYPES, 'x', 'd + idx')} as value, {_sql_action('d + idx')} as action, '0:0:0' as place from ev
    union all select d, event_id, idx, 'macro_event', 'shock_types', {_sql_value(N.SHOCK_TYPES, 'x', '0')}, {_sql_clean(N.SHOCK_TYPES, 'x', '0')}, 'kept', '1:0:0' from ev
    union all select d, event_id, idx, 'macro_event', 'shock_types', {_sql_value(N.SHOCK_TYPES, 'x + 1', 'd')}, {_sql_clean(N.SHOCK_TYPES, 'x + 1', 'd')}, {_sql_action('d')}, '1:1:0' from ev
    union all select d, event_id, idx, 'macro_event', 'time_horizon', {_sql_value(N.HORIZONS, 'x + 1', 'd + 1')}, {_sql_clean(N.HORIZONS, 'x + 1', 'd + 1')}, {_sql_action('d + 1')}, '2:0:0' from ev
    union all select d, event_id, idx, 'channel', 'channel_name', {_sql_value(N.MACRO_CHANNELS, 'x + j', 'd + j')}, {_sql_clean(N.MACRO_CHANNELS, 'x + j', 'd + j')}, {_sql_action('d + j')}, '3:' || least(j, 2) || ':0' from ch
    union all select d, event_id, idx, 'channel', 'direction', {_sql_value(N.DIRECTIONS, 'x', 'd')}, {_sql_clean(N.DIRECTIONS, 'x', 'd')}, {_sql_action('d')}, '3:' || least(j, 2) || ':1' from ch
    union all select d, event_id, idx, 'channel', 'strength', {_sql_value(N.STRENGTHS, 'x + j', '0')}, {_sql_clean(N.STRENGTHS, 'x + j', '0')}, 'kept', '3:' || least(j, 2) || ':2' from ch
    union all select d, event_id, idx, 'asset_impact', 'direction', {_sql_value(N.DIRECTIONS, 'x + j', '0')}, {_sql_clean(N.DIRECTIONS, 'x + j', '0')}, 'kept', '4:' || j || ':0' from im
    union all select d, event_id, idx, 'asset_impact', 'strength', {_sql_value(N.STRENGTHS, 'x', '1')}, {_sql_clean(N.STRENGTHS, 'x', '1')}, 'snapped', '4:' || j || ':1' from im
    union all select d, event_id, idx, 'asset_impact', 'horizon', {_sql_value(N.HORIZONS, 'x', 'd + j')}, {_sql_clean(N.HORIZONS, 'x', 'd + j')}, {_sql_action('d + j')}, '4:' || j || ':2' from im)"""


@query(f"""with {_BASE} select event_id, d as run_id, d % 400 as article_id, d as chunk_id, coalesce({_sql_clean(N.SHOCK_TYPES, 'x', 'd + idx')}, '') as event_type, array_to_string(w[1 + idx : 5 + idx], ' ') as summary, '' as region,
  coalesce({_sql_clean(N.HORIZONS, 'x + 1', 'd + 1')}, '') as time_horizon, (x % 100) / 100 as confidence from ev""")
def normalised_events(t):
    return tables(t)["events"]


@query(f"with {_BASE} select md5(event_id || '::' || channel_name) as channel_id, event_id, channel_name, direction, strength from channels where rn = 1")
def normalised_channels(t):
    return tables(t)["channels"].drop("confidence")


@query(f"""with {_BASE} select md5(event_id || '::' || target_id) as impact_id, event_id, 'ticker' as target_type, target_id, direction, strength, horizon, (x % 100) / 100 as confidence, array_to_string(w[1:2], ' ') as rationale
  from impacts where rn = 1""")
def normalised_impacts(t):
    return tables(t)["impacts"]


@query(f"with {_BASE} select distinct event_id, value as shock_type from fields where label = 'shock_types' and value is not null")
def normalised_shocks(t):
    return tables(t)["shock_types"]


@query(f"""with {_BASE}, s as (select d, idx, event_id, unnest([1, 2]) as a, array_to_string(w[a : a + 2], ' ') as evidence_text from ev),
  r as (select *, row_number() over (partition by d, evidence_text order by idx, a) as rn from s)
  select md5(d || '::' || evidence_text) as evidence_id, d as run_id, event_id as parent_id, evidence_text from r where rn = 1""")
def normalised_evidence(t):
    return tables(t)["evidence"].select("evidence_id", "run_id", "parent_id", "evidence_text")


@query(f"with {_BASE} select md5(event_id || '::' || place) as audit_id, d as run_id, cast(idx as int) as macro_event_index, kind as parent_kind, label as field_label, raw as raw_value, value as normalized_value, action from fields")
def normalised_audit(t):
    """A row for every enum field, kept ones too."""
    return tables(t)["audit"]


@query(f"""with {_BASE}, f as (select d, bool_or(action = 'dropped') as dropped, bool_or(action = 'snapped') as snapped from fields group by 1),
  n as (select d, bool_or(event_id not in (select event_id from impacts)) as bare, bool_or(event_id not in (select event_id from channels)) as mute, count(*) as events from ev group by 1),
  r as (select w.d, case when w.d % 23 = 0 then 'prefilter_skipped' when w.d % 19 = 7 then 'api_failed' when w.d % 11 <> 3 and w.d % 13 = 5 then 'parse_failed' else 'events_written' end as status, f.*, n.* from w left join f on f.d = w.d left join n on n.d = w.d)
  select d as chunk_id, status, case status when 'api_failed' then 'timeout' when 'parse_failed' then 'the response is no object' end as failure_reason, cast(case when status = 'events_written' then events end as int) as event_count,
    case when status = 'events_written' then concat_ws(',', case when dropped then 'enum_value_dropped' end, case when snapped then 'enum_value_snapped' end, case when bare then 'event_without_asset_impacts' end, case when mute then 'event_without_channels' end)
      when status = 'prefilter_skipped' then '' else status end as reasons from r""")
def normalised_outcomes(t):
    """Outcomes of the chunks by what is left of their events."""
    rows = t.documents.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 23 == 0, "prefilter_skipped").alias("status"), F.lit(4).alias("macro_score"), F.lit(False).alias("was_hard"))
    out = N.processing_audit(rows, responses(t), tables(t))
    return out.select("chunk_id", "status", "failure_reason", "event_count", F.array_join("reasons", ",").alias("reasons"))
