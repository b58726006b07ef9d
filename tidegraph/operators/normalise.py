"""Model responses as tables: salvage, one variant parse, enums of every field, keyed child tables, audits."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions import text as X
from tidegraph.operators import nlp
from tidegraph.operators.core import cut, top_per_key
from tidegraph.operators.extraction import outcomes
from tidegraph.sources.files import append_new

# The vocabularies of the event fields
SHOCK_TYPES = (
    "energy_supply_disruption", "commodity_supply_disruption", "geopolitical_risk_escalation", "central_bank_hawkish_shift", "central_bank_dovish_shift",
    "inflation_upside_surprise", "inflation_downside_surprise", "growth_upside_surprise", "growth_downside_surprise", "trade_restriction_escalation",
    "banking_stress", "credit_tightening", "fiscal_expansion", "fiscal_contraction", "currency_intervention", "sovereign_risk_event",
)
MACRO_CHANNELS = (
    "risk_off_flow", "liquidity_demand", "rate_differentials", "real_yield_shift", "inflation_expectations_shift", "growth_differentials", "terms_of_trade",
    "commodity_price_shock", "policy_expectations_repricing", "credit_spread_widening", "supply_disruption", "demand_repricing",
)
DIRECTIONS = ("up", "down", "mixed", "unclear")
STRENGTHS = ("weak", "moderate", "strong")
HORIZONS = ("intraday", "near_term", "medium_term", "long_term")
VOCABULARIES = {"shock": SHOCK_TYPES, "channel": MACRO_CHANNELS, "direction": DIRECTIONS, "strength": STRENGTHS, "horizon": HORIZONS}

_CHANNEL = (("channel_name", "channel"), ("direction", "direction"), ("strength", "strength"))
_IMPACT = (("direction", "direction"), ("strength", "strength"), ("horizon", "horizon"))


def salvaged(raw: Column) -> Column:
    """`nlp.repair_json` of each text."""

    @F.pandas_udf("string")
    def salvage(texts: pd.Series) -> pd.Series:
        return texts.map(nlp.repair_json)

    return salvage(raw)


def snapped(vocabulary: Column, raw: Column) -> Column:
    """struct<value, action>: `nlp.snap` of each value by its vocabulary."""

    @F.pandas_udf("struct<value:string,action:string>")
    def one(names: pd.Series, values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([nlp.snap(v, VOCABULARIES[k]) for k, v in zip(names, values, strict=True)], columns=["value", "action"])

    return one(vocabulary, raw)


def repaired(runs: DataFrame) -> DataFrame:
    """runs whose raw_json doesn't parse get the part of it that can be saved; null if there is none. Only those reach Python."""
    parses = F.try_parse_json("raw_json").isNotNull()
    return runs.withColumn("raw_json", F.when(parses, F.col("raw_json")).otherwise(salvaged(F.when(~parses, F.col("raw_json")))))


def _get(v: Column, field: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{field}", kind)


def response_events(runs: DataFrame) -> DataFrame:
    """(run_id, article_id, chunk_id, idx, event_id, ...) of the events in raw_json, an object with an array `events`.

    One parse a response; members that are no objects have null fields, missing arrays are empty. event_id is the digest
    of run and place.
    """
    members = F.try_variant_get(F.try_parse_json("raw_json"), "$.events", "array<variant>")
    rows = runs.select("run_id", "article_id", "chunk_id", F.posexplode(members).alias("idx", "ev"))
    ev = F.col("ev")
    array = lambda field: F.coalesce(_get(ev, field, "array<variant>"), F.array().cast("array<variant>"))
    structs = lambda field, names: F.transform(array(field), lambda x: F.struct(*[_get(x, n).alias(n) for n in names]))
    return rows.select(
        "run_id", "article_id", "chunk_id", "idx", X.stable_key(F.col("run_id").cast("string"), F.col("idx").cast("string")).alias("event_id"),
        *[_get(ev, c).alias(c) for c in ("event_type", "time_horizon")], *[F.coalesce(_get(ev, c), F.lit("")).alias(c) for c in ("summary", "region")], _get(ev, "confidence", "double").alias("confidence"),
        F.transform(array("shock_types"), lambda x: F.try_variant_get(x, "$", "string")).alias("shock_types"), structs("channels", [n for n, _ in _CHANNEL]).alias("channels"),
        structs("asset_impacts", ["target_type", "target_id", "direction", "strength", "horizon", "rationale"]).alias("asset_impacts"),
        F.filter(F.transform(array("evidence_spans"), lambda x: F.try_variant_get(x, "$", "string")), lambda x: x.isNotNull()).alias("evidence_spans"),
    )


def _fields(events: DataFrame) -> DataFrame:
    """A row for each enum field: its place (group, at, part), kind, label, vocabulary and raw value, '' for null."""
    one = lambda g, at, part, kind, label, vocabulary, raw: F.struct(
        F.lit(g).alias("group"), at.cast("int").alias("at"), F.lit(part).alias("part"), F.lit(kind).alias("parent_kind"), F.lit(label).alias("field_label"), F.lit(vocabulary).alias("vocabulary"), F.coalesce(raw, F.lit("")).alias("raw"))
    none = F.lit(0)
    of = lambda g, kind, fields: lambda x, i: F.array(*[one(g, i, p, kind, n, v, x[n]) for p, (n, v) in enumerate(fields)])
    rows = F.concat(
        F.array(one(0, none, 0, "macro_event", "event_type", "shock", F.col("event_type"))), F.transform("shock_types", lambda x, i: one(1, i, 0, "macro_event", "shock_types", "shock", x)),
        F.array(one(2, none, 0, "macro_event", "time_horizon", "horizon", F.col("time_horizon"))), F.flatten(F.transform("channels", of(3, "channel", _CHANNEL))), F.flatten(F.transform("asset_impacts", of(4, "asset_impact", _IMPACT))),
    )
    return events.select("run_id", "idx", "event_id", F.explode(rows).alias("f")).select("run_id", "idx", "event_id", "f.*")


def normalise(runs: DataFrame) -> dict[str, DataFrame]:
    """Tables of runs (run_id, article_id, chunk_id, raw_json): normal, events, shock_types, channels, impacts, evidence, audit.

    Every enum field is kept, snapped to its closest value or dropped, distinct values once; audit has a row for each, kept
    ones too. A channel that loses a field goes, as does an impact that does or has no target. Keys are digests; of rows that
    share one the first stays. normal: a row an event with its clean arrays, from which the others are exploded.
    """
    events = cut(response_events(repaired(runs)))
    fields = _fields(events)
    values = fields.select("vocabulary", "raw").distinct().withColumn("s", snapped(F.col("vocabulary"), F.col("raw")))
    done = cut(fields.join(values, ["vocabulary", "raw"]).select("run_id", "idx", "event_id", "group", "at", "part", "parent_kind", "field_label", F.col("raw").alias("raw_value"), F.col("s.value").alias("normalized_value"), F.col("s.action").alias("action")))
    place = F.concat_ws(":", "group", "at", "part")
    found = done.groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct(place.alias("k"), F.col("normalized_value").alias("v")))).alias("m"))
    at = lambda g, i, p: F.try_element_at(F.col("m"), F.concat_ws(":", F.lit(str(g)), i.cast("string"), F.lit(str(p))))
    zero = F.lit(0)
    channels = F.transform("channels", lambda x, i: F.struct(*[at(3, i, p).alias(n) for p, (n, _) in enumerate(_CHANNEL)]))
    impacts = F.transform("asset_impacts", lambda x, i: F.struct(F.coalesce(x["target_type"], F.lit("")).alias("target_type"), x["target_id"].alias("target_id"), *[at(4, i, p).alias(n) for p, (n, _) in enumerate(_IMPACT)], F.coalesce(x["rationale"], F.lit("")).alias("rationale")))
    whole = lambda fields: lambda x: F.array_size(F.array_compact(F.array(*[x[n] for n, _ in fields]))) == len(fields)
    normal = events.join(found, "event_id").select(
        "run_id", "article_id", "chunk_id", "idx", "event_id", F.coalesce(at(0, zero, 0), F.lit("")).alias("event_type"), "summary", "region", F.coalesce(at(2, zero, 0), F.lit("")).alias("time_horizon"), "confidence",
        F.array_compact(F.transform("shock_types", lambda x, i: at(1, i, 0))).alias("shock_types"), F.filter(channels, whole(_CHANNEL)).alias("channels"),
        F.filter(F.filter(impacts, whole(_IMPACT)), lambda x: F.coalesce(x["target_id"], F.lit("")) != "").alias("asset_impacts"), "evidence_spans",
    )
    normal = cut(normal)
    each = lambda c, out: normal.select("run_id", "article_id", "chunk_id", "idx", "event_id", "confidence", F.posexplode(c).alias("at", out))
    key = lambda *c: X.stable_key(*[F.col(x).cast("string") for x in c])
    c = each("channels", "x").select("event_id", "at", "x.*").withColumn("channel_id", key("event_id", "channel_name"))
    i = each("asset_impacts", "x").select("event_id", "confidence", "at", "x.*").withColumn("impact_id", key("event_id", "target_id"))
    e = each("evidence_spans", "evidence_text").withColumn("evidence_id", key("run_id", "evidence_text"))
    return {
        "normal": normal,
        "events": normal.select("event_id", "run_id", "article_id", "chunk_id", "event_type", "summary", "region", "time_horizon", "confidence"),
        "shock_types": each("shock_types", "shock_type").select("event_id", "shock_type").distinct(),
        "channels": top_per_key(c, ["channel_id"], [F.col("at")]).select("channel_id", "event_id", "channel_name", "direction", "strength", F.lit(None).cast("double").alias("confidence")),
        "impacts": top_per_key(i, ["impact_id"], [F.col("at")]).select("impact_id", "event_id", "target_type", "target_id", "direction", "strength", "horizon", "confidence", "rationale"),
        "evidence": top_per_key(e, ["evidence_id"], [F.col("idx"), F.col("at")]).select("evidence_id", "run_id", "article_id", "chunk_id", F.lit("macro_event").alias("parent_kind"), F.col("event_id").alias("parent_id"), "evidence_text"),
        "audit": done.select(X.stable_key(F.col("event_id"), place).alias("audit_id"), "run_id", F.col("idx").alias("macro_event_index"), "parent_kind", "field_label", "raw_value", "normalized_value", "action"),
    }


def processing_audit(rows: DataFrame, runs: DataFrame, tables: dict[str, DataFrame], threshold: int = 3) -> DataFrame:
    """The audit of `extraction.prefiltered` rows: their outcome by what could be saved of the responses and is left of the events.

    runs: run_id, chunk_id, success, raw_json, error_text; one a chunk. Adds audit_id, run_id, failure_reason, suspicious and
    an excerpt of the response.
    """
    left = tables["normal"].groupBy("run_id").agg(F.collect_list(F.struct("evidence_spans", "asset_impacts", "channels")).alias("events"))
    acts = tables["audit"].groupBy("run_id").agg(F.collect_set("action").alias("actions"))
    saved = repaired(runs).join(left, "run_id", "left").join(acts, "run_id", "left")
    out = outcomes(rows, saved.select("chunk_id", "success", "raw_json", "actions", "events"), threshold)
    out = out.join(runs.select("chunk_id", "run_id", "error_text", F.col("raw_json").alias("_raw")), "chunk_id", "left")
    called = F.col("stage").isin("model_call", "parse", "normalize")
    reason = F.when(F.col("status") == "api_failed", F.col("error_text")).when(F.col("status") == "parse_failed", F.lit("the response is no object"))
    suspicious = (F.size("reasons") > 0) & (F.col("status") != "article_dedup_skipped")
    return out.select(
        X.stable_key(F.col("chunk_id").cast("string"), F.coalesce(F.col("run_id").cast("string"), F.lit("")), F.col("stage")).alias("audit_id"), F.when(called, F.col("run_id")).alias("run_id"), "chunk_id", "stage", "status", reason.alias("failure_reason"),
        "queue_name", "event_count", suspicious.alias("suspicious"), "reasons", F.when(called & (F.coalesce("_raw", F.lit("")) != ""), X.excerpt(F.col("_raw"))).alias("raw_response_excerpt"),
    )


#: The key of each table that `save` appends to.
KEYS = {"events": "event_id", "channels": "channel_id", "impacts": "impact_id", "evidence": "evidence_id", "audit": "audit_id"}


def save(spark: SparkSession, tables: dict[str, DataFrame], folder: str, only: Sequence[str] = tuple(KEYS)) -> None:
    """Insert-or-ignore of the tables into parquet tables of a folder: a replayed run writes nothing twice."""
    for name in only:
        append_new(spark, tables[name], f"{folder}/{name}", KEYS[name], [F.col(KEYS[name])])
    if "shock_types" in tables:
        rows = tables["shock_types"].withColumn("shock_id", X.stable_key(F.col("event_id"), F.col("shock_type")))
        append_new(spark, rows, f"{folder}/shock_types", "shock_id", [F.col("shock_id")])
