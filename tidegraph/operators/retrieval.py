"""Retrieval over several candidate lists: fallback tiers, causal hops, capped summary lists, conversation carry-over, extraction review."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.core import top_per_key

#: References to the last entity, phrases that keep the last period.
REFERENCES = r"(?i)\b(they|it|the company|their|its|the firm|the stock|the brand|this company|this stock|that company|that stock|the entity|this entity)\b"
SAME_PERIOD = r"(?i)\b(same period|same time|that period|that time|then|during that|over that period|in that period|at that time)\b"


def cascade(tiers: Sequence[DataFrame], least: int = 4, most: int = 8, key: str = "question_id") -> DataFrame:
    """Candidates (key, chunk_id, score, kind) of tiers in turn: a later tier counts only where those before it have
    fewer than `least` chunks. The best row of a chunk stays, ties to the earlier tier; the best `most` of each key."""
    rows = reduce(DataFrame.unionByName, [t.select(key, "chunk_id", "score", "kind", F.lit(i).alias("_tier")) for i, t in enumerate(tiers)])
    # a chunk counts for the first tier that has it; a tier's open if the tiers before it hold too few
    first = rows.groupBy(key, "chunk_id").agg(F.min("_tier").alias("_tier"))
    held = first.groupBy(key).agg(*[F.count_if(F.col("_tier") < i).alias(f"_h{i}") for i in range(len(tiers))])
    open_ = reduce(lambda c, i: c.when(F.col("_tier") == i, F.col(f"_h{i}") < least), range(1, len(tiers)), F.when(F.col("_tier") == 0, F.lit(True)))
    used = rows.join(held, key).where(open_)
    best = top_per_key(used, [key, "chunk_id"], [F.desc_nulls_last("score"), F.col("_tier"), F.col("kind")])
    return top_per_key(best, [key], [F.desc_nulls_last("score"), F.col("chunk_id")], most).select(key, "chunk_id", "score", "kind")


def causal_hops(hops: DataFrame, found: DataFrame, per_hop: int = 4) -> DataFrame:
    """(question_id, chunk_id, hop, at, score, expansion_kind) of a chain of hops.

    hops (question_id, at, hop), found (hop, chunk_id, score) with hop trimmed and lower-cased. A repeated hop counts
    once. Each hop names its best per_hop chunks; a chunk that two hops name belongs to the first.
    """
    named = hops.select("question_id", "at", F.lower(F.trim("hop")).alias("hop")).where("hop <> ''")
    once = named.groupBy("question_id", "hop").agg(F.min("at").alias("at"))
    best = top_per_key(found, ["hop"], [F.desc_nulls_last("score"), F.col("chunk_id")], per_hop)
    chunks = top_per_key(once.join(best, "hop"), ["question_id", "chunk_id"], [F.col("at")])
    return chunks.select("question_id", "chunk_id", "hop", "at", "score", F.concat(F.lit("causal_hop:"), "hop").alias("expansion_kind"))


def summary_list(ranked: DataFrame, key: str = "question_id", per_article: int = 2, per_source: int = 1, least_sources: int = 3) -> DataFrame:
    """ranked (key, chunk_id, article_id, source, score) cut to few chunks an article, then a source; enough: whether
    least_sources different sources are left. Chunks without an article have no cap there."""
    order = [F.desc_nulls_last("score"), F.col("chunk_id")]
    one = top_per_key(ranked, [key, "chunk_id"], order)
    alone = F.when(F.col("article_id").isNull(), F.col("chunk_id").cast("string"))
    capped = top_per_key(one.withColumn("_alone", alone), [key, "article_id", "_alone"], order, per_article).drop("_alone")
    source = F.lower(F.trim(F.coalesce("source", F.lit("unknown"))))
    out = top_per_key(capped.withColumn("_s", source), [key, "_s"], order, per_source)
    n = F.size(F.collect_set("_s").over(Window.partitionBy(key)))
    return out.withColumn("enough", n >= least_sources).drop("_s")


def _quoted(c: Column) -> Column:
    """For use as a replacement: backslash and dollar stand for themselves."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def resolve_references(turns: DataFrame, session: str = "session_id", order: str = "turn_index") -> DataFrame:
    """turns (session, order, query, display_name, date_start, date_end) with `rewritten`: references replaced by the
    last entity of earlier turns; and `start`, `end`: the turn's own, or the last ones where it has none and the
    query's words keep the period."""
    before = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last_name = F.last(F.nullif("display_name", F.lit("")), ignorenulls=True).over(before)
    dated = F.when(F.col("date_start").isNotNull() | F.col("date_end").isNotNull(), F.struct("date_start", "date_end"))
    rows = turns.withColumns({"_name": last_name, "_dates": F.last(dated, ignorenulls=True).over(before)})
    rewritten = F.when(F.col("_name").isNull(), F.col("query")).otherwise(F.regexp_replace("query", F.lit(REFERENCES), _quoted(F.col("_name"))))
    keeps = F.col("date_start").isNull() & F.col("date_end").isNull() & F.col("query").rlike(SAME_PERIOD)
    pick = lambda c: F.when(keeps, F.col(f"_dates.{c}")).otherwise(F.col(c))
    return rows.withColumns({"rewritten": rewritten, "start": pick("date_start"), "end": pick("date_end")}).drop("_name", "_dates")


def review_reasons(events: Column, actions: Column, score: Column, hard: Column, threshold: int = 3) -> Column:
    """Why an extraction needs review, in fixed order. events: array of structs with the arrays evidence_spans,
    asset_impacts and channels; actions: what became of its enum values."""
    events = F.coalesce(events, F.filter(events, lambda e: F.lit(False)))
    empty = F.coalesce(F.size(events) <= 0, F.lit(True))
    without = lambda f: F.coalesce(F.exists(events, lambda e: F.coalesce(F.size(e[f]), F.lit(0)) <= 0), F.lit(False))
    has = lambda a: F.coalesce(F.array_contains(actions, a), F.lit(False))
    rules = [
        (empty & (F.coalesce(hard, F.lit(False)) | F.coalesce(score >= threshold + 3, F.lit(False))), "suspicious_empty_output"),
        (has("dropped"), "enum_value_dropped"), (has("snapped"), "enum_value_snapped"),
        (without("evidence_spans"), "missing_evidence_spans"), (without("asset_impacts"), "event_without_asset_impacts"), (without("channels"), "event_without_channels"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in rules]))


def retry_list(audit: DataFrame, queue: str, limit: int | None = None) -> DataFrame:
    """Chunks in a queue, each once, the latest queued first."""
    rows = audit.where(F.col("queue_name") == queue).groupBy("chunk_id").agg(F.max("created_at").alias("queued_at")).orderBy(F.desc("queued_at"), "chunk_id")
    return rows.limit(limit) if limit is not None else rows
