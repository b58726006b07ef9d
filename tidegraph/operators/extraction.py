"""Extraction outcomes, gold-case comparison, conversation history and questions split by period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions import dates as T
from tidegraph.functions import intents as I
from tidegraph.functions import temporal as D
from tidegraph.functions import text as X
from tidegraph.operators import answers as A
from tidegraph.operators.core import cut
from tidegraph.operators.retrieval import review_reasons

# Queue names, words that ask for several periods
RETRY_QUEUE, REVIEW_QUEUE = "retry_failed", "review_suspicious"
#: Different questions whose periods are broadcast up to this counted number.
BROADCAST_QUESTIONS = 1 << 18
MULTI_TIME_WORDS = r"(?i)\b(compare|vs\.?|versus|differ)\b"

EVENTS = "events array<struct<event_type string, evidence_spans array<string>, asset_impacts array<string>, channels array<string>>>"


def prefiltered(chunks: DataFrame, hard: Sequence[str], directional: Sequence[str], noise: Sequence[str], threshold: int = 3, most: int = 2) -> DataFrame:
    """chunks (chunk_id, article_id, ord, text, title, source) with macro_score, was_hard and status: prefilter_skipped,
    article_dedup_skipped, or null for those that go to the model.

    Articles without a hard-included chunk keep their `most` best: by score, title terms, hard terms, directional terms,
    then place (ord). One window an article, over the survivors.
    """
    title_hits = X.term_hits(F.coalesce("title", F.lit("")), I.HARD_TITLES)
    rows = chunks.withColumns({
        "macro_score": X.macro_score(F.coalesce("text", F.lit("")), hard, directional, noise), "was_hard": I.is_hard_include(F.col("source"), F.col("title")),
        "_by": F.struct(title_hits.alias("t"), X.term_hits(F.coalesce("text", F.lit("")), hard).alias("h"), X.term_hits(F.coalesce("text", F.lit("")), directional).alias("d")),
    })
    passed = F.col("was_hard") | (F.col("macro_score") >= threshold)
    rows = rows.withColumn("_out", ~passed)
    w = Window.partitionBy("article_id", "_out")
    place = F.row_number().over(w.orderBy(F.desc("macro_score"), F.desc("_by"), F.col("ord"), F.col("chunk_id")))
    rows = rows.withColumns({"_place": place, "_any": F.max(F.col("was_hard").cast("int")).over(w)})
    status = F.when(F.col("_out"), "prefilter_skipped").when((F.col("_any") == 0) & (F.col("_place") > most), "article_dedup_skipped")
    return rows.withColumn("status", status).drop("_by", "_out", "_place", "_any")


def outcomes(rows: DataFrame, runs: DataFrame, threshold: int = 3) -> DataFrame:
    """The audit of `prefiltered` rows and the model's runs (chunk_id, success, raw_json, actions array<string>): chunk_id,
    status (six values), stage, queue_name, event_count, reasons.

    A chunk sent without a run counts as failed. actions: what became of the run's enum values. Where runs have a column
    `events`, what is left of the events after their enums were enforced, it is judged instead of those in raw_json.
    """
    own = [F.col("events").alias("_left")] if "events" in runs.columns else []
    j = rows.join(runs.select("chunk_id", "success", "raw_json", "actions", *own), "chunk_id", "left")
    parsed = F.try_parse_json("raw_json")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))
    j = j.withColumns({"_ok": is_object, "_events": F.from_json("raw_json", EVENTS)["events"]})
    judged = F.col("_left" if own else "_events")
    n = F.greatest(F.coalesce(F.size(judged), F.lit(0)), F.lit(0))
    called = F.when(~F.coalesce("success", F.lit(False)), "api_failed").when(~F.col("_ok"), "parse_failed").when(n == 0, "empty_success").otherwise("events_written")
    j = j.withColumn("status", F.coalesce("status", called)).withColumn("event_count", F.when(F.col("status").isin("empty_success", "events_written"), n))
    found = review_reasons(judged, F.when(F.col("status") == "events_written", F.col("actions")), F.col("macro_score"), F.col("was_hard"), threshold)
    reasons = (
        F.when(F.col("status") == "article_dedup_skipped", F.array(F.lit("article_level_redundancy_skip"))).when(F.col("status").isin("api_failed", "parse_failed"), F.array(F.col("status")))
        .when(F.col("status").isin("empty_success", "events_written"), found).otherwise(F.array().cast("array<string>"))
    )
    stage = F.when(F.col("status") == "prefilter_skipped", "prefilter").when(F.col("status") == "article_dedup_skipped", "article_dedup").when(F.col("status") == "api_failed", "model_call").when(F.col("status") == "parse_failed", "parse").otherwise("normalize")
    out = j.withColumns({"stage": stage, "reasons": reasons})
    queue = F.when(F.col("status").isin("api_failed", "parse_failed"), RETRY_QUEUE).when((F.col("stage") == "normalize") & (F.size("reasons") > 0), REVIEW_QUEUE)
    return out.select("chunk_id", "status", "stage", queue.alias("queue_name"), "event_count", "reasons")


def gold_failures(parsed: Column, answer: Column, gold: Column) -> Column:
    """The checks that an answer fails, of direction, confidence_cap, mechanisms, counterarguments, overclaim, in this order.

    parsed: as `answers.read_answer` gives it; gold: struct<allowed array, expected, most_confidence, mechanisms array,
    counter boolean, phrases array, forbidden array>, each null or empty where the case asks nothing.
    """
    low, section = F.lower(F.coalesce(answer, F.lit(""))), A.sections(answer)["answer"]
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    allowed = F.when(some(gold["allowed"]), gold["allowed"]).when(F.coalesce(gold["expected"], F.lit("")) != "", F.array(gold["expected"]))
    way, sure = parsed["direction"], parsed["confidence"]
    directed = way.isin("positive", "negative")
    auto = F.when(parsed["counter"] & directed, ~F.lower(section).rlike(A.DOMINANCE) & F.coalesce(sure > 50, F.lit(True))).otherwise((F.size(parsed["overclaims"]) > 0) & (F.size(parsed["hedges"]) > 0))
    rules = [
        (allowed.isNotNull() & ~F.array_contains(allowed, way), "direction"),
        (way.isin("mixed", "unclear") & (sure > gold["most_confidence"]), "confidence_cap"),
        (some(gold["mechanisms"]) & (F.size(F.array_except(gold["mechanisms"], parsed["mechanisms"])) > 0), "mechanisms"),
        (F.when(some(gold["phrases"]), F.exists(gold["phrases"], lambda p: ~F.contains(low, F.lower(p)))).otherwise(gold["counter"] & ~parsed["counter"]), "counterarguments"),
        (F.when(some(gold["forbidden"]), F.exists(gold["forbidden"], lambda p: F.regexp_like(F.coalesce(answer, F.lit("")), F.concat(F.lit("(?i)"), p)))).otherwise(auto), "overclaim"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in rules]))


def compare_runs(before: DataFrame, after: DataFrame, key: str, scores: Sequence[str]) -> DataFrame:
    """A row a case of both runs: each score before and after, and its gain."""
    b = before.select(key, *[F.col(c).alias(f"baseline_{c}") for c in scores])
    a = after.select(key, *[F.col(c).alias(f"reranked_{c}") for c in scores])
    gain = [F.round(F.col(f"reranked_{c}") - F.col(f"baseline_{c}"), 4).alias(f"gain_{c}") for c in scores]
    return b.join(a, key).select("*", *gain)


def compression_split(turns: DataFrame, session: str, order: str, most: int = 8, recent: int = 3) -> DataFrame:
    """Adds old: whether the turn goes into the summary, as all but the `recent` last of a session of over `most` turns do."""
    w = Window.partitionBy(session)
    back = F.row_number().over(w.orderBy(F.desc(order)))
    return turns.withColumn("old", (F.count("*").over(w) > most) & (back > recent))


def history_block(turns: DataFrame, session: str, order: str, most: int = 3, summary: Column | None = None) -> DataFrame:
    """(session, history): the last `most` turns (display_name, date_start, date_end, answer) a line each, after the summary."""
    back = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    label = F.coalesce(F.nullif("display_name", F.lit("")), F.lit("general query"))
    day = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    period = F.when(F.col("date_start").isNotNull() | F.col("date_end").isNotNull(), F.concat(day("date_start"), F.lit(" -> "), day("date_end"))).otherwise("no time filter")
    line = F.concat(F.lit("Turn "), (F.col(order) + 1).cast("string"), F.lit(": Asked about "), label, F.lit(" ("), period, F.lit("): "), F.substring(F.coalesce("answer", F.lit("")), 1, 300))
    said = F.coalesce(F.max(summary), F.lit("")) if summary is not None else F.lit("")
    rows = turns.withColumns({"_back": back, "_line": line}).where(F.col("_back") <= most)
    agg = rows.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "_line"))).alias("x"), said.alias("said"))
    head = F.when(F.col("said") != "", F.concat(F.lit("\nEarlier in this session: "), "said")).otherwise("")
    return agg.select(session, F.concat(F.lit("[CONVERSATION HISTORY]"), head, F.lit("\n"), F.array_join(F.transform("x", lambda r: r["_line"]), "\n")).alias("history"))


def sub_queries(question: Column, today: Column) -> Column:
    """array<struct<start, end>>: the periods that a question asks of, one struct of nulls for none.

    `from A to B` at its end, last and this week, last and this month, yesterday and today give two; a question that compares
    gives one for each of its date expressions, if it has several; else the best single one counts: one with four digits in a
    row before others, then the longest, then the first. See `dates` for the expressions.
    """
    nulls = F.struct(F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"))
    ends = r"(?i)from\s+(.+?)\s+to\s+(.+?)[\?\.\!,]?\s*$"
    has = lambda *words: [question.rlike(rf"(?i)\b{w}\b") for w in words]
    pair = lambda x, y: F.array(D.relative_range(F.lit(x), today), D.relative_range(F.lit(y), today))
    (lw, tw, lm, tm, to, ye), multi = has(r"last\s+week", r"this\s+week", r"last\s+month", r"this\s+month", "today(?:'?s)?", "yesterday(?:'?s)?"), question.rlike(MULTI_TIME_WORDS)
    def split(found: Column) -> Column:
        texts = F.concat(F.array(*[F.regexp_extract(question, ends, i) for i in (1, 2)], I.best_time_expression(found)), found)
        return T.let(F.transform(texts, lambda x: T.date_range(x, today)), lambda r: chosen(found, r))

    def chosen(found: Column, ranges: Column) -> Column:
        a, b = ranges[0], ranges[1]
        single = F.array(F.coalesce(ranges[2], nulls))
        each = F.filter(F.slice(ranges, 4, F.greatest(F.size(ranges) - 3, F.lit(0))), lambda r: r.isNotNull())
        return (
            F.when(F.size(found) == 0, F.array(nulls)).when(a.isNotNull() | b.isNotNull(), F.array(F.coalesce(a, nulls), F.coalesce(b, nulls)))
            .when(lw & tw, pair("last week", "this week")).when(lm & tm, pair("last month", "this month")).when(to & ye & ~multi, pair("yesterday", "today")).when(multi & (F.size(each) > 1), each).otherwise(single)
        )

    return T.let(F.coalesce(T.expressions(question), F.array().cast("array<string>")), split)


def with_sub_queries(rows: DataFrame, question: str, today: Column, out: str = "ranges") -> DataFrame:
    """rows with the `sub_queries` of their question, by one today for all; each different question is read once.

    The grammar tries some forty patterns on each phrase, so questions are counted out first and their periods joined back.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.select(F.col(question).alias("_asked")).distinct().repartition(n)  # a few kilobytes of questions are work for many tasks
    read = cut(asked.select("_asked", sub_queries(F.col("_asked"), today).alias(out)))
    small = read.count() <= BROADCAST_QUESTIONS
    return rows.join(F.broadcast(read) if small else read, F.col(question).eqNullSafe(F.col("_asked")), "left").drop("_asked")
