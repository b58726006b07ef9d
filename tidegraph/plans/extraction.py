"""Queries of extraction outcomes, gold comparison, history and periods, with their SQL.

Stand-ins: documents are chunks (their id mod 400 the article), conversations turns, benchmark items answers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.functions import intents as I
from tidegraph.operators import extraction as E
from tidegraph.plans.catalogue import query

HARD, DIRECTIONAL, NOISE = ("the", "and", "ing"), ("in", "of"), ("ou", "with")
HARD_SOURCE = I.HARD_SOURCES[0]


def _hits(col: str, terms) -> str:
    quoted = lambda x: x.replace("'", "''")
    return "(" + " + ".join(f"contains(lower(coalesce({col}, '')), '{quoted(x)}')::int" for x in terms) + ")"


_RAW = """case doc_id % 5 when 0 then '{"events": []}' when 1 then '{"events": [' when 2 then '[]' else '{"events": [{"event_type": "x", "evidence_spans": ["s"], "asset_impacts": [' || (case when doc_id % 2 = 0 then '"a"' else '' end) || '], "channels": ["c"]}]}' end"""


@query(f"""with c as (select doc_id as chunk_id, doc_id % 400 as article_id, doc_id, text, case when doc_id % 400 = 7 then '{HARD_SOURCE}' else 'x' end as source from documents),
  s as (select *, 2 * {_hits('text', HARD)} + {_hits('text', DIRECTIONAL)} - 2 * {_hits('text', NOISE)} as score, {_hits('text', HARD)} as h, {_hits('text', DIRECTIONAL)} as d, source = '{HARD_SOURCE}' as hard from c),
  p as (select *, not hard and score < 5 as out, row_number() over (partition by article_id, not hard and score < 5 order by score desc, h desc, d desc, doc_id) as rn from s),
  r as (select *, case when out then 'prefilter_skipped' when not hard and rn > 2 then 'article_dedup_skipped' when doc_id % 11 = 0 then 'api_failed' when doc_id % 5 in (1, 2) then 'parse_failed' when doc_id % 5 = 0 then 'empty_success' else 'events_written' end as status from p)
  select chunk_id, status, case when status in ('api_failed', 'parse_failed') then '{E.RETRY_QUEUE}' when status = 'empty_success' and (hard or score >= 8) or status = 'events_written' and doc_id % 2 = 1 then '{E.REVIEW_QUEUE}' end as queue_name,
  case status when 'article_dedup_skipped' then 'article_level_redundancy_skip' when 'api_failed' then status when 'parse_failed' then status when 'empty_success' then case when hard or score >= 8 then 'suspicious_empty_output' else '' end
  when 'events_written' then case when doc_id % 2 = 1 then 'event_without_asset_impacts' else '' end else '' end as reasons from r""")
def extraction_outcomes(t):
    source = F.when(F.col("doc_id") % 400 == 7, HARD_SOURCE).otherwise("x")
    c = t.documents.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 400).alias("article_id"), F.col("doc_id").alias("ord"), "text", F.lit("").alias("title"), source.alias("source"))
    runs = t.documents.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 11 != 0).alias("success"), F.expr(_RAW).alias("raw_json"), F.lit(None).cast("array<string>").alias("actions"))
    out = E.outcomes(E.prefiltered(c, HARD, DIRECTIONAL, NOISE, threshold=5), runs, threshold=5)
    return out.select("chunk_id", "status", "queue_name", F.array_join("reasons", ",").alias("reasons"))


@query("""with p as (select item_id, ['positive', 'negative', 'mixed', 'unclear'][item_id % 4 + 1] as way, case when item_id % 7 <> 0 then item_id * 13 % 101 end as sure, item_id % 2 = 0 as counter, item_id % 3 = 0 as hedge from benchmark)
  select item_id, concat_ws(',', case when item_id % 5 = 1 and way <> 'positive' then 'direction' end, case when way in ('mixed', 'unclear') and sure > 60 then 'confidence_cap' end,
  case when item_id % 6 = 0 then 'mechanisms' end, case when item_id % 9 = 0 and not counter then 'counterarguments' end,
  case when counter and way in ('positive', 'negative') then case when coalesce(sure > 50, true) then 'overclaim' end when hedge then 'overclaim' end) as failures from p""")
def gold_comparison(t):
    i, strings = F.col("item_id"), lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    parsed = F.struct(
        F.get(strings("positive", "negative", "mixed", "unclear"), (i % 4).cast("int")).alias("direction"), F.when(i % 7 != 0, (i * 13 % 101).cast("int")).alias("confidence"), strings("rates").alias("mechanisms"),
        (i % 2 == 0).alias("counter"), F.when(i % 3 == 0, strings("may")).otherwise(strings()).alias("hedges"), strings("will").alias("overclaims"),
    )
    gold = F.struct(
        F.when(i % 5 == 1, strings("positive")).alias("allowed"), F.lit(None).cast("string").alias("expected"), F.lit(60).alias("most_confidence"),
        F.when(i % 6 == 0, strings("rates", "oil")).alias("mechanisms"), (i % 9 == 0).alias("counter"), strings().alias("phrases"), strings().alias("forbidden"),
    )
    return t.benchmark.select("item_id", F.array_join(E.gold_failures(parsed, F.lit("no section"), gold), ",").alias("failures"))


@query("""with s as (select conv_id, count(*) as n, avg(length(text)) as x from conversations group by 1)
  select conv_id, round(x, 4) as baseline_score, round(x + n, 4) as reranked_score, round(round(x + n, 4) - round(x, 4), 4) as gain_score from s""")
def suite_comparison(t):
    s = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.avg(F.char_length("text")).alias("x"))
    return E.compare_runs(s.select("conv_id", F.round("x", 4).alias("score")), s.select("conv_id", F.round(F.col("x") + F.col("n"), 4).alias("score")), "conv_id", ["score"])


@query("""select conv_id, turn, count(*) over (partition by conv_id) > 4 and row_number() over (partition by conv_id order by turn desc) > 2 as old from conversations""")
def compressed_turns(t):
    return E.compression_split(t.conversations, "conv_id", "turn", most=4, recent=2).select("conv_id", "turn", "old")


@query("""with r as (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations)
  select conv_id, sha256('[CONVERSATION HISTORY]' || chr(10) || string_agg('Turn ' || (turn + 1) || ': Asked about ' || case when turn % 2 = 0 then 'Acme' else 'general query' end || ' (' ||
  case when turn % 3 = 0 then '2024-01-01 -> None' else 'no time filter' end || '): ' || substr(coalesce(text, ''), 1, 300), chr(10) order by turn)) as history from r where back <= 3 group by 1""")
def conversation_history(t):
    day = F.lit("2024-01-01").cast("date")
    c = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "Acme").alias("display_name"), F.when(F.col("turn") % 3 == 0, day).alias("date_start"), F.lit(None).cast("date").alias("date_end"), F.col("text").alias("answer"))
    return E.history_block(c, "conv_id", "turn").select("conv_id", F.sha2(F.col("history").cast("binary"), 256).alias("history"))


QUESTIONS = ("news from 2024-03-01 to March 5th, 2024?", "last week and this week", "what moved today and yesterday's close", "compare this month", "no dates", "since 2024-02-29 and ago")


@query("""select conv_id, turn, ['2024-03-01,2024-03-05', '2024-03-06,2024-03-11', '2024-03-12,2024-03-13', '2024-03-01', '', '2024-02-29'][conv_id % 6 + 1] as starts from conversations""")
def question_periods(t):
    """The starts of the periods that six question forms ask of, on Wednesday 2024-03-13."""
    q = F.get(F.array(*[F.lit(x) for x in QUESTIONS]), (F.col("conv_id") % 6).cast("int"))
    periods = E.sub_queries(F.col("q"), F.lit("2024-03-13").cast("date"))
    return t.conversations.withColumn("q", q).select("conv_id", "turn", F.array_join(F.transform(periods, lambda p: F.coalesce(p["start"].cast("string"), F.lit(""))), ",").alias("starts"))
