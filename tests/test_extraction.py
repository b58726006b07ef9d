"""Periods of questions, outcomes with enum actions, gold comparison on read answers."""

import datetime

from pyspark.sql import functions as F

from tidegraph.operators import answers as A
from tidegraph.operators import extraction as E


def test_periods(spark):
    d = datetime.date
    cases = {
        "": [(None, None)], "Summary of last week": [(d(2024, 3, 6), d(2024, 3, 12))], "compare yesterday and today": [(d(2024, 3, 12), d(2024, 3, 12)), (d(2024, 3, 13), d(2024, 3, 13))], "May it rise?": [(None, None)],
        "March 2023 vs. Q1 2024": [(d(2023, 3, 1), d(2023, 3, 31)), (d(2024, 1, 1), d(2024, 3, 31))], "versus 3 days ago": [(d(2024, 3, 10), d(2024, 3, 10))],
        "from last month to this month?": [(d(2024, 2, 13), d(2024, 3, 13)), (d(2024, 3, 1), d(2024, 3, 13))], "prices since 2024-03-01 until now": [(d(2024, 3, 1), d(2024, 3, 13))],
    }
    df = spark.createDataFrame([(q,) for q in [*cases, None]], "q string")
    got = {r.q: [tuple(p) for p in r.p] for r in df.select("q", E.sub_queries(F.col("q"), F.lit("2024-03-13").cast("date")).alias("p")).collect()}
    assert got == cases | {None: [(None, None)]}


def test_outcomes_of_enum_actions(spark):
    rows = spark.createDataFrame([(i, None, 9, False) for i in range(5)] + [(9, "prefilter_skipped", 0, False)], "chunk_id int, status string, macro_score int, was_hard boolean")
    event = '{"events": [{"evidence_spans": ["s"], "asset_impacts": ["a"], "channels": ["c"]}]}'
    runs = [(0, True, event, ["snapped"]), (1, True, event, None), (2, True, "{}", ["dropped"]), (3, False, event, None), (4, True, None, None)]
    got = {r.chunk_id: (r.status, r.stage, r.queue_name, r.event_count, r.reasons) for r in E.outcomes(rows, spark.createDataFrame(runs, "chunk_id int, success boolean, raw_json string, actions array<string>")).collect()}
    assert got == {
        0: ("events_written", "normalize", "review_suspicious", 1, ["enum_value_snapped"]), 1: ("events_written", "normalize", None, 1, []),
        2: ("empty_success", "normalize", "review_suspicious", 0, ["suspicious_empty_output"]), 3: ("api_failed", "model_call", "retry_failed", None, ["api_failed"]),
        4: ("parse_failed", "parse", "retry_failed", None, ["parse_failed"]), 9: ("prefilter_skipped", "prefilter", None, None, []),
    }


def test_gold(spark):
    gold = "struct<allowed:array<string>,expected:string,most_confidence:int,mechanisms:array<string>,counter:boolean,phrases:array<string>,forbidden:array<string>>"
    said = "Answer\nUnclear effect. Confidence: 70%\nEvidence\nnone, however rates moved"
    rows = [
        (0, said, (None, "positive", 50, ["rates"], True, None, None)), (1, said, ([], None, None, ["oil"], None, ["HOWEVER", "tariff"], ["unc.ear"])),
        (2, said, (None, None, None, None, None, None, None)), (3, None, (["mixed"], None, 10, None, True, None, None)),
    ]
    df = spark.createDataFrame(rows, f"id int, answer string, gold {gold}")
    known = F.array(F.lit("rates"), F.lit("oil"))
    parsed = A.read_answer(F.coalesce("answer", F.lit("")), known)
    got = {r.id: r.x for r in df.select("id", E.gold_failures(parsed, F.col("answer"), F.col("gold")).alias("x")).collect()}
    assert got == {0: ["direction", "confidence_cap"], 1: ["mechanisms", "counterarguments", "overclaim"], 2: [], 3: ["direction", "counterarguments"]}


def test_each_question_is_read_once(spark, monkeypatch):
    """Repeated and null questions have the periods of their own text; the grammar sees different ones only."""
    asks = ["What moved in March 2024?", None, "since 2024-01-02", "compare Q1 2023 with Q2 2024", "", "from May 2023 to June 2023"]
    rows = spark.createDataFrame([(i, asks[i % len(asks)]) for i in range(60)], "i int, q string")
    today = F.lit("2024-06-14").cast("date")
    want = {r.i: r.r for r in rows.select("i", E.sub_queries(F.col("q"), today).alias("r")).collect()}
    for most in (E.BROADCAST_QUESTIONS, 0):
        monkeypatch.setattr(E, "BROADCAST_QUESTIONS", most)
        assert {r.i: r.ranges for r in E.with_sub_queries(rows, "q", today).collect()} == want and len(want) == 60
    seen = []
    monkeypatch.setattr(E, "cut", lambda df: seen.append(df.count()) or df)
    E.with_sub_queries(rows, "q", today)
    assert seen == [len(asks)]
