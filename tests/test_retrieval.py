import datetime

from pyspark.sql import functions as F

from tidegraph.operators import retrieval as R


def test_references_and_periods(spark):
    d = datetime.date
    rows = [
        ("s", 0, "How is it?", "A$1\\x", d(2024, 1, 1), d(2024, 1, 9)), ("s", 1, "Did its stock fall in that period", None, None, None),
        ("s", 2, "and then", "", d(2024, 2, 1), None), ("s", 3, "same time, They", "B", None, None), ("t", 0, "it", None, None, None),
    ]
    df = spark.createDataFrame(rows, "session_id string, turn_index int, query string, display_name string, date_start date, date_end date")
    got = {(r.session_id, r.turn_index): (r.rewritten, r.start, r.end) for r in R.resolve_references(df).collect()}
    assert got == {
        ("s", 0): ("How is it?", d(2024, 1, 1), d(2024, 1, 9)), ("s", 1): ("Did A$1\\x stock fall in that period", d(2024, 1, 1), d(2024, 1, 9)),
        ("s", 2): ("and then", d(2024, 2, 1), None), ("s", 3): ("same time, A$1\\x", d(2024, 2, 1), None), ("t", 0): ("it", None, None),
    }


def test_cascade(spark):
    t = lambda rows: spark.createDataFrame(rows, "question_id int, chunk_id int, score double, kind string")
    a = t([(1, i, 0.5, "a") for i in range(4)] + [(2, 1, 0.5, "a"), (2, 2, 0.5, "a")])
    b = t([(1, 9, 0.9, "b"), (2, 2, 0.7, "b"), (2, 3, 0.1, "b"), (2, 4, None, "b")])
    c = t([(2, 5, 1.0, "c"), (3, 1, 1.0, "c")])
    got = sorted((r.question_id, r.chunk_id, r.kind) for r in R.cascade([a, b, c]).collect())
    assert got == [(1, 0, "a"), (1, 1, "a"), (1, 2, "a"), (1, 3, "a"), (2, 1, "a"), (2, 2, "b"), (2, 3, "b"), (2, 4, "b"), (3, 1, "c")]


def test_review_reasons(spark):
    schema = "events array<struct<evidence_spans array<string>, asset_impacts array<string>, channels array<string>>>, actions array<string>, score int, hard boolean"
    rows = [([], ["kept"], 6, False), ([], None, 5, False), (None, [], 0, True), ([(["x"], [], ["c"]), (None, ["y"], ["c"])], ["snapped", "dropped"], 1, None)]
    got = [r.r for r in spark.createDataFrame(rows, schema).select(R.review_reasons(F.col("events"), F.col("actions"), F.col("score"), F.col("hard")).alias("r")).collect()]
    assert got == [["suspicious_empty_output"], [], ["suspicious_empty_output"], ["enum_value_dropped", "enum_value_snapped", "missing_evidence_spans", "event_without_asset_impacts"]]
