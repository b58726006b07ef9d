"""Replayed responses: salvage, variant parse, every field's audit, child tables, outcomes, a second save writes nothing."""

import json

import pytest

from tidegraph.operators import normalise as N

EVENT = {
    "event_type": "Banking_stress", "shock_types": ["banking_stress", "zzz", None, "banking_stres"], "summary": "s", "time_horizon": "near_term", "confidence": 0.7,
    "channels": [{"channel_name": "risk_off_flow", "direction": "up", "strength": "weak"}, {"channel_name": "risk_off_flo", "direction": "down", "strength": "strong"}, {"channel_name": "none alike", "direction": "up", "strength": "weak"}, {"direction": "up"}],
    "asset_impacts": [{"target_type": "fx", "target_id": "USD", "direction": "upp", "strength": "weak", "horizon": "long_term", "rationale": "r"}, {"target_id": "", "direction": "up", "strength": "weak", "horizon": "long_term"}, {"target_id": "USD", "direction": "up", "strength": "strong", "horizon": "intraday"}],
    "evidence_spans": ["a", "b", "a", None],
}
RUNS = [
    (1, 10, 100, True, json.dumps({"events": [EVENT, {}]}), None), (2, 10, 101, True, json.dumps({"events": [{"event_type": "fiscal_expansion"}]}) + ' tail "}', None), (3, 10, 102, True, '{"events": [{"event_ty', None),
    (4, 10, 103, True, "[1]", None), (5, 10, 104, True, '{"events": []}', None), (6, 10, 105, False, None, "timeout"), (7, 10, 106, True, '{"events": 5}', None), (8, 10, 107, True, '{"events": [7, {"channels": 3, "confidence": "x"}]}', None),
]


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(RUNS, "run_id int, article_id int, chunk_id int, success boolean, raw_json string, error_text string")


def test_tables(spark, runs):
    t = {k: v.collect() for k, v in N.normalise(runs).items()}
    assert sorted((r.run_id, r.event_type, r.time_horizon, r.confidence) for r in t["events"]) == [(1, "", "", None), (1, "banking_stress", "near_term", 0.7), (2, "fiscal_expansion", "", None), (8, "", "", None), (8, "", "", None)]
    assert [r.shock_type for r in t["shock_types"]] == ["banking_stress"]
    assert [(r.channel_name, r.direction, r.strength) for r in t["channels"]] == [("risk_off_flow", "up", "weak")]
    assert [(r.target_id, r.direction, r.strength, r.horizon, r.confidence, r.rationale) for r in t["impacts"]] == [("USD", "up", "weak", "long_term", 0.7, "r")]
    assert sorted((r.run_id, r.evidence_text) for r in t["evidence"]) == [(1, "a"), (1, "b")]
    audit = [r for r in t["audit"] if r.run_id == 1 and r.macro_event_index == 0]
    assert len(audit) == 1 + 4 + 1 + 4 * 3 + 3 * 3 and len({r.audit_id for r in t["audit"]}) == len(t["audit"])
    of = lambda label: sorted((r.raw_value, r.normalized_value or "", r.action) for r in audit if r.field_label == label)
    assert of("event_type") == [("Banking_stress", "banking_stress", "snapped")] and of("time_horizon") == [("near_term", "near_term", "kept")]
    assert of("shock_types") == [("", "", "dropped"), ("banking_stres", "banking_stress", "snapped"), ("banking_stress", "banking_stress", "kept"), ("zzz", "", "dropped")]
    assert of("channel_name") == [("", "", "dropped"), ("none alike", "", "dropped"), ("risk_off_flo", "risk_off_flow", "snapped"), ("risk_off_flow", "risk_off_flow", "kept")]


def test_outcomes(spark, runs):
    rows = spark.createDataFrame([(100 + i, None, 6, False) for i in range(9)] + [(200, "article_dedup_skipped", 6, False)], "chunk_id int, status string, macro_score int, was_hard boolean")
    out = {r.chunk_id: (r.status, r.failure_reason, r.queue_name, r.event_count, r.suspicious, r.reasons) for r in N.processing_audit(rows, runs, N.normalise(runs.where("success"))).collect()}
    every = ["enum_value_dropped", "enum_value_snapped", "missing_evidence_spans", "event_without_asset_impacts", "event_without_channels"]
    bare = [r for r in every if r != "enum_value_snapped"]
    no, empty = "the response is no object", ("empty_success", None, "review_suspicious", 0, True, ["suspicious_empty_output"])
    assert out == {
        100: ("events_written", None, "review_suspicious", 2, True, every), 101: ("events_written", None, "review_suspicious", 1, True, bare), 102: ("parse_failed", no, "retry_failed", None, True, ["parse_failed"]),
        103: ("parse_failed", no, "retry_failed", None, True, ["parse_failed"]), 104: empty, 105: ("api_failed", "timeout", "retry_failed", None, True, ["api_failed"]), 106: empty,
        107: ("events_written", None, "review_suspicious", 2, True, bare), 108: ("api_failed", None, "retry_failed", None, True, ["api_failed"]),
        200: ("article_dedup_skipped", None, None, None, False, ["article_level_redundancy_skip"]),
    }


def test_saved_once(spark, runs, tmp_path):
    for _ in range(2):
        N.save(spark, N.normalise(runs), str(tmp_path))
    counts = {n: spark.read.parquet(f"{tmp_path}/{n}").count() for n in [*N.KEYS, "shock_types"]}
    assert counts == {"events": 5, "channels": 1, "impacts": 1, "evidence": 2, "audit": 27 + 2 + 2 + 4, "shock_types": 1}
