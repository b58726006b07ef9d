"""Sessions as a stream: any order of arrival, over restarts, gives what the table gives and what windows give."""

import hashlib
import random

import pandas as pd

from tidegraph.operators import retrieval as R
from tidegraph.streaming import sessions as S


def turns(n_sessions=6, seed=2):
    rng = random.Random(seed)
    rows = []
    for s in range(n_sessions):
        for i in range(rng.choice([1, 4, 9, 22])):
            name = rng.choice([None, "", "Acme $1", "Bolt\\2"])
            day = rng.choice([None, "2024-01-02"])
            rows.append((f"s{s}", i, rng.choice(["and what of their price?", "Same period again for it", "plain", ""]), name and f"c{name}", name, "ORG", day, rng.choice([None, "2024-02-03"]) if day else None, "a" * rng.choice([0, 5, 400])))
    return rows


SCHEMA = "session_id string, turn_index int, query string, canonical_name string, display_name string, entity_type string, date_start string, date_end string, answer string"


def collected(rows):
    return sorted(tuple(r) for r in rows)


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = turns()
    table = spark.createDataFrame(rows, SCHEMA)
    want = collected(S.session_turns(table).collect())
    assert len(want) == len(rows)
    shuffled = list(rows) + rows[:5]  # some turns come twice
    random.Random(1).shuffle(shuffled)
    (tmp_path / "in").mkdir()
    for part in range(3):  # each part is a run of its own over the same checkpoint: a restart
        spark.createDataFrame(shuffled[part::3], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = S.session_turns(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert collected(spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_batch_equals_windows(spark):
    """Rewriting and carried periods are what the window operators give; kept and history follow the rule."""
    table = spark.createDataFrame(turns(seed=9), SCHEMA)
    got = {(r.session_id, r.turn_index): r for r in S.session_turns(table).collect()}
    for r in R.resolve_references(table).collect():
        x = got[r.session_id, r.turn_index]
        assert (x.rewritten, x.start, x.end) == (r.rewritten, r.start, r.end)
    for (_, i), r in got.items():
        assert r.kept == (i + 1 if i < 8 else 3 + (i - 8) % 6)
        assert (r.history == "") == (i == 0) and r.history.count("\nTurn ") == min(i, 3)
        assert len([x for x in r.summary.split("\n") if x]) == (0 if i < 8 else 6 * ((i - 8) // 6 + 1))


def test_saved_sessions_go_on(spark, tmp_path):
    rows = turns(n_sessions=5, seed=4)
    first, rest = [r for r in rows if r[1] < 7], [r for r in rows if r[1] >= 7]
    path = str(tmp_path / "saved")
    S.save_sessions(S.final_sessions(spark.createDataFrame(first, SCHEMA)), path)
    (tmp_path / "saved" / "broken.json").write_text('{"session_id": "s0", "nex\n{"next": 3}\n')
    saved = S.load_sessions(spark, path)
    assert saved.count() == 5
    want = [r for r in collected(S.session_turns(spark.createDataFrame(rows, SCHEMA)).collect()) if r[1] >= 7]
    assert want and collected(S.session_turns(spark.createDataFrame(rest, SCHEMA), saved).collect()) == want
    assert S.session_turns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_digests_of_a_long_session(spark):
    """Digests are those of the texts, and a session's rows are handed on while it goes on, not held until its end."""
    rows = [("s", i, "q", "c", f"Name {i} é", "ORG", "2024-01-02", None, "a") for i in range(900)]
    table = spark.createDataFrame(random.Random(3).sample(rows, len(rows)), SCHEMA)
    sha = lambda c: hashlib.sha256(c.encode()).hexdigest()
    texts = {r.turn_index: (sha(r.history), sha(r.summary)) for r in S.session_turns(table).collect()}
    assert {r.turn_index: (r.history, r.summary) for r in S.session_turns(table, digests=True).collect()} == texts and len(texts) == 900
    other = lambda prior, turns: f"{len(turns)} after {len(prior)}"
    texts = {r.turn_index: (sha(r.history), sha(r.summary)) for r in S.session_turns(table, summarise=other).collect()}
    assert {r.turn_index: (r.history, r.summary) for r in S.session_turns(table, summarise=other, digests=True).collect()} == texts


def test_rows_are_handed_on_in_bounded_batches():
    class Value:
        def exists(self):
            return False

        def update(self, *_):
            pass

        put = updateValue = update

    p = S.SessionProcessor()
    p.head = p.recent = p.early = Value()
    turns = pd.DataFrame([(i, "q", "c", "n" * 200, "ORG", None, None, "a") for i in range(3000)], columns=S._FIELDS)
    sizes = [sum(map(len, b["history"])) + sum(map(len, b["summary"])) for b in p.handleInputRows(("s",), iter([turns]), None)]
    assert len(sizes) > 10 and max(sizes) < 2 * S.OUTPUT_CHARS + 2_000_000
