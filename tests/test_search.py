"""Retrieval, knowledge and extraction operators that SQL doesn't state, on small fixtures; sources."""

import datetime
import json

import pyarrow as pa
from pyspark.sql import functions as F

from tidegraph.functions import intents as I
from tidegraph.functions import text as X
from tidegraph.operators import search as S
from tidegraph.sources import files
from tidegraph.streaming import counts


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first().asDict(recursive=True)


def test_expressions(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    got = one(
        spark, best=I.best_time_expression(arr("last week", "in May 2024", "Q3 2025 ", "a very long expression")), none=I.best_time_expression(F.array().cast("array<string>")),
        hops=I.hops_of(F.lit('Sure: {"hops": [{"cause": "oil", "effect": "cpi", "query": "q"}]} ok')), broken=I.hops_of(F.lit("no json")),
        epoch=I.epoch(F.lit("2024-01-02").cast("date")), vec=S.parse_vector(F.lit("[1, 2.5]")), bad=S.parse_vector(F.lit("x")),
        hard=I.is_hard_include(F.lit("BLS"), F.lit(None).cast("string")), soft=I.is_hard_include(F.lit(None).cast("string"), F.lit("Sports")), h=X.content_hash(F.lit("a b\n")), g=X.content_hash(F.lit("\t a b")),
    )
    assert got["best"] == "in May 2024" and got["none"] is None and got["hops"] == [{"cause": "oil", "effect": "cpi", "query": "q"}] and got["broken"] is None
    assert got["epoch"] == 1704153600 and got["vec"] == [1.0, 2.5] and got["bad"] is None and got["hard"] and not got["soft"] and got["h"] == got["g"]


def test_semantic_near_dup(spark):
    rows = [(1, 1, [1.0, 0.0], "x"), (1, 2, [1.0, 0.01], "y"), (1, 3, [0.0, 1.0], "z"), (1, 4, None, "alpha beta gamma"), (1, 5, None, "Gamma beta alpha"), (1, 6, None, None), (2, 1, [1.0, 0.0], "x")]
    got = S.semantic_near_dup(spark.createDataFrame(rows, "q int, at int, embedding array<double>, text string"), "q", "at").collect()
    assert sorted((r.q, r["at"]) for r in got) == [(1, 1), (1, 3), (1, 4), (1, 6), (2, 1)]


def test_knowledge(spark):
    m = spark.createDataFrame([(5, "Acme", "", "2024-01", 9, 2), (5, "Acme Co", "ORG", "2024-01", 8, 3), (5, "Acme", "ORG", "2024-01", 9, 4)], "entity_id int, display_name string, entity_type string, period_key string, chunk_id int, ord int")
    node = S.knowledge_nodes(m).first()
    assert node.asDict() == {"entity_id": 5, "period_key": "2024-01", "display_name": "Acme", "entity_type": "ORG", "ticker": None, "source_chunks": [9, 8]}
    chunks = spark.createDataFrame([(9, "Acme rose. Others fell. So did acme bonds."), (8, "Nothing here.")], "chunk_id int, text string")
    units = S.knowledge_units(m, chunks)
    assert {r.chunk_id: r.text for r in units.collect()} == {9: "Acme rose. So did acme bonds.", 8: "Nothing here."}
    assert S.node_descriptions(units).first().description == "Acme rose. So did acme bonds. Nothing here."


def test_sources(spark, tmp_path):
    payload = {"scraped_at_utc": "t", "count": 2, "articles": [{"url": "u1", "title": "a", "text": "x"}, {"url": "u2", "status": "error"}]}
    (tmp_path / "drop.json").write_text(json.dumps(payload))
    got = files.read_scrapes(spark, str(tmp_path / "drop.json")).select("url", "status", "scraped_at_utc").collect()
    assert sorted(map(tuple, got)) == [("u1", "ok", "t"), ("u2", "error", "t")]
    (tmp_path / "t.csv").write_text("ticker,company_name,aliases\nACM,Acme Holdings Inc,The Acme;Ac-me\nZZZ,Acme Holdings Inc,\n")
    alias = {r.alias: r.ticker for r in files.read_aliases(spark, str(tmp_path / "t.csv")).collect()}
    assert alias == {"acm": "ACM", "zzz": "ZZZ", "acme holdings inc": "ZZZ", "acme": "ZZZ", "the acme": "ACM", "ac-me": "ACM"}
    table = str(tmp_path / "articles")
    rows = lambda *x: spark.createDataFrame(x, "k long, v string")
    files.append_new(spark, rows((1, "a"), (1, "b")), table, "k", [F.col("v")])
    files.append_new(spark, rows((1, "z"), (2, "c")), table, "k", [F.col("v")])
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [(1, "a"), (2, "c")]


def test_context(spark):
    rows = spark.createDataFrame([(1, 2, "S2", None, None, "b  c"), (1, 1, "S1", "BBC", datetime.date(2024, 1, 2), "a")], "q int, at int, label string, source string, published date, text string")
    assert S.context_block(rows, "q", "at").first().context == "[S1] BBC (2024-01-02): a\n[S2] unknown (unknown): b c"


def test_stream_equals_batch(spark, tmp_path):
    """Each id counts once a period, whatever files it comes in; late rows within the watermark count."""
    day = lambda d: datetime.datetime(2024, 1, d, 12)
    for part in ([(1, day(1), "x"), (2, day(1), "x")], [(2, day(1), "x"), (3, day(2), "y")]):
        spark.createDataFrame(part, "id long, at timestamp, source string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, at timestamp, source string").parquet(str(tmp_path / "in"))
    run = counts.period_counts(stream, "id", "at", "source").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counted").collect())) == [("2024-01", "x", 2), ("2024-01", "y", 1)]


def test_best_matches_prunes_exactly(spark):
    """Against all pairs: ties by copies, conditions, gaps; hardly any pair has its words compared."""
    import random
    import re

    import numpy as np

    from tidegraph.operators import batch_search as B

    rng, r = np.random.default_rng(4), random.Random(4)
    texts = [" ".join(f"word{r.randrange(60)}" for _ in range(12)) for _ in range(300)]
    vecs = rng.normal(size=(300, 8)).round(2).tolist()
    rows = [(i, texts[i % 300], vecs[i % 300] if i % 11 else None, datetime.date(2024, 1, 1 + i % 28) if i % 5 else None, f"p{i % 3}", f"s{i % 4}") for i in range(900)]
    asks = [(i, texts[-1 - i] if i % 7 else None, rng.normal(size=8).tolist() if i % 9 else None, ["p0", "p2"] if i % 4 == 0 else None, datetime.date(2024, 1, 9) if i % 3 == 0 else None, None, "s1" if i % 5 == 0 else None) for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, embedding array<double>, published date, period_key string, source string")
    questions = spark.createDataFrame(asks, "question_id long, text string, vector array<double>, periods array<string>, start date, end date, source string")
    got = {}
    for x in B.best_matches(chunks, questions, 5).collect():
        got.setdefault(x.question_id, []).append((-round(x.score, 9), x.chunk_id))
    for q, text, v, periods, start, _, source in asks:
        words = set(re.findall("[a-z0-9]{3,}", text or ""))
        want = []
        for i, t, e, day, p, s in rows:
            if e is None or (periods and p not in periods) or (start and (day is None or day < start)) or (source and s != source):
                continue
            cos = float(np.dot(v, e) / np.linalg.norm(v) / np.linalg.norm(e)) if v else 0.0
            want.append((-round(0.85 * cos + 0.15 * len(words & set(t.split())) / max(len(words), 1), 9), i))
        assert sorted(got[q]) == sorted(want)[:5]
    asked = B.Asked(questions.withColumn("words", B._words(F.col("text"))).collect())
    held = asked.held(pa.array([[int(w) for w in asked.number[:3]], []], pa.list_(pa.int64())))
    assert held.sum() == 3 and asked.overlap(held, np.array([0, 1]), np.array([1, 1])).tolist() == [0, 0]


def test_summary_pools_against_brute_force(spark, monkeypatch):
    """Questions meet their pool's rows in their own task, over several blocks of pools: gaps, ties, sources."""
    import numpy as np

    from tidegraph.operators import batch_search as B

    rng = np.random.default_rng(8)
    vecs = rng.normal(size=(20, 4)).tolist()
    rows = [(i, i % 6, vecs[i % 20] if i % 7 else None, datetime.date(2024, 1, 1 + i % 20) if i % 5 else None, "p", (None, "", "A", " a ", "b")[i % 5]) for i in range(120)]
    chunks = spark.createDataFrame(rows, "chunk_id long, article_id long, embedding array<double>, published date, period_key string, source string")
    asks = [(q, vecs[q] if q % 4 else None, None, datetime.date(2024, 1, 2 + q % 5) if q % 3 else None, None, None) for q in range(15)]
    questions = spark.createDataFrame(asks, "question_id long, vector array<double>, periods array<string>, start date, end date, source string")
    monkeypatch.setattr(B, "POOL_BLOCK", 2)
    found = B.summary_candidates(questions, chunks, F.lit("2024-01-25").cast("date"), newest=30, k=7)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # pairs were joined, with both vectors
    got = {}
    for r in found.collect():
        got.setdefault(r.question_id, set()).add((r.chunk_id, r.article_id, r.source, r.published, round(r.score, 9), r.kind))
    for q, v, _, start, _, _ in asks:
        pool = sorted((r for r in rows if not start or (r[3] and r[3] >= start)), key=lambda r: (r[3] is None, -(r[3].toordinal() if r[3] else 0), r[0]))[:30]
        cos = lambda e: np.dot(v, e) / np.linalg.norm(v) / np.linalg.norm(e) if v and e else 0.0  # noqa: E731, B023
        score = lambda r: -round(float(0.7 * cos(r[2]) + (0.3 * np.exp(-(25 - r[3].day) / 2.0) if r[3] else 0)), 9)  # noqa: E731, B023
        scored = sorted(((score(r), r[0], r) for r in pool), key=lambda x: x[:2])
        seen, want = set(), set()
        for s, _, r in scored:
            outlet = (r[5] or "unknown").strip().lower()
            if len(want) < 7:
                want.add((r[0], r[1], r[5], r[3], -s, "summary_recency_semantic" if outlet in seen else "summary_diverse_source"))
            seen.add(outlet)
        assert got[q] == want


def test_a_chunk_is_split_once_for_all_its_entities(spark):
    rows = [(1, f"E{i}", f"name{i}", i, "p") for i in range(40)] + [(2, "E1", "name1", 0, "p"), (3, "e2", None, 0, "p")]
    mentions = spark.createDataFrame(rows, "chunk_id long, entity_id string, display_name string, ord int, period_key string")
    text = " ".join(f"Of Name{i}! Again NAME{i} here. Name{i}? Name{i} once more." for i in range(40, -1, -1))
    units = S.knowledge_units(mentions, spark.createDataFrame([(1, text), (2, None), (3, "Nothing said.")], "chunk_id long, text string"))
    got = {(r.chunk_id, r.kn_uid): r.text for r in units.collect()}
    assert len(got) == 42 and got[1, "e7::p"] == "Of Name7! Again NAME7 here. Name7?" and got[2, "e1::p"] is None and got[3, "e2::p"] == "Nothing said."
    plan = units._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and plan.index("Generate explode") < plan.index("Join Inner")  # the text is joined a chunk, not a mention
