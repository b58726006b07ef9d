"""The gate in order; batches that are broken off and replayed write nothing twice; lookups read the touched buckets only."""

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import gate, nlp
from tidegraph.streaming.ingest import LedgerTable, staged_pass

ARTICLES = "ord int, article_id string, url string, status string, text string, published string, scraped_at string"


def words(tag, n=90):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_gate(spark):
    near = words("n").split()
    rows = [
        (0, "a", "u0", "ok", words("x"), "2024-03-05", None), (1, "b", "u1", None, f"  {words('x')}\n", "2024-03-01", None), (2, "c", "u2", "error", words("y"), None, None), (3, "d", "u3", "ok", words("y", 79), None, None), (4, "e", "u4", "ok", None, None, None),
        (5, None, "u5", "ok", words("z"), "not a date", "2023-12-31T10:00:00"), (6, "", "u6", "ok", words("w"), None, None), (7, "known", "u7", "ok", words("v"), "2024-01-01", None), (8, "n2", "u9", "ok", " ".join(near), "2024-02-02", None),
        (9, "n1", "u8", "ok", " ".join([*near[:-1], "end"]), "2024-02-02", None), (10, "n0", "u1", "ok", " ".join([*near, "more"]), "2024-02-03", None),
    ]
    table = spark.createDataFrame(rows, ARTICLES)
    skip = spark.createDataFrame([("known",)], "article_id string")
    now = F.lit("2024-05-06 07:08:09")
    got = {r.ord: (r.period_key, r.article_id) for r in gate.article_gate(table, now, skip).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "2024-03", 5: "2023-12", 6: "2024-05", 9: "2024-02"}
    assert got[0][1] == "a" and len(got[5][1]) == len(got[6][1]) == 32
    plain = gate.article_gate(table, now, near=False)
    assert sorted(r.ord for r in plain.collect()) == [0, 5, 6, 7, 8, 9, 10]
    assert gate.article_gate(table.limit(0), now).count() == 0


def tables(spark, folder):
    a = spark.createDataFrame([], "article_id string, text string").schema
    c = spark.createDataFrame([], "chunk_id string, article_id string, chunk_index int, chunk string, token_count int").schema
    return LedgerTable(spark, f"{folder}/articles", a, "article_id", [F.col("text")], 8), LedgerTable(spark, f"{folder}/chunks", c, "chunk_id", [F.col("chunk_index")], 8)


def test_replay_writes_nothing_twice(spark, tmp_path):
    articles, chunks = tables(spark, str(tmp_path))
    batch = lambda *ids: spark.createDataFrame([(i, f"Text of {i}. More.") for i in ids], "article_id string, text string")
    cut_texts = lambda df: nlp.chunks(df, "article_id", "text")
    run = staged_pass(articles, chunks, lambda df: df, cut_texts)
    run(batch("a", "b", "a"), 0)

    def broken(df):
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        staged_pass(articles, chunks, lambda df: df, broken)(batch("b", "c"), 1)  # articles are written, chunks aren't
    articles.unknown(batch("d"), 2).select("article_id", "text", "bucket").write.partitionBy("bucket").parquet(f"{tmp_path}/articles/data/batch=2")  # broken off before its ledger entry
    assert sorted(r.article_id for r in articles.read().collect()) == ["a", "b", "c"] and articles.batches() == [0, 1] and chunks.batches() == [0]
    for _ in range(2):  # replays, twice
        run(batch("b", "c"), 1)
        run(batch("d", "a"), 2)
    assert sorted(r.article_id for r in articles.read().collect()) == ["a", "b", "c", "d"]
    assert sorted(r.chunk_id for r in chunks.read().collect()) == [f"{i}::chunk::0" for i in "abcd"]
    plan = articles.unknown(batch("a"), 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_stream(spark, tmp_path):
    articles, chunks = tables(spark, str(tmp_path / "t"))
    run = staged_pass(articles, chunks, lambda df: df, lambda df: nlp.chunks(df, "article_id", "text"))
    for part in (("a", "b"), ("b", "c")):
        spark.createDataFrame([(i, f"Text of {i}.") for i in part], "article_id string, text string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        spark.readStream.schema("article_id string, text string").json(str(tmp_path / "in")).writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.article_id for r in articles.read().collect()) == ["a", "b", "c"] and chunks.read().count() == 3
