"""Batches through the index keep what one pass over all of them keeps; a replayed batch changes nothing; buckets are pruned."""

import datetime
import random

from pyspark.sql import functions as F
from test_near_dup_keep import brute

from tidegraph.operators.nlp import set_features
from tidegraph.streaming.near_index import NearIndex


def test_batches_equal_one(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for g in range(25):
        base = [f"g{g}.{k}" for k in range(rng.randrange(12, 120))]
        for k in range(6):
            w = list(base)
            for p in rng.sample(range(len(w)), rng.randrange(3)):
                w[p] = f"x{g}.{k}"
            rows.append((f"d{g:02}.{k}", " ".join(w), datetime.date(2024, 1 + k // 2, 1 + rng.randrange(28))))
    rows += [("e1", "", datetime.date(2024, 1, 2)), ("e2", " ", datetime.date(2024, 2, 2))]
    want = brute(rows)
    index = NearIndex(spark, str(tmp_path), buckets=32)
    batches = [spark.createDataFrame([r for r in rows if r[2].month == m], "id string, text string, day date") for m in (1, 2, 3)]
    got = [sorted(r.id for r in index.keep(b, i).collect()) for i, b in enumerate(batches)]
    assert sorted(sum(got, [])) == want
    assert sorted(r.id for r in index.keep(batches[1], 1).collect()) == got[1] and sorted(r.id for r in index.kept.read().collect()) == want
    one = set_features(spark.createDataFrame([rows[0]], "id string, text string, day date").select("id", F.col("day"), "text"), 5)
    plan = index.candidates(one, [0, 1, 2])._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
