"""Exact top-k against brute force where components are large, rows repeat and lengths differ."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from tidegraph.llm import topk


def brute(rows, k=5):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = collections.Counter()
    for a, (i, v) in enumerate(fine):
        if i % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, u, strict=True)), j) for b, (j, u) in enumerate(fine) if b != a and len(u) == len(v))[:k]
            out.update((i, n + 1, j, -s) for n, (s, j) in enumerate(best))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "copies": F.lit(2), "part": F.lit("x")})


def test_wide_components_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([rng.uniform(-1, 1), rng.uniform(-1, 1) * 2.0 ** rng.randrange(0, 18)]) for _ in range(3)]) for i in range(200)]
    rows += [(500, [1.0, 2.0]), (501, [600000.0, 1.0]), (502, [1.0, 1.0]), (503, [3.0, 0.0])]  # the first is the best
    rows += [(550, [1.0, 2.0])] * 3 + [(550, [2.0, 2.0]), (551, [-0.001, -0.0]), (600, [2.0**32 / 256, -(2.0**31) / 256]), (601, [2.0**22, 0.5])]
    rows += [(700, None), (701, [float("inf"), 1.0]), (702, [None, 1.0]), (703, []), (None, [1.0, 1.0])]
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 50 == 0, block_rows=70, query_rows=3).collect()
    assert collections.Counter(map(tuple, got)) == brute([r for r in rows if r[0] is not None])


def test_score_beyond_a_long_raises(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**40, 1.0])]
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(table(spark, rows), F.col("vec_id") % 50 == 0).collect()
