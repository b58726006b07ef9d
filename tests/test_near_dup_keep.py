"""Greedy near-duplicate removal against brute force: exact copies and groups of near copies, ids not in date order."""

import datetime
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from tidegraph.functions import text as X
from tidegraph.operators import nlp


def brute(rows, words=5, similarity=0.86):
    kept = []
    for i, text, day in sorted(rows, key=lambda r: (r[2], r[0])):
        w = re.findall(r"[a-z0-9$_.-]+", text.lower())
        s = {tuple(w[k : k + words]) for k in range(max(len(w) - words, 0) + 1)} if w else set()
        if not any(s and t and len(s & t) >= similarity * len(s | t) for _, t in kept):
            kept.append((i, s))
    return sorted(i for i, _ in kept)


def test_groups_of_copies(spark):
    rng = random.Random(11)
    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(i % 90)
    same = " ".join(f"s{k}" for k in range(40))
    rows = [(i, same, day(i)) for i in (10, 95, 200, 400)]
    for g in range(12):
        base = [f"g{g}.{k}" for k in range(200)]
        for i in range(1000 * (g + 1), 1000 * (g + 1) + 15):
            w = list(base)
            for p in rng.sample(range(200), rng.randrange(4)):
                w[p] = f"x{i}"
            rows.append((i, " ".join(w), day(i * 37)))
    rows += [(1, "", day(1)), (2, " ", day(2))]
    got = nlp.near_dup_keep(spark.createDataFrame(rows, "id long, text string, d date"), "id", "text", "d")
    assert sorted(r.id for r in got.collect()) == brute(rows)


def test_short_texts_at_the_limit(spark):
    """Sets of 7 to 15 shingles, one more or less: none is lost, as independent minima lose about one pair in 10^6."""
    rng = random.Random(5)
    rows = []
    for k in range(400):
        w = [f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(11, 20))]
        for j, t in enumerate((w, w[:-1], [*w, "end"], [*w, "a", "b"])):
            rows.append((4 * k + j, " ".join(t), datetime.date(2024, 1, 1 + rng.randrange(28))))
    got = nlp.near_dup_keep(spark.createDataFrame(rows, "id long, text string, d date"), "id", "text", "d")
    assert sorted(r.id for r in got.collect()) == brute(rows)


def test_minima_are_independent():
    """Of sets of 8 and 7 shingles the minima agree as 64 independent draws would: in mean and in spread."""
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(4000):
        h = rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2)
        agree.append(int((nlp.minima(h) == nlp.minima(h[:7])).sum()))
    assert abs(np.mean(agree) / 64 - 7 / 8) < 0.005
    assert abs(np.var(agree) / (64 * 7 / 64) - 1) < 0.15


def test_words_of_a_long_text_are_split_once(spark):
    """Texts of 20,000 words, which took minutes while the words were split off again for each shingle."""
    rows = [(i, datetime.date(2024, 1, 1), " ".join(f"{i}.{k}" for k in range(20_000))) for i in range(8)] + [(8, datetime.date(2024, 1, 1), "\u212aelvin, two!"), (9, datetime.date(2024, 1, 1), None), (10, datetime.date(2024, 1, 1), "\u00e9")]
    began = time.time()
    got = {r.id: r.n for r in nlp.set_features(spark.createDataFrame(rows, "id long, day date, text string"), 5).collect()}
    assert got == dict.fromkeys(range(8), 19_996) | {8: 1}
    assert time.time() - began < 40


def test_hashes_are_those_of_kept_indices(spark):
    """XXH64 of the words of `dedup_tokens`, joined: an index that was written before is still good."""
    text = "\u212aelvin \u0130 A-b $5, caf\u00e9_x. seven, eight nine"
    low, w = spark.createDataFrame([(text,)], "t string").select(F.lower("t").cast("binary"), X.dedup_tokens(F.col("t"))).first()
    grams = spark.createDataFrame([(" ".join(w[i : i + 5]),) for i in range(len(w) - 4)], "g string").select(F.xxhash64("g").alias("h")).collect()
    assert nlp._shingle_hashes(bytes(low), 5).view(np.int64).tolist() == sorted({r.h for r in grams}, key=lambda h: h % 2**64)
