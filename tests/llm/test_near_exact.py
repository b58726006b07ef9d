"""Near-duplicates against brute force: every pair at the similarity is linked, in any size of group."""

import random
import re
from pathlib import Path

import numpy as np
import pytest

from tidegraph.llm import common, mixing, simhash


def brute(texts, words=5, similarity=0.8):
    """The least index of each text's component over all pairs at the similarity."""
    sets = [set(simhash.shingles(t, words)) for t in texts]
    number = {}
    for s in sets:
        for g in s:
            number.setdefault(g, len(number))
    held = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        held[i, [number[g] for g in s]] = 1
    both = held @ held.T
    n = held.sum(1)
    union = n[:, None] + n[None, :] - both
    near = (both >= similarity * union - 1e-6) & (n[:, None] > 0) & (n[None, :] > 0)
    root = np.arange(len(sets))
    while True:
        low = np.where(near, root[None, :], len(sets)).min(1)
        low = np.minimum(low, root)
        if (low == root).all():
            return root.tolist()
        root = low


def found(spark, texts, **kw):
    rows = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **kw).collect()
    return [r.component_id for r in sorted(rows, key=lambda r: r.doc_id)]


def test_hub_group(spark):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for k in range(1500):
        w = list(base)
        for p in rng.sample(range(2, 298, 5), 6):  # six edits lose 30 of 296 shingles: 0.82 of the base, below 0.8 of others
            w[p] = f"x{k}.{p}"
        texts.append(" ".join(w))
    texts.append(" ".join(base))  # the greatest id
    want = brute(texts)
    assert set(want) == {0}
    assert found(spark, texts) == want


def test_unit_blocks_meet_once():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 1 << 63, (40, 16)).astype(np.uint64)
    bits[20:] = bits[:20]
    ids, n, side = np.arange(40), np.full(40, 100), np.repeat([0, 1], 20)
    two = [ids, ids, n, side, np.zeros(40, int), np.ones(40, int), np.ones(40, int), bits]
    out = simhash._met(two, 0.8, 0)
    assert sorted(zip(out[0].tolist(), out[1].tolist(), strict=True)) == [(i, i + 20) for i in range(20)]
    one = [*two[:3], np.zeros(40, int), np.zeros(40, int), np.zeros(40, int), *two[6:]]
    assert len(simhash._met(one, 0.8, 0)[0]) == 20
    many = [ids, ids // 20, n, side, *two[4:7], np.repeat(bits[:1], 40, axis=0)]  # all equal, two roots
    assert simhash._met(many, 0.8, 0).shape[1] == 400
    out = simhash._met(many, 0.8, 3)
    assert out.shape[1] == 3 and out[4].all()


def test_short_texts_and_repeats(spark):
    rng = random.Random(5)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for _ in range(200):  # 4 of 5 shingles shared: 0.8
        w = new(9)
        texts += [" ".join(w[:8]), " ".join(w)]
    for _ in range(50):  # a passage once and twenty times: the same set but for the seams
        w, passage = new(104), new(24)
        texts += [" ".join(w + passage), " ".join(w + passage * 20)]
    for edits in (4, 5, 6):  # 0.82, 0.78 and 0.74 at least
        for _ in range(100):
            w = new(204)
            v = list(w)
            for p in rng.sample(range(4, 200), edits):
                v[p] = "changed"
            texts += [" ".join(w), " ".join(v)]
    assert found(spark, texts) == brute(texts)


def test_recall_at_the_limit(spark):
    """Pairs planted at 0.80 to 0.86 are all found, by groups large and small."""
    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for _ in range(300):
        w = new(rng.randrange(60, 400))
        v = list(w)
        while True:
            u = list(v)
            u[rng.randrange(len(u))] = f"e{rng.randrange(10**9)}"
            a, b = (set(simhash.shingles(" ".join(t), 5)) for t in (w, u))
            if len(a & b) < 0.8 * len(a | b):
                break
            v = u
        texts += [" ".join(w), " ".join(v)]
    assert found(spark, texts) == brute(texts)


def test_rows(spark):
    """Nulls, repeats, an id with two texts, extra columns, empty tables: one row a group stays."""
    long = " ".join(f"t{i}" for i in range(40))
    rows = [(7, long, "x", 1), (3, long, "x", 2), (3, long, "x", 2), (3, long + " more", "x", 2), (None, long, "x", 3), (None, None, "x", 1), (None, "", "x", 1), (None, " \n", "x", 1), (9, "other", "x", 1), (9, "others", "x", 1), (None, "alone", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string, cls int")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {str(r.doc_id) for r in got if r.keep} == {"3", "9", "None"} and {r.component_id for r in got} == {3, 9, None}
    classes = simhash.near_classes(docs)
    assert classes.where("keep").count() == classes.select("root").distinct().count() == 5
    assert simhash.near_classes(docs.limit(0)).count() == simhash.near_duplicates(docs.limit(0)).count() == 0


def test_postings_leave_out_what_cannot_be_similar(spark):
    """A shared shingle that is the last of two prefixes, or of sets of too different size, can't be the first of a similar pair."""
    rows = [(1, 10, [5, 6, 7]), (2, 10, [3, 4, 7]), (3, 10, [8, 9, 11]), (4, 10, [8, 12, 13]), (5, 10, [20, 21, 22]), (6, 13, [20, 23, 24])]
    sets = spark.createDataFrame(rows, "id long, n long, prefix array<bigint>")
    assert sorted((r.key, r.id) for r in simhash._prefix_postings(sets, 0.8).collect()) == [(8, 3), (8, 4)]


def test_staged_tables_go(spark):
    """Of the tables that a call stages only the last and the components' are left."""
    texts = [" ".join(f"t{i // 2}.{k}" for k in range(40)) + f" {i}" for i in range(40)]
    root = lambda: Path(simhash.staged(spark.range(1), "probe").inputFiles()[0].removeprefix("file://")).parents[1]
    before = set(root().iterdir())
    classes = simhash.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    left = {p.name.split("-")[0] for p in set(root().iterdir()) - before}
    assert left <= {"classes", "small", "edges", "often", "texts", "probe"}
    assert classes.where("keep").count() == 20


def dealt(df):
    """The columns by which the plan deals rows anew."""
    return set(re.findall(r"hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString()))


@pytest.fixture
def no_small_tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("words", [1, 1 << 19])
def test_sieve_keeps_every_key(spark, monkeypatch, words):
    monkeypatch.setattr(common, "SIEVE", words)
    rows = spark.createDataFrame([(i if i else None, f"t{i}") for i in range(3000)], "k long, t string")
    out = common.sieved(rows, spark.createDataFrame([(i,) for i in (5, 5, 70, 2999, -1)], "k long"), "k")
    got = {r.t: r["_maybe"] for r in out.collect()}
    assert out.columns == ["k", "t", "_maybe"] and len(got) == 3000 and got["t5"] and got["t70"] and got["t2999"]
    assert not got["t0"] and (sum(got.values()) < 10 if words > 1 else sum(got.values()) < 1000)


def test_texts_of_pairs_are_not_dealt(spark, monkeypatch, no_small_tables):
    plans, write = {}, simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, name: plans.setdefault(name, dealt(df)) and None or write(df, name))
    texts = [" ".join(f"t{i // 2}.{k}" for k in range(40)) + f" {i}" for i in range(40)]
    assert found(spark, texts) == [i // 2 * 2 for i in range(40)]
    assert plans["texts"] <= {"_word"}


@pytest.mark.parametrize("words", [1, 1 << 19])
def test_stage_keeps_one_row_of_a_group(spark, monkeypatch, words):
    import corpus_pipeline as P

    monkeypatch.setattr(common, "SIEVE", words)
    text = lambda i: " ".join(f"t{i}.{k}" for k in range(40))
    rows = [(i, text(i)) for i in range(20)] + [(30 + i, text(i)) for i in range(5)] + [(40 + i, text(5 + i) + " more") for i in range(5)] + [(3, text(3)), (50, None), (51, ""), (None, text(60)), (None, text(60)), (2, text(61))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in P.dedup_stage(spark, docs, "").collect()), key=str)
    assert got == sorted([*((i, text(i)) for i in range(20)), (50, None), (None, text(60)), (2, text(61))], key=str)


def test_drawn_rows(spark, no_small_tables):
    """The rows of mixed_rows, without dealing a text."""
    rows = [(i, f"w{i} " * (i % 13), f"s{i % 4}") for i in range(600)] + [(None, None, None), (None, "a b", None), (1000, "a", None), (1000, "a", None), *[(2000, "x " * 9, "s1")] * 70]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights, per_block in (((3, 1, 2), 4), ((1, 5, 1), 64)):
        mix = common.staged(mixing.mix_sources(docs, weights=weights, docs_per_block=per_block), "mix")
        want = mixing.mixed_rows(docs, mix).drop("mix_shard")
        got = mixing.drawn_rows(docs, mix, docs_per_block=per_block)
        assert dealt(got) == set() and dealt(want)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_mixing_stage_deals_no_text(spark, no_small_tables):
    import corpus_pipeline as P

    docs = spark.createDataFrame([(i, f"w{i} " * 5, "en", f"s{i % 4}", 1) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.mixing_stage(spark, docs, "")
    assert dealt(out) == set() and out.count() > 300
