"""op11's operator against brute force: every pair at the similarity is linked, whatever sketches and stars miss."""

import collections
import random

import numpy as np
import xxhash

from tidegraph.llm import minhash, simhash


def brute(texts, percent):
    """The least index of each text's component; texts without words stand alone."""
    sets = [frozenset(simhash.shingles(t or "", 5)) for t in texts]
    held = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            held[g].append(i)
    both = collections.Counter((a, b) for ids in held.values() for a in ids for b in ids if a < b)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), k in both.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def check(spark, texts, percent=85, **how):
    got = sorted(minhash.minhash_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), similarity=percent / 100, **how).collect(), key=lambda r: r.doc_id)
    roots, sizes = brute(texts, percent)
    assert [r.component_id for r in got] == roots
    assert [r.n_shingles for r in got] == sizes
    assert [r.kept for r in got] == [i == x for i, x in enumerate(roots)]


def edited(rng, words, least):
    """A copy edited word by word while its sets are at `least` or more."""
    v = list(words)
    own = set(simhash.shingles(" ".join(words), 5))
    while True:
        u = list(v)
        u[rng.randrange(len(u))] = f"e{rng.randrange(10**9)}"
        s = set(simhash.shingles(" ".join(u), 5))
        if len(own & s) < least * len(own | s):
            return v
        v = u


def some_texts():
    rng = random.Random(4)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = [None, "", " \n", "a", "A", "a b c d", "A b  c d", "a b c d e", "a b c d e f"]
    passage = new(70)
    for _ in range(60):  # short and long pairs at the limit, below it, and a passage in many
        w = new(rng.randrange(12, 300))
        texts += [" ".join(w), " ".join(edited(rng, w, 0.85)), " ".join(edited(rng, w, 0.84)), " ".join(new(40) + passage + new(40)), " ".join(passage + new(3))]
    for n in range(8, 18):  # one shingle more or less around the limit
        w = new(n + 4)
        texts += [" ".join(w), " ".join(w[:-1]), " ".join([*w, "x"])]
    hub = new(300)
    for k in range(400):
        w = list(hub)
        for p in rng.sample(range(2, 298, 5), 4):
            w[p] = f"x{k}.{p}"
        texts.append(" ".join(w))
    texts.append(" ".join(hub))
    long = new(9000)
    texts += [" ".join(long), " ".join(edited(rng, long, 0.855)), " ".join(long[:4500] + new(4500)), " ".join(new(20000)), "w " * 20000]
    return texts + [texts[9], texts[9].upper(), texts[12]]


def test_components(spark):
    check(spark, some_texts())


def test_exact_rest_alone(spark):
    """Sketches that find next to nothing lose no link."""
    check(spark, some_texts()[:300], band_rows=64)


def test_rows(spark):
    """Null and repeated ids, repeated rows, extra columns with clashing names, empty tables."""
    long = " ".join(f"t{i}" for i in range(40))
    rows = [(7, long, "x", 1), (3, long, "x", 2), (3, long, "x", 2), (3, long + " more", "x", 2), (3, "alone", "x", 1), (None, long, "x", 3), (None, None, "x", 1), (None, "", "x", 1), (9, "", "x", 1), (None, "solo", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, n int")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.minhash_components(docs).collect())
    assert got == collections.Counter({(7, 36, 3, False): 1, (3, 36, 3, True): 2, (3, 37, 3, True): 1, (3, 1, 3, True): 1, (None, 36, 3, False): 1, (None, 0, None, True): 2, (9, 0, 9, True): 1, (None, 1, None, True): 1})
    assert minhash.minhash_components(docs.limit(0)).count() == 0


def test_sketch():
    """Least hash of a filled bin; an empty one borrows by its own probes; equal bins agree as often as sets overlap."""
    rng = np.random.default_rng(0)
    probes = minhash.probe_table(64)
    for n in (1, 2, 5, 64, 400):
        h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        bins = {}
        for x in h.tolist():
            bins.setdefault(x >> 58, x)
        want = [bins[i] if i in bins else bins[next(p for p in probes[i].tolist() if p in bins)] for i in range(64)]
        assert minhash.sketch(h, 64, probes).tolist() == want
    agree, total = 0, 0
    for k in range(300):
        h = [xxhash.xxh64_intdigest(f"{k}.{i}") for i in range(120)]
        x, y = (minhash.sketch(np.sort(np.array(v, np.uint64)), 64, probes) for v in (h[:110], h[10:]))
        agree, total = agree + int((x == y).sum()), total + 64
    assert abs(agree / total - 100 / 120) < 0.03


def test_long_sets_are_told_apart_exactly():
    rng = np.random.default_rng(5)
    for n, shared in ((2000, 1900), (2000, 1400), (9000, 4000)):
        for m in (n, n // 2 + 300):
            h = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64))
            x, y = np.sort(h[:n]), np.sort(h[min(n, len(h)) - min(shared, m) :][:m])
            inter = len(np.intersect1d(x, y))
            near = inter >= 0.8 * (len(x) + len(y) - inter)
            may = simhash._may_be_near(len(x), simhash.wide_bitmap(x) or simhash.parity_bitmap(x, 1024), len(y), simhash.wide_bitmap(y) or simhash.parity_bitmap(y, 1024), 0.8)
            assert may or not near
    x, y = (np.unique(rng.integers(0, 1 << 63, 9000, dtype=np.uint64)) for _ in range(2))
    assert not simhash._may_be_near(len(x), simhash.wide_bitmap(x), len(y), simhash.wide_bitmap(y), 0.8)
