"""Codes and clusters against plain k-means by comparing everything with everything, in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidegraph.llm import exponion as E


def floors(v, scale):
    return [math.floor(scale * x) if abs(x) < 2**53 else int(x) * scale for x in v]


def closest(x, entries):
    return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(entries))


def lloyd(points, entries, rounds):
    entries = [list(e) for e in entries]
    for _ in range(rounds):
        at = [closest(x, entries)[1] for x in points]
        for i in range(len(entries)):
            if own := [x for x, a in zip(points, at, strict=True) if a == i]:
                entries[i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return entries, [closest(x, entries) for x in points]


def brute_codes(rows, parts, entries, rounds, scale):
    kept = [(i, label, floors(v, scale)) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    sub = len(kept[0][2]) // parts
    codes, errors, books = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        xs = [v[p * sub : (p + 1) * sub] for _, _, v in kept]
        book, found = lloyd(xs, xs[:entries], rounds)
        books += [c for e in book for c in e]
        for n, (d, e) in enumerate(found):
            codes[n] += f"{e:02x}"
            errors[n] += d
    label = {}
    for (_, lab, _), e in zip(kept, errors, strict=True):
        label[lab] = label.get(lab, 0) + e
    h = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted((str(i), c, e, label[lab], h) for (i, lab, _), c, e in zip(kept, codes, errors, strict=True))


def brute_clusters(rows, k, rounds, scale, dims):
    kept = [(i, floors(v, scale)) for i, v, _ in rows if v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents, found = lloyd([v for _, v in kept], [v for _, v in seeds], rounds)
    own = {c: sum(d for d, e in found if e == c) for c in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((str(i), e, d, own[e], sum(own.values()), digest[e]) for (i, _), (d, e) in zip(kept, found, strict=True))


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, lab, "x", 1.0) for i, v, lab in rows], f"vec_id long, embedding array<{kind}>, label int, v string, code double")


def odd_rows(dims, wide=False):
    """Clumps, ties, repeats, negative floors, nulls everywhere; with wide ones, components that leave the 64-bit path."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, dims))
    rows = [(i, (centres[i % 9] + 0.1 * rng.normal(size=dims)).astype(np.float32).tolist(), i % 4 if i % 5 else None) for i in range(260)]
    rows += [(300 + i, [float(i % 3 - 1)] * dims, 7) for i in range(40)]  # ties
    rows += [rows[0], rows[0], (5, [0.25] * dims, 1), (None, [0.5] * dims, None)]
    rows += [(900, None, 1), (901, [], 1), (902, [None] * dims, 1), (903, [float("nan")] * dims, 1), (904, [float("inf")] * dims, 2), (905, [0.5] * (dims + 1), 2), (906, [0.5] * dims * 2, 2)]
    return rows + ([(907 + i, [(-1.0) ** i * 2.0 ** (13 + i)] * dims, 3) for i in range(4)] if wide else [])


def test_codes(spark):
    for wide in (False, True):
        rows = odd_rows(16, wide)
        got = E.vector_codes(table(spark, rows), parts=4, entries=12, rounds=2).collect()
        assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute_codes(rows, 4, 12, 2, 256)


def test_clusters(spark):
    for wide in (False, True):
        rows = odd_rows(8, wide)
        got = E.vector_clusters(table(spark, rows), k=6, rounds=10, dims=8).collect()
        assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute_clusters(rows, 6, 10, 1024, 8)


def test_few_and_none(spark):
    rows = [(1, [0.5, -0.5], None), (2, [0.5, -0.5], 1)]
    assert [(r.cluster, r.distance, r.inertia) for r in E.vector_clusters(table(spark, rows), k=8, dims=2).collect()] == [(0, 0, 0)] * 2
    assert [(r.code, r.error) for r in E.vector_codes(table(spark, rows), parts=2).collect()] == [("0000", 0)] * 2
    for none in (table(spark, rows).limit(0), table(spark, [(None, [0.5, 0.5], 1)])):
        assert E.vector_clusters(none, dims=2).count() == 0
    assert E.vector_codes(table(spark, rows).limit(0), parts=2).count() == 0
    with pytest.raises(Exception, match="OverflowError|too large"):  # a squared distance beyond 64 bits
        E.vector_clusters(table(spark, [(i, [x, 0.0], 1) for i, x in enumerate((1e30, -1e30, 3e30))], "double"), k=1, dims=2).collect()


def test_search_equals_full_scan():
    """Any start, any bounds that hold: the nearest entry, ties to the smaller, with fewer distances than a full scan."""
    rng = np.random.default_rng(1)
    for trial in range(40):
        k, d = int(rng.integers(1, 20)), int(rng.integers(1, 6))
        entries = rng.integers(-8, 9, (k, d))
        x = rng.integers(-9, 10, (200, d))
        near = E.Neighbours(entries)
        all_d = ((x[:, None] - entries[None]) ** 2).sum(2)
        want = all_d.argmin(1)
        start = rng.integers(0, k, 200)
        at, dist, _ = E.nearest(x, start, near)
        assert (at == want).all() and (dist == all_d.min(1)).all()
        exact = np.array([[math.isqrt(v - 1) + 1 if v else 0 for v in row] for row in all_d.tolist()])
        up = exact[np.arange(200), start] + rng.integers(0, 3, 200)
        others = np.array([min([math.isqrt(v) for j, v in enumerate(row) if j != s], default=E.UNKNOWN) for row, s in zip(all_d.tolist(), start, strict=True)])
        low = np.maximum(others - rng.integers(0, 3, 200), 0)
        at, up, low, _ = E.settle(x, start, up, low, near)
        assert (at == want).all()
        assert (up >= exact[np.arange(200), at]).all()
        for i, row in enumerate(all_d.tolist()):
            assert low[i] ** 2 <= min([v for j, v in enumerate(row) if j != at[i]], default=1 << 200)
    far = np.repeat(np.arange(16)[:, None] * 1000, 3, 1)
    x = far[rng.integers(0, 16, 500)] + rng.integers(-9, 10, (500, 3))
    _, _, measured = E.nearest(x, (x[:, 0] // 900).clip(0, 15), E.Neighbours(far))
    assert measured < 500 * 4


def test_roots():
    rng = random.Random(2)
    v = [0, 1, 2, 3, 4, (1 << 62) - 1, 1 << 62, *(rng.randrange(1 << 62) for _ in range(500)), *(rng.randrange(1 << 30) ** 2 for _ in range(200))]
    for a in (np.array(v, np.int64), np.array(v, object)):
        assert E.root_down(a).tolist() == [math.isqrt(x) for x in v]
        assert E.root_up(a).tolist() == [math.isqrt(x - 1) + 1 if x else 0 for x in v]
