"""Integer k-means by Exponion search: codes of vector parts, and clusters of whole vectors.

A search starts at the entry a row had before. With u the row's distance to it, any entry as near lies within 2u of that
entry, so only the entries of its distance-sorted list of neighbours inside that radius are measured. Radii are inclusive
and distances whole numbers, so that ties go to the smaller index exactly. Clusters also carry an upper and a lower bound a
row, with which most rows are settled without a distance.

Spark deals out the rows; a task holds a slice of a batch and the entries. What meets on the driver are the entries and, each
round, one sum for each entry and component. Every round is a written table, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import BROADCAST_ROWS, sliced, staged, unstage

#: Components of this size and more are reckoned as Python integers, the others in 64 bits, which hold nine times the squared
#: distance of up to MOST_DIMS of them.
WIDE = 1 << 23
MOST_DIMS = 2048
#: An upper bound that says nothing, and the largest lower bound that is kept.
UNKNOWN = 1 << 61
SLICE = 4096


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact for every finite x: 64-bit integers, or Python's where a component is wide."""
    with np.errstate(over="ignore"):
        x = np.floor(scale * values.astype(np.float64))
    if not x.size or np.abs(x).max() < WIDE:
        return x.astype(np.int64)
    whole = lambda t: int(t) * scale if abs(t) >= 2.0**53 else math.floor(t * scale)
    return np.array([whole(t) for t in values.astype(np.float64).ravel().tolist()], object).reshape(values.shape)


def int_array(rows: list[list[int]]) -> np.ndarray:
    """Entries as 64-bit integers where that is safe, else as Python's."""
    a = np.array(rows, object)
    return a.astype(np.int64) if not a.size or max(abs(t) for t in a.ravel()) < WIDE else a


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(-1)


def root_up(v: np.ndarray) -> np.ndarray:
    """The least integer whose square is v or more."""
    if v.dtype == object:
        return np.array([math.isqrt(t - 1) + 1 if t else 0 for t in v.tolist()], object)
    r = np.ceil(np.sqrt(v.astype(np.float64))).astype(np.int64)
    r -= (r > 0) & ((r - 1) * (r - 1) >= v)
    return r + (r * r < v)


def root_down(v: np.ndarray) -> np.ndarray:
    up = root_up(v)
    return up - (up * up > v)


class Neighbours:
    """Entries with, for each, all entries by their distance to it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = squared(entries[:, None, :], entries[None, :, :])
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, 1)  # squared, ascending

    def within(self, start: np.ndarray, radius2: np.ndarray) -> np.ndarray:
        """How many of the start entry's neighbours, itself among them, lie inside the squared radius or on it."""
        m = np.ones(len(start), np.int64)
        for a in np.unique(start):
            at = start == a
            m[at] = np.searchsorted(self.gaps[a], radius2[at], "right")
        return m

    def scan(self, x: np.ndarray, start: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, squared distance, squared distance of the next best) among the m nearest neighbours of start; ties to the
        smaller entry. The third is meaningless where m is 1."""
        ends = np.cumsum(m)
        row = np.repeat(np.arange(len(x)), m)
        entry = self.order[start[row], np.arange(ends[-1]) - (ends - m)[row]]
        d = squared(x[row], self.entries[entry])
        best = np.minimum.reduceat(d, ends - m)
        first = np.minimum.reduceat(np.where(d == best[row], entry, len(self.entries)), ends - m)
        other = np.minimum.reduceat(np.where(entry == first[row], (1 << 400) if d.dtype == object else np.iinfo(np.int64).max, d), ends - m)
        return first, best, other


def nearest(x: np.ndarray, start: np.ndarray, near: Neighbours) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance, entries measured) of each row's nearest entry, searched from start within twice its distance."""
    m = near.within(start, 4 * squared(x, near.entries[start]))
    entry, d, _ = near.scan(x, start, m)
    return entry, d, int(m.sum())


def _vectors(column: pa.ListArray, scale: int) -> np.ndarray:
    return whole_numbers(column.flatten().to_numpy(zero_copy_only=False), scale).reshape(len(column), -1)


def _usable(vector: Column) -> Column:
    """Whether no component is null, NaN or infinite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def _merged(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Sums of (slot, place, s) rows by slot and place: as many rows as the entries have components, and one each for the count."""
    rows = parts.groupBy("slot", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return {(r.slot, r.place): int(r.s) for r in rows}


def _sum_rows(sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """sums: (slot, place). The counts go as place -1. Only slots that have anything are sent."""
    slots = np.flatnonzero((counts != 0) | (sums != 0).any(1))
    width = sums.shape[1]
    values = np.concatenate([sums[slots], counts[slots, None]], axis=1).ravel().tolist()
    place = np.tile(np.r_[np.arange(width), -1], len(slots))
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(slots, width + 1), pa.int32()), pa.array(place, pa.int32()), pa.array([str(v) for v in values], pa.string())], ["slot", "place", "s"])


_SUMS = "slot int, place int, s string"


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): a product code of each vector, with its squared error.

    Components become floor(scale * x); vectors are cut into `parts` equal parts, each with a codebook of up to `entries`
    (256 at most) that starts as that part of the smallest vec_ids (nulls last, ties by the vector). Each round assigns
    all parts and replaces every used entry by the floored mean of its parts; then parts are assigned once more.

    Vectors that are null or hold a null or non-finite component take no part; nor do those whose length isn't a
    positive multiple of `parts`, or isn't that of the first vector. Repeated rows and ids are rows of their own. Components
    of any finite size are exact; an error beyond 64 bits raises. An empty table gives an empty result; extra columns
    are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(_usable(F.col("v")) & (F.size("v") > 0) & (F.size("v") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = rows.orderBy(*order).limit(1).select(F.size("v").alias("d")).collect()
    dims = first[0].d if first else parts
    if dims > parts * MOST_DIMS:
        raise ValueError("vectors are too long")
    sub = dims // parts
    rows = staged(rows.where(F.size("v") == dims).withColumn("code", F.lit(bytes(parts))), "parts")
    seeds = [whole_numbers(np.array(r.v, np.float64), scale).tolist() for r in rows.orderBy(*order).limit(entries).collect()]
    books = [[s[p * sub : (p + 1) * sub] for s in seeds] for p in range(parts)]
    if not seeds:
        return rows.select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256")).where("false")

    def assigned(books: list[list[list[int]]], last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = [Neighbours(int_array(b)) for b in books]
            for b in sliced(batches, SLICE):
                x = _vectors(b.column(2), scale).reshape(b.num_rows, parts, sub)
                code = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, parts).astype(np.int64)
                error = 0
                for p in range(parts):
                    code[:, p], d, _ = nearest(x[:, p], code[:, p], near[p])
                    error = error + d
                codes = pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary())
                out = [b.column(0), b.column(1), pa.array(error.tolist(), pa.int64()) if last else b.column(2), codes]
                yield pa.RecordBatch.from_arrays(out, ["vec_id", "label", "error" if last else "v", "code"])

        return run

    def part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, sub), object), np.zeros(parts * entries, object)
        for b in sliced(batches, SLICE):
            x = _vectors(b.column(0), scale).reshape(b.num_rows * parts, sub)
            code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, parts).astype(np.int64)
            slot = (code + entries * np.arange(parts)).ravel()
            some = np.zeros((parts * entries, sub), x.dtype)
            np.add.at(some, slot, x)
            total, count = total + some, count + np.bincount(slot, minlength=parts * entries)
        yield _sum_rows(total, count)

    like = {f.name: f.dataType.simpleString() for f in rows.schema}
    for _ in range(rounds):
        now = staged(rows.mapInArrow(assigned(books, False), f"vec_id {like['vec_id']}, label {like['label']}, v {like['v']}, code binary"), "parts")
        unstage(rows)
        rows = now
        s = _merged(rows.select("v", "code").mapInArrow(part_sums, _SUMS))
        for p in range(parts):
            for e in range(len(seeds)):
                if n := s.get((p * entries + e, -1)):
                    books[p][e] = [s[p * entries + e, j] // n for j in range(sub)]
    out = staged(rows.mapInArrow(assigned(books, True), f"vec_id {like['vec_id']}, label {like['label']}, error long, code binary"), "codes")
    unstage(rows)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    sums = staged(out.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "labels")
    small = F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums
    both = out.join(small, F.col("label").eqNullSafe(F.col("_label")))
    return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _moved(before: np.ndarray, after: np.ndarray) -> tuple[list[int], list[int]]:
    """How far each centroid moved, and the farthest that any other did; rounded up, UNKNOWN at most."""
    p = [min(int(x), UNKNOWN) for x in root_up(squared(before.astype(object), after.astype(object)))]
    return p, [max([y for j, y in enumerate(p) if j != i], default=0) for i in range(len(p))]


def settle(x: np.ndarray, start: np.ndarray, upper: np.ndarray, lower: np.ndarray, near: Neighbours) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(centroid, upper, lower, entries measured) of each row. upper: at least its distance to start, lower: at most that to any other.

    A row stays without a search where upper is strictly below lower, or below half the gap to the nearest other centroid: no
    other is as near, so no tie is lost. Otherwise its distance is measured, and if that doesn't settle it all centroids
    within 2 upper + gap of its own are, a ball that holds the nearest and the next. UNKNOWN as upper bound says nothing.
    """
    at, up, low, k = start.copy(), upper.copy(), lower.copy(), len(near.entries)
    gap2 = near.gaps[:, 1] if k > 1 else np.array([1 << 120], object)
    gap, gap_up = np.minimum(root_down(gap2), UNKNOWN).astype(np.int64), root_up(gap2)
    free = lambda: (up < low) | (2 * up < gap[at])
    todo = np.flatnonzero(~free() | (up >= UNKNOWN))
    measured = len(todo)
    if len(todo):
        d = root_up(squared(x[todo], near.entries[at[todo]]))
        up[todo] = np.minimum(d, UNKNOWN).astype(np.int64)
        rest = ~free()[todo] | (up[todo] >= UNKNOWN)
        todo, d = todo[rest], d[rest]
    if len(todo) and k > 1:
        r = 2 * d + gap_up[at[todo]]
        m = near.within(at[todo], r * r)
        first, best, other = near.scan(x[todo], at[todo], m)
        measured += int(m.sum())
        at[todo], up[todo], low[todo] = first, np.minimum(root_up(best), UNKNOWN).astype(np.int64), np.minimum(root_down(other), UNKNOWN).astype(np.int64)
    return at, up, low, measured


def vector_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): integer k-means of the vectors of `dims` components.

    Components become floor(scale * x). Centroids start as the k vectors whose id has the least sha256 of `3:<id>` (ids that
    repeat: by the vector; a null id names no seed). Each round assigns every vector and replaces every used centroid by its
    vectors' floored mean; then vectors are assigned once more. distance is squared; the inertias are its sums.

    Vectors that are null, of another length, or hold a null or non-finite component take no part. Repeated rows and ids are
    rows of their own. Components of any finite size are exact; a distance or sum beyond 64 bits raises. Only rows that
    moved are summed again. An empty table, or one without an id, gives an empty result; extra columns are not read.
    """
    if dims > MOST_DIMS:
        raise ValueError("vectors are too long")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(_usable(F.col("v")) & (F.size("v") == dims))
    state = {"prev": F.lit(-1), "at": F.lit(0), "up": F.lit(UNKNOWN).cast("long"), "low": F.lit(0).cast("long")}
    rows = staged(rows.withColumns(state), "vectors")
    seeds = rows.where("vec_id is not null").select("v", F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h")).orderBy("h", "v").limit(k).collect()
    points = [whole_numbers(np.array(r.v, np.float64), scale).tolist() for r in seeds]
    if not points:
        none = rows.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
        return none.where("false")
    sums, counts = np.zeros((len(points), dims), object), np.zeros(len(points), object)
    still = ([0] * len(points), [0] * len(points))

    def assigned(points: list[list[int]], moved: tuple[list[int], list[int]], last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = Neighbours(int_array(points))
            own, others = (np.array(m, np.int64) for m in moved)
            for b in sliced(batches, SLICE):
                x = _vectors(b.column(1), scale)
                start, up, low = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 4, 5))
                up, low = np.minimum(up + own[start], UNKNOWN), np.maximum(low - others[start], 0)
                at, up, low, _ = settle(x, start, up, low, near)
                if last:
                    d = squared(x, near.entries[at])
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32()), pa.array(d.tolist(), pa.int64())], ["vec_id", "cluster", "distance"])
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(at, pa.int32()), pa.array(up, pa.int64()), pa.array(low, pa.int64())], ["vec_id", "v", "prev", "at", "up", "low"])

        return run

    def changes(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((n, dims), object), np.zeros(n, object)
            for b in sliced(batches, SLICE):
                x = _vectors(b.column(0), scale)
                prev, at = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
                some, there = np.zeros((n, dims), x.dtype), prev >= 0
                np.add.at(some, at, x)
                np.subtract.at(some, prev[there], x[there])
                total, count = total + some, count + np.bincount(at, minlength=n) - np.bincount(prev[there], minlength=n)
            yield _sum_rows(total, count)

        return run

    like = {f.name: f.dataType.simpleString() for f in rows.schema}
    for step in range(rounds):
        found = rows.mapInArrow(assigned(points, still, False), f"vec_id {like['vec_id']}, v {like['v']}, prev int, at int, up long, low long")
        now = staged(found.withColumn("prev", F.lit(-1)) if step == 0 else found, "vectors")
        unstage(rows)
        rows = now
        for (c, place), s in _merged(rows.where("prev <> at").select("v", "prev", "at").mapInArrow(changes(len(points)), _SUMS)).items():
            if place < 0:
                counts[c] += s
            else:
                sums[c, place] += s
        after = [[int(s) // int(n) for s in sums[c]] if (n := counts[c]) else points[c] for c in range(len(points))]
        still = _moved(np.array(points, object), np.array(after, object))
        points = after
    out = staged(rows.mapInArrow(assigned(points, still, True), f"vec_id {like['vec_id']}, cluster int, distance long"), "clusters")
    unstage(rows)
    inertia = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    each = F.array(*[F.struct(F.lit(inertia.get(c, 0)).cast("long").alias("i"), F.lit(digest[c]).alias("d")) for c in range(len(points))])
    mine = F.element_at(each, F.col("cluster") + 1)
    return out.select("vec_id", "cluster", "distance", mine["i"].alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), mine["d"].alias("centroid_sha256"))
