"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's features are its own measures and its neighbours'. The field is fitted on a bounded sample of labelled
documents, every line of which has its document's label; forward-backward gives each line's probability of being good,
and their mean, weighted by line length, is the document's measure, which a logistic curve fitted on the same sample
turns into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import held_out, sliced

#: Labelled documents that the field is fitted on, at most: those with the least hashes of their ids.
SAMPLE_ROWS = 1500
#: Lines of one of them that it learns from, at most.
SAMPLE_LINES = 2000
THRESHOLD = 0.3
OWN = 14


@cache
def _kinds() -> np.ndarray:
    """Code point to kind: 0 upper-case, 1 other letter, 2 digit, 3 space, 4 plain punctuation, 5 bar, 6 exclamation mark, 7 other sign."""
    out = np.full(0x110000, 7, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            out[c] = 0 if ch.isupper() else 1
        elif ch.isdigit():
            out[c] = 2
        elif ch.isspace():
            out[c] = 3
    for ch in ".,;:'\"-()?’“”«»¿¡…":
        out[ord(ch)] = 4
    out[ord("|")], out[ord("!")] = 5, 6
    return out


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of a text's lines that aren't blank: own measures, the previous and next line's, and 1."""
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
    if not lines:
        return np.zeros((0, 3 * OWN + 1), np.float32), np.zeros(0)
    length = np.array([len(x) for x in lines])
    kinds = _kinds()[np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32)]
    starts = np.concatenate([[0], np.cumsum(length)[:-1]])
    k = np.stack([np.add.reduceat(kinds == i, starts, dtype=np.int64) for i in range(8)], axis=1)
    words = [x.split() for x in lines]
    n = np.array([max(1, len(w)) for w in words])
    distinct = np.array([len(set(w)) for w in words])
    again = np.array([sum(map(str.__eq__, w, w[1:])) for w in words])
    letters = np.maximum(1, k[:, 0] + k[:, 1])
    share = k / length[:, None]
    seen: dict[str, int] = {}
    copy = np.array([seen.setdefault(x, i) != i for i, x in enumerate(lines)])
    own = np.stack([
        k[:, 0] / letters, k[:, 0] / letters > 0.5, share[:, 7] * 4, share[:, 7] > 0.04, share[:, 5] * 8, share[:, 5] > 0.02,
        share[:, 6] * 8, share[:, 6] > 0.02, share[:, 2] * 2, share[:, 4] * 4, distinct / n, (distinct / n < 0.4) & (n > 6), again / n, copy,
    ], axis=1).astype(np.float32)
    zero = np.zeros((1, OWN), np.float32)
    return np.hstack([own, np.vstack([zero, own[:-1]]), np.vstack([own[1:], zero]), np.ones((len(lines), 1), np.float32)]), length.astype(float)


def forward_backward(unary: list[np.ndarray], change: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of chains with scores `unary` for good (0 for bad) and transitions change[from, to]: each line's probability of
    good, the log partition of each chain, and the expected number of each transition, all chains together.

    Chains run side by side, longest first; a step's work is only over chains that reach it.
    """
    order = sorted(range(len(unary)), key=lambda i: -len(unary[i]))
    size = np.array([len(unary[i]) for i in order])
    top = int(size[0]) if len(size) else 0
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(top)]  # chains longer than t
    starts = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate([unary[i] for i in order]) if order else np.zeros(0)
    fwd, bwd = np.zeros((len(flat), 2)), np.zeros((len(flat), 2))
    for t in range(top):
        at = starts[: active[t]] + t
        if t:
            prev = fwd[at - 1]
            fwd[at, 0] = np.logaddexp(prev[:, 0] + change[0, 0], prev[:, 1] + change[1, 0])
            fwd[at, 1] = np.logaddexp(prev[:, 0] + change[0, 1], prev[:, 1] + change[1, 1]) + flat[at]
        else:
            fwd[at, 1] = flat[at]
    for t in range(top - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        good = flat[at + 1] + bwd[at + 1, 1]
        bwd[at, 0] = np.logaddexp(change[0, 0] + bwd[at + 1, 0], change[0, 1] + good)
        bwd[at, 1] = np.logaddexp(change[1, 0] + bwd[at + 1, 0], change[1, 1] + good)
    last = starts[1:][size > 0] - 1
    log_z = np.zeros(len(order))
    log_z[size > 0] = np.logaddexp(fwd[last, 0], fwd[last, 1])
    per_line = np.repeat(log_z, size)
    p = np.exp(np.minimum(0.0, fwd[:, 1] + bwd[:, 1] - per_line))
    steps = np.ones(len(flat), bool)
    steps[starts[:-1][size > 0]] = False
    to = np.flatnonzero(steps)
    pair = np.zeros((2, 2))
    if len(to):
        arrive = np.stack([bwd[to, 0], flat[to] + bwd[to, 1]], axis=1)
        for i in range(2):
            for j in range(2):
                pair[i, j] = np.exp(np.minimum(0.0, fwd[to - 1, i] + change[i, j] + arrive[:, j] - per_line[to])).sum()
    out: list[np.ndarray] = [np.zeros(0)] * len(unary)
    z = np.zeros(len(unary))
    for r, i in enumerate(order):
        out[i], z[i] = p[starts[r] : starts[r + 1]], log_z[r]
    return out, z, pair


@dataclass
class QualityModel:
    weights: np.ndarray
    change: np.ndarray
    slope: float
    offset: float

    def measures(self, lines: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        p, _, _ = forward_backward([x @ self.weights for x, _ in lines], self.change)
        return np.array([float(q @ n / n.sum()) if len(n) else 0.0 for q, (_, n) in zip(p, lines, strict=True)])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = self.slope * self.measures([line_features(t) for t in texts]) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_field(lines: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 120, rate: float = 0.15, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions) by Adam on the mean log likelihood of a line. Documents of the rarer label weigh as much
    in all as the others."""
    w, change = np.zeros(3 * OWN + 1), np.zeros((2, 2))
    share = [max(1e-9, float(sum(len(x) for (x, _), v in zip(lines, y, strict=True) if v == c))) for c in (0, 1)]
    groups = [([x for (x, _), v in zip(lines, y, strict=True) if v == c and len(x)], c) for c in (0, 1)]
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, rounds + 1):
        grad = -l2 * np.concatenate([w, change.ravel()])
        for xs, c in groups:
            if not xs:
                continue
            p, _, pair = forward_backward([x @ w for x in xs], change)
            seen = np.zeros((2, 2))
            seen[c, c] = sum(len(x) - 1 for x in xs)
            grad += np.concatenate([np.vstack(xs).T @ (c - np.concatenate(p)), (seen - pair).ravel()]) / (2 * share[c])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, change = w + step[:-4], change + step[-4:].reshape(2, 2)
        change = np.clip(change, -2.0, 2.0)  # labels are the same all over a document: keep lines' own evidence
    return w, change


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one measure, by Newton's method with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        q = p * (1 - p)
        g = np.array([(y - p) @ x - 1e-2 * a, (y - p).sum() - 1e-2 * b])
        h = np.array([[q @ (x * x) + 1e-2, q @ x], [q @ x, q.sum() + 1e-2]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 5 / max(1e-9, float(np.abs(d).max())))
        a, b = a + float(d[0]), b + float(d[1])
        if np.abs(d).max() < 1e-9:
            break
    return a, b


def _thinned(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most SAMPLE_LINES consecutive lines of a document to learn from, from its middle; scores take all lines."""
    at = max(0, (len(x) - SAMPLE_LINES) // 2)
    return x[at : at + SAMPLE_LINES], n[at : at + SAMPLE_LINES]


def fit_quality_model(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learns from labelled documents that aren't held out. Without any, all scores are one half. An id with both labels counts
    as good; an id with several texts gives each of them."""
    named = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).groupBy("_id").agg(F.max("y").alias("y"))
    some = named.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    # the sample's ids and labels: at most sample_rows rows
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")
    # an id may repeat: the least rows by hash, and each row once, so that at most sample_rows rows are learned
    least = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).distinct().orderBy(F.xxhash64("doc_id"), "h").limit(sample_rows)
    least = F.broadcast(least.withColumnsRenamed({"doc_id": "_id", "h": "_h"}))
    rows = rows.join(least, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("doc_id", "text") == F.col("_h"))).select("doc_id", "text", "y").dropDuplicates(["doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            got = [_thinned(*line_features(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x.astype("<f4").tobytes() for x, _ in got], pa.binary()), pa.array([n.astype("<f8").tobytes() for _, n in got], pa.binary())], ["doc_id", "y", "x", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.mapInArrow(run, f"doc_id {kind}, y int, x binary, n binary").collect()
    got = sorted(got, key=lambda r: (r["doc_id"], r["x"]))
    lines = [(np.frombuffer(r["x"], "<f4").reshape(-1, 3 * OWN + 1).astype(float), np.frombuffer(r["n"], "<f8")) for r in got]
    y = np.array([r["y"] for r in got], int)
    if not len(y):
        return QualityModel(np.zeros(3 * OWN + 1), np.zeros((2, 2)), 0.0, 0.0)
    w, change = fit_field(lines, y)
    model = QualityModel(w, change, 1.0, 0.0)
    model.slope, model.offset = fit_curve(model.measures(lines), y)
    return model


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row, from the text alone; with carry also text and a struct
    `row` of those columns, so that a filter needs no join.

    Null, empty and blank texts have no good line: their measure is 0. A null id isn't held out. Repeated rows get equal
    values; an empty table gives an empty result; extra columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            s = model.scores(b.column(2).to_pylist()) if b.num_rows else np.zeros(0)
            cols = [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32()), *b.columns[2 if carry else 3 :]]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"), *([F.struct(*carry).alias("row")] if carry else []))
    schema = f"doc_id {kind}, held_out boolean, score double, predicted int" + (f", text string, row {rows.schema['row'].dataType.simpleString()}" if carry else "")
    names = ["doc_id", "held_out", "score", "predicted", *(("text", "row") if carry else ())]
    return rows.mapInArrow(run, schema)
