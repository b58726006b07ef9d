"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams of 1 to 3 letters, with a space for each run of anything else, are hashed to a fixed number of features.
Document frequencies cover every labelled training row and are counted on the executors. The classifier is fitted on a
bounded sample of those rows with follow-the-regularised-leader and an elastic net, then its softmax temperature is
calibrated on a part of the sample that the fit left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import held_out, sliced

BITS = 16
FEATURES = 1 << BITS
#: Labelled rows that the classifier is fitted on, at most: of each label those with the least hashes.
SAMPLE_ROWS = 1200
UNKNOWN = "und"
_SCALE = 40.0
_PIECE = 1 << 20


@cache
def _letters() -> np.ndarray:
    """Code point to lower-case letter, 32 for anything else."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def features(text: str | None) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, repeats included, a bounded piece at a time; nothing if it has no letter."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    tail = np.array([32], np.uint32)
    some = False
    for i in range(0, len(codes), _PIECE):
        c = np.concatenate([tail, _letters()[codes[i : i + _PIECE]], np.array([32] if i + _PIECE >= len(codes) else [], np.uint32)])
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        if len(c) < 2:
            tail = c[-1:]
            continue
        some = some or bool((c != 32).any())
        a, b = c * np.uint32(0x9E3779B1), c * np.uint32(0x85EBCA77)
        two = a[:-1] + b[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + b[2:]
        h = np.concatenate([(x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS) for x in (c[1:] * np.uint32(0x27D4EB2F), two, three)])
        tail = c[-2:] if some else c[-1:]
        if some:
            yield h


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # FEATURES x langs: idf times weight
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        total, n = np.zeros(len(self.langs)), 0
        for h in features(text):
            total += self.table[h].sum(0, dtype=np.float64)
            n += len(h)
        if not n or not self.langs:
            return UNKNOWN, 0.0
        z = (_SCALE * total / n + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def document_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """In how many texts each feature occurs: counted in each task, then added up by feature (FEATURES rows at most)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, bool)
        for b in sliced(batches):
            for t in b.column(0):
                seen[:] = False
                for h in features(t.as_py()):
                    seen[h] = True
                df += seen
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["feature", "n"])

    out = np.zeros(FEATURES, np.int64)
    rows = docs.select(text_col).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out[rows["feature"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _sample(docs: DataFrame, rows: int, id_col: str, text_col: str, label_col: str) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(label, feature ids, counts) of a bounded sample; at most FEATURES pairs a row reach the driver.

    Each label has an equal quota of the rows, so a rare one is learned too. Keys of 60 bits are drawn by hash alone: a threshold
    first found on a count a label leaves about twice the quota, of which the least go on; texts never move for it.
    """
    keyed = docs.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), F.shiftrightunsigned(F.xxhash64(id_col, text_col), 4).alias("h"))
    counts = {r["label"]: r["count"] for r in keyed.groupBy("label").count().collect()}  # a row a label
    quota = max(1, rows // max(1, len(counts)))
    if not counts:
        return []
    limit = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1 << 60, int((2 * quota + 20) / n * (1 << 60))))) for k, n in counts.items()))
    near = keyed.select("label", "h").where(F.col("h") <= limit[F.col("label")]).distinct()
    least = near.withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("at") <= quota).select("label", "h")
    some = keyed.join(F.broadcast(least.withColumnsRenamed({"label": "_label", "h": "_h"})), (F.col("label") == F.col("_label")) & (F.col("h") == F.col("_h")))
    some = some.dropDuplicates(["label", "h"])  # a row that repeats a row of the sample is not learned twice: rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = []
            for t in b.column(1):
                counts = np.zeros(FEATURES, np.int64)
                for h in features(t.as_py()):
                    counts += np.bincount(h, minlength=FEATURES)
                at = np.flatnonzero(counts)
                out.append((at.astype("<u4").tobytes(), counts[at].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), pa.binary()) for c in zip(*out, strict=True))] if out else [b.column(0), pa.array([], pa.binary()), pa.array([], pa.binary())], ["label", "at", "n"])

    got = some.select("label", "text").mapInArrow(run, "label string, at binary, n binary").collect()
    return sorted(((r["label"], np.frombuffer(r["at"], "<u4"), np.frombuffer(r["n"], "<u4")) for r in got), key=lambda r: (len(r[1]), r[1].tobytes(), r[0]))


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) by FTRL-proximal with per-coordinate rates. rows: (class, features, values)."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))
    weights = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, at, x = rows[i]
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            w = weights(z[at], n[at])
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm between 1/20 and 20."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean() + 1e-4 * t * t)

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit_language_model(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> LanguageModel:
    """Learns from rows with a label that aren't held out. Without any, the model knows no language."""
    train = docs.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    rows = _sample(train, sample_rows, id_col, text_col, label_col)
    rows = [r for r in rows if len(r[1])]
    langs = sorted({r[0] for r in rows})
    if not langs:
        return LanguageModel([], np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    df = document_frequencies(train, text_col)
    idf = np.log((1 + int(df.max())) / (1 + df)) + 1
    data = [(langs.index(label), at, _SCALE * idf[at] * n / n.sum()) for label, at, n in rows]
    rng = np.random.default_rng(17)
    order = rng.permutation(len(data))
    apart = [data[i] for i in order[: len(data) // 5]]
    w, bias = fit_ftrl([data[i] for i in order[len(data) // 5 :]] or data, len(langs))
    logits = np.array([x @ w[at] + bias for _, at, x in apart]).reshape(-1, len(langs))
    return LanguageModel(langs, (idf[:, None] * w).astype(np.float32), bias, fit_temperature(logits, np.array([y for y, _, _ in apart], int)))


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row, from the text alone; with carry also text and a struct
    `row` of those columns, so that a filter needs no join.

    Null texts and texts without a letter are `und` with score 0, as is everything if the model knows no language.
    A null id is held out of nothing (false). Ties go to the language first in code-point order; repeated rows get
    equal values; an empty table gives an empty result; extra columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # FEATURES rows, a column a language
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in sliced(batches):
            got = [m.predict(t.as_py()) for t in b.column(2)]
            cols = [b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), *b.columns[2 if carry else 3 :]]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"), *([F.struct(*carry).alias("row")] if carry else []))
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double" + (f", text string, row {rows.schema['row'].dataType.simpleString()}" if carry else "")
    names = ["doc_id", "held_out", "lang_pred", "score", *(("text", "row") if carry else ())]
    return rows.mapInArrow(run, schema)
