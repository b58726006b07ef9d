"""Text operators that are folds or need whole-text comparison: chunking, near-duplicates, enum snapping, JSON repair."""

from __future__ import annotations

import difflib
import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions import text as X
from tidegraph.operators.core import cut, greedy_keep

_SPLIT = re.compile(r"(?<=[.!?])\s+")


def pack_sentences(text: str | None, target: int = 400, overlap: int = 50) -> list[str]:
    """Sentences packed to at most `target` approximate tokens (words / 0.75), trailing ones of at most `overlap` tokens
    in all carried into the next chunk, even where they and the next sentence go over the target."""
    out: list[str] = []
    held: list[tuple[str, int]] = []
    for s in (x.strip() for x in _SPLIT.split(text or "")):
        if not s:
            continue
        n = int(len(s.split()) / 0.75)
        if held and sum(k for _, k in held) + n > target:
            out.append(" ".join(x for x, _ in held))
            tail: list[tuple[str, int]] = []
            for x in reversed(held):
                if sum(k for _, k in tail) + x[1] > overlap:
                    break
                tail.insert(0, x)
            held = tail
        held.append((s, n))
    if held:
        out.append(" ".join(x for x, _ in held))
    return out


def chunks(articles: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per chunk: chunk_id, chunk_index, chunk, token_count, and the article's other columns but its text."""
    keep = [c for c in articles.columns if c != text_col]

    @F.pandas_udf("array<string>")
    def pack(text: pd.Series) -> pd.Series:
        return text.map(pack_sentences)

    rows = articles.select(*keep, F.posexplode(pack(F.col(text_col))).alias("chunk_index", "chunk"))
    return rows.withColumns({"chunk_id": F.concat_ws("::", F.col(id_col).cast("string"), F.lit("chunk"), F.col("chunk_index").cast("string")), "token_count": (F.size(F.split("chunk", r"\s+")) / 0.75).cast("int")})


#: Rounds in which the first open member of a bucket is compared with the bucket; members still open after them are paired.
LEADER_ROUNDS = 3
#: Ids of candidate pairs are broadcast up to this counted number, so that the texts needn't be shuffled to find theirs.
BROADCAST_IDS = 1 << 20
#: Minima of a set and of a band, bits of its bitmap.
MINIMA, BAND, BITMAP = 64, 4, 1024


def _mixed(n: int) -> np.ndarray:
    """n fixed 64-bit numbers (the splitmix64 sequence)."""
    z = (np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_FLIP, _ODD = _mixed(2 * MINIMA)[:MINIMA], _mixed(2 * MINIMA)[MINIMA:] | np.uint64(1)


def minima(h: np.ndarray) -> np.ndarray:
    """The least value of a set's hashes under each of MINIMA permutations of the 64-bit numbers, each a flip and an odd factor."""
    out = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1024):
        x = h[None, i : i + 1024] ^ _FLIP[:, None]
        x *= _ODD[:, None]
        out = np.minimum(out, x.min(1))
    return out


_WORD = re.compile(X.DEDUP_TOKEN.encode())


def _shingle_hashes(low: bytes, words: int) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of the word shingles of a lower-cased text; of all its words, if they are fewer; none without words."""
    w = _WORD.findall(low)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) > words else [b" ".join(w)] if w else []
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(g, 42) for g in grams]), ">u8").astype(np.uint64))


def _hashed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches whose last column is a lower-cased text in bytes, without the rows that have no words, and their shingles' hashes."""
    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            b = whole.slice(i, 256)
            found = [_shingle_hashes(t.as_py() or b"", words) for t in b.column(b.num_columns - 1)]
            if any(map(len, found)):
                yield b.filter(pa.array([len(h) > 0 for h in found])), [h for h in found if len(h)]


def _bytes(text: Column) -> Column:
    """What `_hashed` reads: Spark lower-cases, as it does for `dedup_tokens`."""
    return F.lower(text).cast("binary")


def verified(pairs: DataFrame, rows: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of at least that Jaccard similarity.

    rows: (id, n, bits), shingle counts and parity bitmaps, two exact bounds: sets differ in at least as many shingles as their
    bitmaps in bits. Shingles are made again from the texts (id, text), for pairs that the bounds leave alone.
    """
    side = lambda c: rows.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"s{c}"))
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    most = F.least((F.col("na") + F.col("nb") - differ) / 2, F.least("na", "nb"))
    near = cut(pairs.join(side("a"), "a").join(side("b"), "b").where(most >= similarity * (F.col("na") + F.col("nb") - most) - 1e-9).select("a", "b"))
    ids = cut(near.select(F.col("a").alias("id")).union(near.select("b")).distinct())
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _hashed(batches, words):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], ["id", "g"])

    kind = texts.schema["id"].dataType.simpleString()
    sets = cut(texts.join(wanted, "id", "left_semi").select("id", _bytes(F.col("text")).alias("text")).mapInArrow(run, f"id {kind}, g array<bigint>"))
    both = near.join(sets.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
    same = F.size(F.array_intersect("ga", "gb"))
    return both.where(same >= similarity * (F.size("ga") + F.size("gb") - same) - 1e-9).select("a", "b")


def set_features(rows: DataFrame, words: int) -> DataFrame:
    """(id, rank, n, same, bands, bits) of rows (id, day, text) with words: what near-duplicates are found and bounded by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, hashes in _hashed(batches, words):
            m = np.array([minima(h) for h in hashes], np.uint64).reshape(b.num_rows, MINIMA // BAND, BAND)
            bands = ((m * _ODD[:BAND]).sum(2, dtype=np.uint64) ^ _FLIP[: MINIMA // BAND]).view(np.int64)
            parity = [np.packbits(np.bincount((h >> np.uint64(20)).astype(np.int64) % BITMAP, minlength=BITMAP).astype(np.uint8) & 1).view(np.int64) for h in hashes]
            longs = pa.list_(pa.int64())
            cols = [b.column(0), b.column(1), pa.array([len(h) for h in hashes], pa.int32()), pa.array([hashlib.md5(h.tobytes()).hexdigest() for h in hashes]), pa.array(list(bands), longs), pa.array(parity, longs)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "day", "n", "same", "bands", "bits"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    base = rows.select("id", "day", _bytes(F.col("text")).alias("text")).mapInArrow(run, f"id {kind['id']}, day {kind['day']}, n int, same string, bands array<bigint>, bits array<bigint>")
    return base.select("id", F.struct("day", "id").alias("rank"), "n", "same", "bands", "bits")


def near_dup_keep(articles: DataFrame, id_col: str, text_col: str, date_col: str, words: int = 5, similarity: float = 0.86) -> DataFrame:
    """Ids kept by greedy near-duplicate removal, oldest first.

    Of equal shingle sets the oldest stands for all: what drops it drops its copies too. Candidates share one of 16 bands
    of 4 of 64 minima (a pair at 0.86 shares none with a chance of 3e-6, texts of any length). A document that is the oldest
    open one of all its buckets is kept and drops what it resembles in them, so a group of copies costs a comparison each;
    after `LEADER_ROUNDS` members still open are paired. Articles without words are all kept.
    """
    rows = articles.select(F.col(id_col).alias("id"), F.col(date_col).alias("day"), F.col(text_col).alias("text"))
    base = cut(set_features(rows, words))
    oldest = base.groupBy("same").agg(F.min(F.struct("rank", "id")).alias("x")).select("x.id")
    classes = cut(base.join(oldest, "id", "left_semi").drop("same"))
    left, kept = classes, rows.where(~F.coalesce(F.lower("text").rlike(X.DEDUP_TOKEN), F.lit(False))).select("id")
    for _ in range(LEADER_ROUNDS):
        members = left.select("id", "rank", F.explode("bands").alias("band"))
        heads = members.groupBy("band").agg(F.min(F.struct("rank", "id")).alias("h"))
        met = cut(members.join(heads, "band").groupBy("id").agg(F.collect_set("h.id").alias("heads")))
        sure = met.where((F.size("heads") == 1) & (F.col("heads")[0] == F.col("id"))).select("id")
        pairs = met.select(F.explode("heads").alias("a"), F.col("id").alias("b")).where("a <> b").join(sure.withColumnRenamed("id", "a"), "a", "left_semi")
        decided = verified(pairs, classes, rows, words, similarity).select(F.col("b").alias("id")).unionByName(sure)
        kept = kept.unionByName(sure)
        left = cut(left.join(decided, "id", "left_anti"))
        if left.isEmpty():
            return kept
    members = left.select("id", F.explode("bands").alias("band"))
    pairs = members.withColumnRenamed("id", "a").join(members.withColumnRenamed("id", "b"), "band").where("a < b").select("a", "b").distinct()
    return kept.unionByName(greedy_keep(left.select("id", "rank"), verified(pairs, classes, rows, words, similarity)))


def snap(value: str | None, allowed: Sequence[str], cutoff: float = 0.6) -> tuple[str | None, str]:
    """(value, action): kept as it stands, snapped to the closest allowed value, or dropped. Case and white space count."""
    v = value or ""
    if v in allowed:
        return v, "kept"
    close = difflib.get_close_matches(v, allowed, n=1, cutoff=cutoff) if v else []
    return (close[0], "snapped") if close else (None, "dropped")


_BRACES = re.compile(r'"(?:[^"\\]|\\.|\\\Z)*(?:"|\Z)|[{}]', re.DOTALL)


def repair_json(raw: str | None) -> str | None:
    """The text up to the last place where the braces outside strings are balanced; null without one."""
    depth, end = 0, 0
    for m in _BRACES.finditer(raw or ""):
        if m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
            if depth == 0 and m[0] == "}":
                end = m.end()
    return raw[:end] if end else None
