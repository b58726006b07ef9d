"""MinHash near-dedup: one permutation in bins, optimal densification, banded buckets, star-shaped candidate edges.

A set's one hash of each shingle is dealt to bins, and a bin keeps its least; an empty bin borrows from the bin that its own
fixed sequence of probes meets first, as all sets' do. A bucket (band, its values) links each member to its least member, so
candidates are at most the bands a set, however large a bucket is. Sketches can miss a pair and a star leaves members of a
bucket unpaired, so a prefix filter over the whole sets then tries every pair of sets that are still apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import components, sliced, staged, unstage
from tidegraph.llm.simhash import BITMAP, FEW, _by_wide_bitmaps, _common, _exact_pairs, _hashes, _planes, _prefix_postings, confirmed, parity_bitmap, set_prefix, text_key, wide_bitmap

#: Probes of an empty bin before it takes the next filled one.
PROBES = 256
#: Ids (two longs a row) up to this counted number are broadcast, so that the texts needn't be shuffled to find theirs.
BROADCAST_IDS = 1 << 20


def probe_table(bins: int) -> np.ndarray:
    """For each bin, the bins that it asks in turn: a fixed hash of (bin, turn), then all bins from its own on."""
    n = np.arange(bins * PROBES, dtype=np.uint64)
    return np.concatenate([(_planes(n, 2)[1] % np.uint64(bins)).astype(np.int64).reshape(bins, PROBES), (np.arange(bins)[:, None] + np.arange(bins)[None, :]) % bins], axis=1)


def sketch(h: np.ndarray, bins: int, probes: np.ndarray) -> np.ndarray:
    """The least hash of each bin; an empty bin has that of the first filled one among its probes. h: sorted, not empty; bins: a power of two."""
    bits = np.uint64(64 - (bins.bit_length() - 1))
    at = np.searchsorted(h, np.arange(bins, dtype=np.uint64) << bits)
    value = h[np.minimum(at, len(h) - 1)]
    filled = (at < len(h)) & ((value >> bits) == np.arange(bins, dtype=np.uint64))
    empty = np.flatnonzero(~filled)
    if len(empty):
        asked = probes[empty]
        value[empty] = value[asked[np.arange(len(empty)), filled[asked].argmax(1)]]
    return value


def band_keys(values: np.ndarray, rows: int) -> list[int]:
    return [xxhash.xxh64_intdigest(values[i : i + rows].tobytes(), i) - (1 << 63) for i in range(0, len(values), rows)]


def _features(docs: DataFrame, common: np.ndarray, words: int, similarity: float, bins: int, rows: int) -> DataFrame:
    """(doc_id, key, id, n, bands, bits, wide, prefix) of each row (doc_id, key, text); id is a hash of the set, null if it is empty."""
    by_hash = np.argsort(common)
    order = docs.sparkSession.sparkContext.broadcast((common[by_hash], by_hash))  # bounded, see `_common`
    probes = probe_table(bins)
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [_hashes(t.as_py(), words) for t in b.column(2)]
            cols = [
                b.column(0), b.column(1), pa.array([xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63) if len(h) else None for h in found], pa.int64()), pa.array([len(h) for h in found], pa.int64()),
                pa.array([band_keys(sketch(h, bins, probes), rows) if len(h) else [] for h in found], longs), pa.array([parity_bitmap(h, BITMAP) for h in found], pa.binary()),
                pa.array([wide_bitmap(h) for h in found], pa.binary()), pa.array([set_prefix(h, order.value, similarity) for h in found], longs),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "id", "n", "bands", "bits", "wide", "prefix"])

    return staged(docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, id long, n long, bands array<bigint>, bits binary, wide binary, prefix array<bigint>"), "features")


def star_edges(sets: DataFrame) -> DataFrame:
    """(a, b) of each bucket's least member a and its others. sets: (id, bands). At most a pair for each band of a set."""
    rows = sets.select("id", F.explode("bands").alias("key"))
    centre = staged(rows.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("c")).where("c > 1").select("key", "a"), "buckets")
    return rows.join(centre, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def _allowed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose counts and bitmaps allow the similarity."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"s{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1 << 14):
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(b.num_rows, -1) for k in (4, 5))
                na, nb = (b.column(k).to_numpy() for k in (2, 3))
                shared = np.minimum((na + nb - np.bitwise_count(x ^ y).sum(1, dtype=np.int64)) // 2, np.minimum(na, nb))
                ok = pa.array(shared >= similarity * (na + nb - shared) - 1e-9)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def minhash_components(docs: DataFrame, words: int = 5, similarity: float = 0.85, bins: int = 64, band_rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row: texts linked by shingle-set Jaccard of `similarity` or more.

    A set holds the distinct shingles of A-Z-lower-cased words; with fewer words, the whole sequence; without words it is
    empty and linked with nothing. component_id is the least doc_id reachable, the row's own included. Links are confirmed
    on full sets (equal sets by a 64-bit digest), and none is missed: see the module.

    Rows with a null id are linked too but name no component (null if all its ids are null; kept is then true). Repeated rows
    share their set, and all that have the component's id are kept. An empty table gives an empty result; extra columns are
    not read.
    """
    last = F.lit(2**63 - 1)
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    rows = _features(base, _common(base.select(F.col("key").alias("id"), "text"), words), words, similarity, bins, band_rows)
    classes = staged(rows.where("n > 0").groupBy("id").agg(F.min(F.struct("doc_id", "key")).alias("x")).select("id", "x.doc_id", "x.key"), "classes")
    sets = staged(rows.join(classes, ["id", "doc_id", "key"], "left_semi").dropDuplicates(["id"]).select("id", "n", "bands", "bits", "wide", "prefix"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(classes, "id"), "wanted")
        small = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
        texts = staged(base.join(small, ["doc_id", "key"]).dropDuplicates(["id"]).select("id", "text"), "texts")
        links = confirmed(pairs, texts, words, similarity)
        unstage(texts)
        return links

    tried = staged(_allowed(star_edges(sets.select("id", "bands")), sets, similarity), "candidates")
    links = [verified(tried)]
    postings = _prefix_postings(sets)
    for few in (FEW, 0):
        roots = staged(components(reduce(DataFrame.unionByName, links)), "roots")
        apart = _exact_pairs(postings, sets, roots, similarity, few).join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        cand = staged(_by_wide_bitmaps(apart, sets, similarity), "candidates")
        links.append(verified(cand.select("a", "b")))
        tried = tried.unionByName(cand.select("a", "b"))
        if cand.where("withheld").isEmpty():
            break
    unstage(postings)
    roots = staged(components(reduce(DataFrame.unionByName, links)), "roots")
    named = classes.select("id", "doc_id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "doc_id", F.coalesce("root", "id").alias("root"))
    names = named.groupBy("root").agg(F.min("doc_id").alias("component"))
    table = staged(named.join(names, "root").select("id", "component"), "named")  # so that the join below can split a frequent set
    full = rows.where("n > 0").select("doc_id", "id", "n").join(table, "id").select("doc_id", "n", "component")
    out = full.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    known = lambda c: F.when(F.col(c) != last, F.col(c))
    return out.select(known("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), known("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
