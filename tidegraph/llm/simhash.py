"""SimHash near-dedup: a byte-position inverted index with count filtering.

Fingerprints of 8 * planes bytes are indexed by the bytes they hold at tuples of positions, never by all texts of a
group. A posting (tuple, its bytes) of up to PAIRED members gives its pairs; a larger one gives a linear number of
links, as described at `_links`. The bytes two fingerprints share are tallied, pairs with fewer than the guaranteed
minimum are dropped, and the rest verified. Two 64-bit fingerprints that differ in at most d bits share at least 8 - d
bytes, so with all tuples of 8 - d positions as keys no such pair is missed.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import components, sieved, sliced, staged, unstage

#: Members of a posting up to which its pairs are made; of a wide posting, whose candidates are compared by their texts.
PAIRED = 32
PAIRED_WIDE = 8
#: Members of a posting that meet in one block of the exact rest; bits of the bitmaps there.
UNIT = 512
BITMAP = 1024
#: Pairs of two groups that a block gives at first.
FEW = 4
#: Least number and share of the texts whose shingles are counted, and most shingles that are then put last, for short postings.
SAMPLE, SAMPLE_SHARE = 5_000, 1 / 64
COMMON = 200_000
_CHUNK = 1 << 16


def shingles(text: str, words: int) -> list[bytes]:
    """Word shingles, repeats included; the whole sequence if there are fewer words; none without words.

    Only A-Z is lower-cased and only \\x20 and \\x09-\\x0D part words: just what bytes.lower and bytes.split do.
    """
    w = text.encode("utf-8", "replace").lower().split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return [b" ".join(x) for x in zip(*(w[i:] for i in range(words)), strict=False)]


def _planes(h: np.ndarray, planes: int) -> list[np.ndarray]:
    """Plane 0 is the hashes themselves; others are fixed bijections of them (the splitmix64 finaliser)."""
    out = [h]
    for i in range(1, planes):
        z = h + np.uint64((i * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(z ^ (z >> np.uint64(31)))
    return out


def _majority(hashes: np.ndarray, planes: int) -> list[int]:
    """A signed 64-bit number a plane: a bit is 1 if set in over half of the plane's hashes."""
    ones = np.zeros((planes, 64), np.int64)
    for i in range(0, len(hashes), _CHUNK):
        for k, z in enumerate(_planes(hashes[i : i + _CHUNK], planes)):
            ones[k] += np.unpackbits(z.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), axis=1).view(">i8").ravel().tolist()


def simhash(text: str | None, words: int, planes: int = 1) -> list[int]:
    """One unsigned 64-bit number a plane: a bit is 1 if set in over half of the shingles' XXH64 (seed 42), repeats counted."""
    grams = shingles(text or "", words)
    if not grams:
        return [0] * planes
    return [x % 2**64 for x in _majority(np.frombuffer(b"".join([xxhash.xxh64_digest(x, 42) for x in grams]), ">u8").astype(np.uint64), planes)]


def fingerprints(docs: DataFrame, words: int = 3, planes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f array<long>): the fingerprint of each row, 64 bits a plane, as signed longs. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            f = np.array([simhash(t.as_py(), words, planes) for t in b.column(1)], np.uint64).astype(np.int64).reshape(-1, planes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(f), pa.list_(pa.int64()))], ["doc_id", "f"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, f array<bigint>")


def position_tuples(n_bytes: int, width: int, keys: int | None = None) -> list[tuple[int, ...]]:
    """All tuples of `width` of n_bytes positions, or a fixed pseudo-random choice of `keys` of them."""
    if keys is None:
        return list(itertools.combinations(range(n_bytes), width))
    rng = random.Random(n_bytes * 1000 + width)
    out: dict[tuple[int, ...], None] = {}
    while len(out) < keys:
        out[tuple(sorted(rng.sample(range(n_bytes), width)))] = None
    return list(out)


def _byte(f: Column, p: int) -> Column:
    return F.shiftright(f[p // 8], 56 - 8 * (p % 8)).bitwiseAND(F.lit(255).cast("long"))


def _key(f: Column, tuples: list[tuple[int, ...]]) -> Column:
    """Array of posting keys: the tuple's number, then its bytes."""
    width = len(tuples[0])
    if width * 8 + 8 > 62 or len(tuples) > 1 << (62 - 8 * width):
        raise ValueError("keys don't fit a long")
    one = lambda n, t: sum((F.shiftleft(_byte(f, p), 8 * i) for i, p in enumerate(t)), F.lit(n << (8 * width)).cast("long"))
    return F.array(*[one(n, t) for n, t in enumerate(tuples)])


def differing_bits(a: Column, b: Column, planes: int) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(planes)), F.lit(0))


def shared_bytes(a: Column, b: Column, planes: int) -> Column:
    return sum(((_byte(a, p) == _byte(b, p)).cast("int") for p in range(8 * planes)), F.lit(0))


def _postings(classes: DataFrame, tuples: list[tuple[int, ...]]) -> DataFrame:
    """(key, id, f, c) of postings with at least two members; c is their number. classes: (id, f), each f once."""
    rows = classes.select("id", "f", F.explode(_key(F.col("f"), tuples)).alias("key"))
    rows = rows.withColumn("c", F.count("*").over(Window.partitionBy("key"))).where("c > 1")
    return staged(rows.select("key", "id", "f", "c"), "postings")


def _pairs(shared: DataFrame) -> DataFrame:
    small = shared.where(F.col("c") <= PAIRED).select("key", "id", "f")
    other = small.select("key", F.col("id").alias("b"), F.col("f").alias("fb"))
    return small.join(other, "key").where("id < b").select(F.col("id").alias("a"), F.col("f").alias("fa"), "b", "fb")


def hamming_edges(classes: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b): links of distinct 64-bit fingerprints that leave the same components as all pairs at max_bits or fewer.

    classes: (id, f). Keys are all tuples of 6 of the 8 positions. In a large posting, whose members agree in 6 bytes,
    every pair within 2 bits has a common neighbour at one bit or none in the other two, so each member names its 17
    neighbours there and is linked to the least member that names the same one.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2: beyond, a large posting has no linear exact form here")
    if max_bits == 0:  # classes are distinct fingerprints
        return classes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    width = 6
    tuples = position_tuples(8, width)
    shared = _postings(classes, tuples)
    tally = _pairs(shared).groupBy("a", "fa", "b", "fb").agg(F.count("*").alias("keys"))
    close = tally.where((shared_bytes(F.col("fa"), F.col("fb"), 1) >= 8 - max_bits) & (differing_bits(F.col("fa"), F.col("fb"), 1) <= max_bits)).select("a", "b")
    big = shared.where(F.col("c") > PAIRED)
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit((1 << (63 - 8 * p - i)) if 8 * p + i else -(1 << 63)).cast("long") for p in range(8) if p not in t for i in range(8)]) for t in tuples])
    flip = F.explode(F.element_at(flips, (F.shiftright("key", 8 * width) + 1).cast("int"))).alias("flip")
    if max_bits == 1:  # a pair at one bit: one of the two is the common neighbour; at two bits it must not link
        flips_one = big.select("key", "id", "f", flip)
        named = flips_one.select("key", "id", F.col("f")[0].bitwiseXOR(F.col("flip")).alias("z"), (F.col("flip") == 0).alias("own"))
        owner = named.where("own").select("key", "z", F.col("id").alias("b"))
        stars = named.where("not own").join(owner, ["key", "z"]).select(F.col("id").alias("a"), "b")
        return close.unionByName(stars)
    named = big.select("key", "id", "f", flip).select("key", "id", F.col("f")[0].bitwiseXOR(F.col("flip")).alias("z"))
    least = named.groupBy("key", "z").agg(F.min("id").alias("b"))
    stars = named.join(least, ["key", "z"]).where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    return close.unionByName(stars)


def simhash_components(docs: DataFrame, words: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, copies), one row per input row; copies: rows with the same fingerprint.

    component_id is the least doc_id reachable over links of max_bits or fewer differing bits, the row's own included.
    Texts that are null or have no words have fingerprint zero and link like others. Repeated rows share a
    fingerprint; rows with a null id are linked too but never name a component (it is null if all its ids are null).
    An empty table gives an empty result; extra columns are not read.
    """
    f = staged(fingerprints(docs, words, 1, id_col, text_col).select("doc_id", F.col("f")[0].alias("f")), "fingerprints")
    classes = staged(f.groupBy("f").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    edges = staged(hamming_edges(classes.select(F.col("f").alias("id"), F.array("f").alias("f")), max_bits), "links")
    roots = staged(components(edges), "roots")
    linked = roots.join(classes.select(F.col("f").alias("node"), "least"), "node")
    names = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = roots.join(names, "root").select(F.col("node").alias("f"), "component")
    table = classes.join(named, "f", "left").select(F.col("f").alias("_f"), "copies", F.coalesce("component", "least").alias("component_id"))
    table = staged(table, "named")  # so that the join below deals both sides anew and a frequent fingerprint can be split
    return f.join(table, F.col("f") == F.col("_f")).select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id", "copies")


def _verified(close: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of candidate pairs (a, b): those whose shingle sets are similar. close is staged; texts: (id, text)."""
    wanted = close.select(F.col("a").alias("id")).union(close.select("b"))
    return confirmed(close, staged(sieved(texts, wanted, "id").where("_maybe").select("id", "text"), "texts"), words, similarity)


def confirmed(close: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """`_verified` by texts that are staged, those of the pairs and few others."""
    both = close.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = set(shingles(x.as_py() or "", words)), set(shingles(y.as_py() or "", words))
                both = len(s & t)
                keep.append(both >= similarity * (len(s) + len(t) - both) - 1e-9 if s or t else True)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return staged(both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long"), "links")


def _wide_keys(bytes_: Column, tuples: list[tuple[int, ...]]) -> Column:
    """Rows of (number of the tuple, its positions), one literal array, so that the code doesn't grow with their number."""
    width = len(tuples[0])
    if width * 8 > 40 or len(tuples) > 1 << 16:
        raise ValueError("keys don't fit a long")
    one = lambda t, n: reduce(lambda x, i: x + F.shiftleft(F.get(bytes_, t[i]), 8 * i), range(width), F.shiftleft(n.cast("long"), 8 * width))
    return F.explode(F.transform(F.array(*[F.array(*map(F.lit, t)) for t in tuples]), one))


def _near(a: Column, b: Column, planes: int, similarity: float, min_matches: int) -> Column:
    """Whether two fingerprints share min_matches positional bytes and are near enough for the similarity.

    At a Jaccard similarity s the shingle sets' cosine is 2s / (1 + s), so a bit differs with the angle's share p of pi;
    the bound is 4.5 standard deviations over the mean of p (65 of 256 bits at 0.8). What it rejects the exact rest finds.
    """
    bits = 64 * planes
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most = math.ceil(bits * p + 4.5 * math.sqrt(bits * p * (1 - p)))
    return (differing_bits(a, b, planes) <= most) & (shared_bytes(a, b, planes) >= min_matches)


def _index_pairs(sets: DataFrame, planes: int, key_bytes: int, keys: int, near: Callable[[Column, Column], Column]) -> DataFrame:
    """(a, b): near pairs of the byte-position index. sets: (id, f).

    A posting of up to PAIRED_WIDE members gives all its near pairs. A larger one links each member to a centre, another for
    each key. Fingerprints travel with the postings, so no join makes a row for a text and key.
    """
    tuples = position_tuples(8 * planes, key_bytes, keys)
    rows = sets.select("id", "f", F.array(*[_byte(F.col("f"), p) for p in range(8 * planes)]).alias("bytes"))
    rows = rows.select("id", "f", _wide_keys(F.col("bytes"), tuples).alias("key"))
    centre = F.min(F.struct(F.xxhash64("id", "key").alias("h"), "id", "f"))
    some = rows.groupBy("key").agg(F.count("*").alias("c"), centre.alias("x")).where("c > 1").select("key", "c", F.col("x.id").alias("a"), F.col("x.f").alias("fa"))
    # in a large posting only members near the centre go on; small ones keep all
    shared = rows.join(some, "key").where((F.col("c") <= PAIRED_WIDE) | ((F.col("id") != F.col("a")) & near(F.col("f"), F.col("fa"))))
    shared = staged(shared.select("key", "id", F.when(F.col("c") <= PAIRED_WIDE, F.col("f")).alias("f"), F.when(F.col("c") > PAIRED_WIDE, F.col("a")).alias("a")), "postings")
    small = shared.where("a is null").select("key", "id", "f")
    other = small.select("key", F.col("id").alias("b"), F.col("f").alias("fb"))
    pairs = small.join(other, "key").where((F.col("id") < F.col("b")) & near(F.col("f"), F.col("fb"))).select(F.col("id").alias("a"), "b")
    stars = shared.where("a is not null").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
    found = staged(pairs.unionByName(stars).distinct(), "candidates")
    unstage(shared)
    return found


def _hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    grams = set(shingles(text or "", words))
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(x, 42) for x in grams]), ">u8").astype(np.uint64))


def _common(first: DataFrame, words: int) -> np.ndarray:
    """Hashes of shingles that several texts of a sample hold, most common last. Only an order: results don't depend on it.

    The sample grows with the texts; the COMMON hashes at most that reach the driver are those over a count found from a histogram.
    """
    share = max(SAMPLE_SHARE, min(1.0, SAMPLE / max(first.count(), 1)))
    some = first.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [_hashes(t.as_py(), words) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["h"])

    often = staged(some.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "often")
    least, total = 2, 0
    for r in often.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect():  # a row for each count that occurs
        total += r.k
        if total > COMMON:
            least = r.n + 1
            break
    found = sorted(often.where(F.col("n") >= least).collect(), key=lambda r: (r.n, r.h))
    return np.array([r.h for r in found], np.int64).view(np.uint64)


def parity_bitmap(h: np.ndarray, bits: int) -> bytes:
    """A bit is the parity of the hashes that fall on it, so two sets differ in at least as many shingles as their bitmaps in bits."""
    return np.packbits(np.bincount((h >> np.uint64(20)).astype(np.int64) % bits, minlength=bits).astype(np.uint8) & 1).tobytes()


def wide_bitmap(h: np.ndarray) -> bytes | None:
    """A bitmap that grows with the set, for sets that fill one of BITMAP bits."""
    return parity_bitmap(h, 1 << (len(h) - 1).bit_length()) if len(h) > BITMAP else None


def set_prefix(h: np.ndarray, order: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of a set's sorted hashes in one order of all: a set that is similar to one of n shingles shares at least
    similarity * n with it, so two similar sets share one of the first n - ceil(similarity * n) + 1 of each.

    order: sorted common hashes and their ranks; other hashes come before them, by themselves.
    """
    in_order, rank_of = order
    if not len(h):
        return h.view(np.int64)
    rank = np.zeros(len(h), np.int64)
    if len(in_order):
        at = np.minimum(np.searchsorted(in_order, h), len(in_order) - 1)
        rank = np.where(in_order[at] == h, rank_of[at] + 1, 0)
    return h[np.lexsort((h, rank))[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]].view(np.int64)


def _shingle_sets(first: DataFrame, common: np.ndarray, words: int, similarity: float, planes: int) -> DataFrame:
    """(id, n, f, bits, wide, prefix, whole): distinct shingles, their fingerprint, their parity bitmaps, the first of them in one
    order of all shingles, a digest of all. One pass over the texts."""
    by_hash = np.argsort(common)
    order = first.sparkSession.sparkContext.broadcast((common[by_hash], by_hash))  # COMMON entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [_hashes(t.as_py(), words) for t in b.column(1)]
            longs = pa.list_(pa.int64())
            cols = [
                b.column(0), pa.array([len(h) for h in found], pa.int64()), pa.array([_majority(h, planes) for h in found], longs), pa.array([parity_bitmap(h, BITMAP) for h in found], pa.binary()),
                pa.array([wide_bitmap(h) for h in found], pa.binary()), pa.array([set_prefix(h, order.value, similarity) for h in found], longs), pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n", "f", "bits", "wide", "prefix", "whole"])

    return staged(first.select("id", "text").mapInArrow(run, "id long, n long, f array<bigint>, bits binary, wide binary, prefix array<bigint>, whole binary"), "sets")


def _may_be_near(na: int, x: bytes, nb: int, y: bytes, similarity: float) -> bool:
    """Whether two sets' wide bitmaps allow the similarity; the larger is folded to the smaller's size, which keeps parities."""
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(u) < len(v):
        u, v = v, u
    differ = int(np.bitwise_count(np.bitwise_xor.reduce(u.reshape(-1, len(v)), axis=0) ^ v).sum())
    shared = min((na + nb - differ) // 2, na, nb)
    return shared >= similarity * (na + nb - shared) - 1e-9


def _by_wide_bitmaps(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, withheld) but those of two long sets that their wide bitmaps tell apart: an exact bound."""
    long = lambda c: sets.where("wide is not null").select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [wa is None or wb is None or _may_be_near(na, wa, nb, wb, similarity) for na, wa, nb, wb in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1, 2)], ["a", "b", "withheld"])

    both = pairs.join(long("a"), "a", "left").join(long("b"), "b", "left").select("a", "b", "withheld", "na", "wa", "nb", "wb")
    return both.mapInArrow(run, "a long, b long, withheld boolean")


def _met(rows: list[np.ndarray], similarity: float, few: int) -> np.ndarray | None:
    """(a, b, ra, rb, withheld) of the pairs that meet in a unit, have different roots and can be similar.

    rows: id, root, n, side, i, j, number of the unit, bits and, if given, p1 and p2 as columns, units whole and in order. In a
    unit of two blocks only members of different sides meet. Members that share a shingle before the unit's met there already. Bits are the parity bitmap, an exact bound. A unit gives the pairs of each two roots
    that are nearest by bitmap, `few` at most (0: all); withheld says whether it had more.
    """
    ids, root, n, side, i, j, unit, bits, *before = rows
    one, found, x, k = i == j, [], np.arange(len(ids)), 0
    while True:  # members k apart in the order, of all units at once
        k += 1
        x = x[: np.searchsorted(x, len(ids) - k)]
        x = x[unit[x] == unit[x + k]]
        if not len(x):
            break
        y = x + k
        ok = (root[x] != root[y]) & (one[x] | (side[x] != side[y])) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9)
        u, y = x[ok], y[ok]
        if before:
            p = before[0]
            met = ((p[u] != 0) & ((p[u] == p[y]) | (p[u] == p[y][:, ::-1]))).any(1)
            u, y = u[~met], y[~met]
        differ = np.bitwise_count(bits[u] ^ bits[y]).sum(1, dtype=np.int64)
        both = n[u] + n[y]
        shared = np.minimum((both - differ) // 2, np.minimum(n[u], n[y]))
        near = shared >= similarity * (both - shared) - 1e-9
        if near.any():
            found.append(np.stack([u[near], y[near], differ[near]]))
    if not found:
        return None
    u, y, differ = np.concatenate(found, axis=1)
    swap = root[u] > root[y]
    u, y = np.where(swap, y, u), np.where(swap, u, y)
    held = np.zeros(len(u), np.int64)
    if few:
        order = np.lexsort((differ, root[y], root[u], unit[u]))
        u, y = u[order], y[order]
        start = np.r_[True, (np.diff(unit[u]) != 0) | (np.diff(root[u]) != 0) | (np.diff(root[y]) != 0)]
        first = np.maximum.accumulate(np.where(start, np.arange(len(u)), 0))
        place, size = np.arange(len(u)) - first, np.diff(np.r_[np.flatnonzero(start), len(u)])[np.cumsum(start) - 1]
        keep = place < few
        u, y, held = u[keep], y[keep], (size > few)[keep].astype(np.int64)
    return np.stack([np.minimum(ids[u], ids[y]), np.maximum(ids[u], ids[y]), root[u], root[y], held])


def _prefix_postings(sets: DataFrame, similarity: float = 0.0) -> DataFrame:
    """(key, id, p1, p2): prefix shingles that several sets hold, with them; p1, p2: the set's two shingles before it, 0 for none.

    With a similarity, a set is left out of a posting where no member can be similar to it if this is the first shingle that the two
    share: by its size, and as only what stands from its place on can be shared. A similar pair keeps the first it shares.
    """
    before = lambda i, k: F.coalesce(F.get("prefix", i - k), F.lit(0).cast("long"))
    place = [F.col("n").cast("int").alias("n")] if similarity else []
    each = lambda x, i: F.struct(x.alias("key"), before(i, 1).alias("p1"), before(i, 2).alias("p2"), *([i.alias("i")] if similarity else []))
    rows = sets.select("id", *place, F.explode(F.transform("prefix", each)).alias("x")).select("id", *place, "x.*")
    sizes = [F.min("n").alias("lo"), F.max("n").alias("hi")] if similarity else []
    keys = sets.select(*place, F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("c"), *sizes).where("c > 1")
    if not similarity:
        return staged(rows.join(keys.select("key"), "key"), "prefixes")
    keys = keys.where((F.col("c") > 2) | (F.col("lo") >= similarity * F.col("hi") - 1e-6))
    other = lambda c: F.when(F.col("c") == 2, F.col("lo") + F.col("hi") - F.col("n")).otherwise(F.col(c))
    least, most = F.greatest(other("lo"), similarity * F.col("n")), F.least(other("hi"), F.col("n") / similarity)
    may = (least <= most + 1e-6) & (F.col("n") - F.col("i") >= similarity / (1 + similarity) * (F.col("n") + least) - 1e-6)
    return staged(rows.join(keys, "key").where(may).select("key", "id", "p1", "p2"), "prefixes")


def _exact_pairs(postings: DataFrame, sets: DataFrame, roots: DataFrame, similarity: float, few: int) -> DataFrame:
    """(a, b, ra, rb, withheld): pairs of different roots that share a prefix shingle and whose sizes and bitmaps let them be similar.

    Every similar pair of different roots is among them; with few, that many of each two roots (ra, rb) in a unit, the nearest by
    bitmap, withheld if there were more.
    A posting meets block by block, so that no task gets it whole and no member is left out; pairs that share one of the two
    shingles before the posting's have met in that one's, so most pairs are made once. Members of the posting's
    largest root are linked already and never meet each other: once a group is linked, its postings cost their size only.
    """
    rooted = postings.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    each = rooted.groupBy("key", "root").agg(F.count("*").alias("r"))
    open_ = each.groupBy("key").agg(F.count("*").alias("roots"), F.sum("r").alias("c"), F.max(F.struct("r", "root")).alias("top")).where("roots > 1")
    rows = rooted.join(open_.select("key", "c", F.col("top.r").alias("r"), F.col("top.root").alias("top")), "key")
    outer, inner = F.ceil((F.col("c") - F.col("r")) / UNIT), F.ceil(F.col("r") / UNIT)
    dealt = F.xxhash64("id")
    rows = rows.withColumns({"m": outer, "all": outer + inner, "side": F.when(F.col("root") == F.col("top"), outer + F.pmod(dealt, inner)).otherwise(F.pmod(dealt, outer))})
    rows = rows.select("key", "id", "root", "side", "m", "all", "p1", "p2").join(sets.select("id", "n", "bits"), "id")
    last = F.when(F.col("side") < F.col("m"), F.col("all")).otherwise(F.col("m")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.select("id", "root", "n", "side", "bits", "key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "p1", "p2")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in chain(sliced(batches, 1 << 16), [None]):
            if b is not None:
                cols = [b.column(k).to_numpy() for k in (0, 1, 2, 3, 6, 7, 5)] + [np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint64).reshape(b.num_rows, -1), np.stack([b.column(k).to_numpy() for k in (8, 9)], axis=1)]
                held = cols if held is None else [np.concatenate(c) for c in zip(held, cols, strict=True)]
            if held is None:
                return
            starts = np.r_[True, (np.diff(held[6]) != 0) | (np.diff(held[4]) != 0) | (np.diff(held[5]) != 0)]
            end = int(np.flatnonzero(starts)[-1]) if b is not None else len(starts)  # the last unit may go on
            if end:
                out = _met([*(c[:end] for c in held[:6]), np.cumsum(starts)[:end], *(c[:end] for c in held[7:])], similarity, few)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["a", "b", "ra", "rb", "withheld"])
                held = [c[end:] for c in held]

    met = rows.mapInArrow(run, "a long, b long, ra long, rb long, withheld long")
    return met.groupBy("a", "b").agg(F.max("ra").alias("ra"), F.max("rb").alias("rb"), (F.max("withheld") > 0).alias("withheld"))


def _still_open(postings: DataFrame, met: DataFrame, roots: DataFrame, after: DataFrame) -> DataFrame:
    """The postings' members whose group of `roots` had pairs withheld from `met` with another one that is still apart in `after`."""
    now = lambda c: after.select(F.col("node").alias(c), F.col("root").alias(f"now_{c}"))
    held = met.where("withheld").select("ra", "rb").distinct().join(now("ra"), "ra", "left").join(now("rb"), "rb", "left")
    apart = held.where(F.coalesce("now_ra", "ra") != F.coalesce("now_rb", "rb"))
    groups = staged(apart.select(F.col("ra").alias("root")).union(apart.select("rb")).distinct(), "open")
    members = staged(roots.join(groups, "root", "left_semi").select(F.col("node").alias("id")).union(groups.select("root")).distinct(), "members")
    return staged(postings.join(members, "id", "left_semi"), "prefixes")


def text_key(text: Column) -> Column:
    """The key of a text: equal texts are one class, as are texts whose 64-bit hashes are equal. Null is the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, planes: int = 4, key_bytes: int = 3, keys: int = 24, min_matches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(cls, least, rows, root, component_id, keep), one row per distinct text: groups of texts linked by shingle-set Jaccard of
    `similarity` or more. cls: `text_key`; least: the least id of the text's rows (nulls last, so null only if all are);
    rows: their number; root: the group; component_id: its least id; keep: the one text of the group that has it.

    Copies are one class first, then texts with one shingle set. A pair at Jaccard 0.8 differs in 15 % of simhash bits, at
    0.9 in 10 %; over 32 bytes it shares 9 or 13 bytes on average, an unrelated pair 0.1, so pairs of the byte-position
    index with fewer than min_matches, or more differing bits than `_near` allows, are left to the exact rest and the others compared
    by their whole shingle sets. No number of bytes is certain to agree at 0.8, so the index alone can't be whole: every
    pair at `similarity` that it leaves apart is then found by `_exact_pairs`. For over 10^8 distinct texts raise key_bytes to 4.
    Texts without words are one group. Ties of the least id (an id with several texts) go to the smaller cls. An empty
    table gives an empty result; extra columns are not read.
    """
    last = F.lit(2**63 - 1)
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("id"))
    exact = staged(base.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")), "exact")
    marked = sieved(base, exact.where("rows > 1"), "id")  # the others are alone and go on where they are
    # a row that repeats an id and its text is there twice: one of them goes on
    copies = marked.where("_maybe").join(exact.select("id", "doc_id"), ["id", "doc_id"], "left_semi").dropDuplicates(["id", "doc_id"])
    first = staged(marked.where("not _maybe").select("id", "text").unionByName(copies.select("id", "text")), "first")
    sets = _shingle_sets(first, _common(first, words), words, similarity, planes)
    same = sets.groupBy("whole").agg(F.min("id").alias("a"), F.count("*").alias("c")).where("c > 1").select("whole", "a")
    links = [staged(sets.select("id", "whole").join(same, "whole").where("id <> a").select("a", F.col("id").alias("b")), "links")]
    distinct = sets.join(links[0].select(F.col("b").alias("id")), "id", "left_anti")
    tried = _index_pairs(distinct.select("id", "f"), planes, key_bytes, keys, lambda a, b: _near(a, b, planes, similarity, min_matches))
    links.append(_verified(tried, first, words, similarity))
    # the exact rest: some pairs of each two groups that may touch, then all pairs of those still apart that had more
    postings, used = _prefix_postings(distinct, similarity), [exact, first, sets, tried]
    groups = lambda: staged(components(reduce(DataFrame.unionByName, links)), "roots")
    roots = groups()
    for few in (FEW, 0):
        met = staged(_exact_pairs(postings, sets, roots, similarity, few), "met")
        cand = staged(_by_wide_bitmaps(met.join(tried, ["a", "b"], "left_anti"), sets, similarity), "candidates")
        links.append(_verified(cand.select("a", "b"), first, words, similarity))
        tried = tried.unionByName(cand.select("a", "b"))
        before, roots = roots, groups()
        used += [postings, met, cand, before]
        if met.where("withheld").isEmpty():
            break
        postings = _still_open(postings, met, before, roots)
    out = staged(exact.join(roots.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias("cls"), F.col("doc_id").alias("least"), "rows", F.coalesce("root", "id").alias("root")), "classes")
    for table in (*used, roots, *links):
        unstage(table)
    names = out.groupBy("root").agg(F.min(F.struct("least", "cls")).alias("x"))
    known = lambda c: F.when(c != last, c)
    out = out.join(names, "root").select("cls", known(F.col("least")).alias("least"), "rows", "root", known(F.col("x.least")).alias("component_id"), (F.col("cls") == F.col("x.cls")).alias("keep"))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, component_id, keep), one row per input row; keep: the row has its group's least id and the text that is kept.

    Rows that repeat both are equal here and all keep; see `near_classes` for the rest and for its parameters.
    """
    classes = staged(near_classes(docs, id_col=id_col, text_col=text_col, **how).select("cls", "component_id", F.col("keep").alias("_keep")), "near")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("cls")).join(classes, "cls")
    return rows.select("doc_id", "component_id", (F.col("_keep") & F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("keep"))
