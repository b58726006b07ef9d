"""Exact top-k search by inner product over a bit-sliced index.

Vectors are quantised to floor(scale * x). A block of rows is an index: for each attribute (dimension) and each bit a
bitmap over the block's rows. A query's scores are the sum of its attributes' slices, shifted by its own bits, made
with bitmap full adders on the more significant slices; rows are selected from the most significant slice of the sum
downward, and the rows that the slices left out could still change are resolved by the exact product.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import staged

#: Least significant slices that are left to the exact step.
DROPPED = 2
#: Components of this size and more are left to wider integers, so that sums of products of the others fit 64 bits.
WIDE = 1 << 26
#: Dimensions beyond which all components are.
MOST_DIMS = 1 << 10


class BitSlices:
    """Bitmaps of a block of integer vectors whose rows are in order of id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        n, self.dims = values.shape
        self.low = int(values.min()) if values.size else 0
        y = values - self.low
        self.bits = max(1, int(y.max()).bit_length()) if values.size else 1
        self.drop = min(DROPPED, self.bits - 1)
        self.words = (n + 63) // 64
        pad = np.zeros((self.words * 64 - n, self.dims), bool)
        pack = lambda x: np.packbits(np.vstack([x, pad]), axis=0).T.copy().view(np.uint64)
        self.slices = [pack((y >> i & 1).astype(bool)) for i in range(self.drop, self.bits)]
        self.all = self.bitmap(np.arange(n))

    def bitmap(self, rows: np.ndarray) -> np.ndarray:
        x = np.zeros(self.words * 64, bool)
        x[rows] = True
        return np.packbits(x).view(np.uint64)

    @staticmethod
    def rows(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8)))

    def add(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the sum over attributes of |q| * y, or of |q| times y's complement where
        q is negative: the score less a constant of the query, without the dropped slices."""
        size, minus = np.abs(query), query < 0
        levels: list[list[np.ndarray]] = [[] for _ in range(2 * 64)]
        for j in range(int(size.max()).bit_length()):
            has = (size >> j & 1).astype(bool)
            plus_at, minus_at = np.flatnonzero(has & ~minus), np.flatnonzero(has & minus)
            for i, s in enumerate(self.slices):
                levels[i + j] += [s[plus_at], ~s[minus_at]]
        out = []
        for k in range(len(levels) - 1):
            a = np.concatenate(levels[k]) if levels[k] else np.zeros((0, self.words), np.uint64)
            while len(a) > 1:
                third = len(a) // 3
                if third:
                    x, y, z = a[:third], a[third : 2 * third], a[2 * third : 3 * third]
                    xy = x ^ y
                    levels[k + 1].append((x & y) | (xy & z))
                    a = np.concatenate([xy ^ z, a[3 * third :]])
                else:
                    levels[k + 1].append((a[0] & a[1])[None])
                    a = (a[0] ^ a[1])[None]
            out.append(a[0] if len(a) else np.zeros(self.words, np.uint64))
            if not any(map(len, levels[k + 1 :])):
                break
        return out

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but row number own (-1: none): higher score first, then smaller id."""
        live = self.all if own < 0 else self.all & ~self.bitmap(np.array([own]))
        count = int(np.bitwise_count(live).sum())
        if count > k and np.any(query):
            total = self.add(query)
            rest, need, kth = live, k, 0
            for i in range(len(total) - 1, -1, -1):
                ones = rest & total[i]
                n = int(np.bitwise_count(ones).sum())
                if n >= need:
                    rest, kth = ones, kth | 1 << i
                else:
                    need, rest = need - n, rest & ~total[i]
            # the slices left out add at most (2^drop - 1) * sum|q| to a sum in units of 2^drop
            least = kth - ((1 << self.drop) - 1) * int(np.abs(query).sum()) // (1 << self.drop)
            if least > 0:
                above, equal = np.zeros_like(live), live
                for i in range(len(total) - 1, -1, -1):
                    if least >> i & 1:
                        equal = equal & total[i]
                    else:
                        above, equal = above | equal & total[i], equal & ~total[i]
                live = above | equal
        rows = self.rows(live)
        scores = self.values[rows] @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


class Block:
    """Rows of a block: bit slices of those with moderate components, wider integers for the rest."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]  # whole numbers as doubles, exact at any size
        wide = self.wide_rows(self.values)
        self.plain, self.wide = np.flatnonzero(~wide), np.flatnonzero(wide)
        self.slices = BitSlices(self.ids[self.plain], self.values[self.plain].astype(np.int64))

    @staticmethod
    def wide_rows(values: np.ndarray) -> np.ndarray:
        return (np.abs(values) >= WIDE).any(1) if values.shape[1] <= MOST_DIMS else np.ones(len(values), bool)

    def own(self, query_id: int, query: np.ndarray) -> int:
        """The number of a row with the query's id and vector, -1 if another block has it."""
        lo, hi = np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, "right")
        same = np.flatnonzero((self.values[lo:hi] == query).all(1))
        return int(lo + same[0]) if len(same) else -1

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows but the query's own. A score beyond 64 bits is whole here."""
        own, found, rest = self.own(query_id, query), [], self.wide
        if self.wide_rows(query[None])[0]:
            rest = np.arange(len(self.ids))
        elif len(self.plain):
            at = int(np.searchsorted(self.plain, own)) if own >= 0 else 0
            at = at if own >= 0 and at < len(self.plain) and self.plain[at] == own else -1
            ids, scores = self.slices.top(query.astype(np.int64), at, k)
            found = list(zip(ids.tolist(), scores.tolist(), strict=True))
        q = [int(x) for x in query] if len(rest) else []
        found += [(int(self.ids[r]), sum(int(x) * y for x, y in zip(self.values[r], q, strict=True))) for r in rest.tolist() if r != own]
        return sorted(found, key=lambda x: (-x[1], x[0]))[:k]


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, whole numbers as doubles, or null for a vector that takes no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    # F.floor gives a long, which large ones leave; a double less its remainder by one is exact
    whole = lambda y: y - F.pmod(y, F.lit(1.0)) + F.lit(0.0)
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: whole(x.cast("double") * scale)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, block_rows: int = 8192, query_rows: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that is_query holds for, the k best rows by integer inner product.

    Candidates are all rows but the query's own; ties go to the smaller id; fewer candidates give fewer rows. Vectors that
    are null, or hold a null or non-finite component, or have no id take no part; queries meet candidates of their own
    length. Components of any finite size are exact; a score among the best that leaves 64 bits raises. Each row of an
    id that repeats is a query and a candidate of its own: equal rows give equal results, once each. An empty table gives an
    empty result; extra columns are not read. is_query is over vec_id. Queries go in blocks against blocks of rows: a task
    holds a block of each, and a block's index serves all queries of a block of queries.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    # of rows that are equal in all, k + 1 are enough as candidates: the best k of them but one
    rows = rows.groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    rows = staged(rows.select("vec_id", "v", "copies", F.size("v").alias("dims"), is_query.alias("asked")), "vectors")
    n, asked = rows.count(), rows.where("asked").count()
    blocks, groups = max(1, math.ceil(n / block_rows)), max(1, math.ceil(asked / query_rows))
    index = rows.select("vec_id", "v", "dims", F.least("copies", F.lit(k + 1)).cast("int").alias("times"), F.pmod(F.xxhash64("vec_id", "v", F.lit(7)), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    # every column has a name of its own: both sides come of one table, and a cogroup mixes up equal ones
    queries = rows.where("asked").select(F.col("vec_id").alias("query"), F.col("v").alias("q"), F.col("copies").alias("of"), F.col("dims").alias("q_dims"), F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(groups)).cast("int").alias("q_part"))
    wanted = queries.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(asked):
            times = rows["times"].to_numpy()
            block = Block(np.repeat(rows["vec_id"].to_numpy(), times), np.repeat(np.stack(rows["v"].to_list()), times, axis=0))
            for q, v, copies in zip(asked["query"], asked["q"], asked["of"], strict=True):
                v = np.asarray(v, float)
                out += [(q, copies, v.tobytes(), i, str(s)) for i, s in block.top(q, v, k)]
        return pd.DataFrame(out, columns=["query_id", "copies", "q", "vec_id", "score"]).astype({"query_id": "int64", "copies": "int64", "vec_id": "int64"})

    near = index.groupBy("dims", "block", "part").cogroup(wanted.groupBy("q_dims", "q_block", "q_part")).applyInPandas(search, "query_id long, copies long, q binary, vec_id long, score string")
    # whole scores travel as text: 38 digits hold any but an absurd one, and the cast back to a long raises where it must
    near = near.withColumn("score", F.col("score").cast("decimal(38,0)"))
    order = Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = best.withColumn("score", F.coalesce(F.col("score").try_cast("long"), F.raise_error(F.lit("a score does not fit 64 bits")).cast("long")))
    return best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", "rank", "vec_id", "score")
