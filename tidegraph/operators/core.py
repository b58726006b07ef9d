"""DataFrame operators of the news graph: roll-ups, joins, caps, upserts, retrieval, windows.

Each keeps its work in one shuffle where the keys allow it, filters before it joins, and never collects.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the cluster's shared checkpoint folder (else under the warehouse), its lineage cut."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First n rows of each key. Spark limits groups before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def impact_leaderboard(mentions: DataFrame, events: DataFrame, impacts: DataFrame, limit: int = 20) -> DataFrame:
    """Entities by distinct impacts, then distinct events, of the events in whose chunks they are mentioned."""
    m = mentions.select("chunk_id", "entity_id").distinct()
    joined = m.join(events.select("chunk_id", "event_id"), "chunk_id").join(impacts.select("event_id", "impact_id"), "event_id")
    agg = joined.groupBy("entity_id").agg(F.countDistinct("impact_id").alias("impact_links"), F.countDistinct("event_id").alias("event_count"))
    return agg.orderBy(F.desc("impact_links"), F.desc("event_count"), "entity_id").limit(limit)


def rollup_best(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Greatest non-empty value of each column, each on its own."""
    return df.groupBy(key).agg(*[F.max(F.nullif(F.col(c), F.lit(""))).alias(c) for c in cols])


def cooccurring(mentions: DataFrame, most_per_chunk: int | None = None) -> DataFrame:
    """(a, b, chunk_id): pairs of different entities of a chunk, a < b; chunks with more entities than allowed are out."""
    m = mentions.select("chunk_id", "entity_id").distinct()
    if most_per_chunk:
        m = m.withColumn("_n", F.count("*").over(Window.partitionBy("chunk_id"))).where(F.col("_n") <= most_per_chunk).drop("_n")
    return m.withColumnRenamed("entity_id", "a").join(m.withColumnRenamed("entity_id", "b"), "chunk_id").where("a < b")


def neighbours(mentions: DataFrame, entity, limit: int = 3) -> DataFrame:
    """The entities that share most chunks with the given one: semi-join first, so only its chunks are counted."""
    m = mentions.select("chunk_id", "entity_id").distinct()
    mine = m.where(F.col("entity_id") == entity).select("chunk_id")
    agg = m.where(F.col("entity_id") != entity).join(mine, "chunk_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("shared"))
    return agg.orderBy(F.desc("shared"), "entity_id").limit(limit)


def unprocessed(chunks: DataFrame, runs: DataFrame, only_failed: bool = False) -> DataFrame:
    """Chunks without a run, or without a successful one."""
    done = runs.where("success") if only_failed else runs
    return chunks.join(done.select("chunk_id"), "chunk_id", "left_anti")


def insert_or_ignore(target: DataFrame, rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """target and the rows whose key it lacks; of rows that share a key, the first in order."""
    fresh = top_per_key(rows, [key], order).join(target.select(key), key, "left_anti")
    return target.unionByName(fresh)


def merge_upsert(target: DataFrame, rows: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """One row per key of either side; a non-null new value replaces the old one."""
    new = rows.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in cols])
    both = target.join(new, F.col(key) == F.col("_k"), "full_outer")
    return both.select(F.coalesce(key, "_k").alias(key), *[F.coalesce(f"_{c}", c).alias(c) for c in cols])


def score_set(expected: Column, observed: Column) -> tuple[Column, Column, Column]:
    """(hits, recall, precision), rounded to 4; recall of nothing expected is 1, precision of nothing observed 0."""
    e, o = F.array_distinct(expected), F.array_distinct(observed)
    hits = F.size(F.array_intersect(e, o))
    return hits, F.when(F.size(e) > 0, F.round(hits / F.size(e), 4)).otherwise(1.0), F.when(F.size(o) > 0, F.round(hits / F.size(o), 4)).otherwise(0.0)


def close_returns(bars: DataFrame, last: int = 5) -> DataFrame:
    """Percent change over the last closes of each symbol; the oldest has none; a zero close before gives null."""
    newest = top_per_key(bars, ["symbol"], [F.desc("bar_date")], last)
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("bar_date"))
    return newest.withColumn("pct", F.round((F.try_divide(F.col("close"), before) - 1) * 100, 6))


def carry_forward(turns: DataFrame, key: str, order: str, col: str, out: str) -> DataFrame:
    """The last non-null value of col before each row of its key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn(out, F.last(F.col(col), ignorenulls=True).over(w))


def greedy_keep(order: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ids kept when documents are taken in order and one linked to a kept earlier one is dropped.

    order: (id, rank); pairs: (a, b). Rounds over written tables: a row with no undecided or kept earlier neighbour
    stays, one with a kept earlier neighbour goes.
    """
    ranked = pairs.join(order.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(order.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b")
    edges = ranked.select(F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("early"), F.when(F.col("ra") < F.col("rb"), F.col("b")).otherwise(F.col("a")).alias("late")).distinct().checkpoint()
    state = order.select("id").withColumn("kept", F.lit(None).cast("boolean")).checkpoint()
    while state.where("kept is null").limit(1).count():
        near = edges.join(state.select(F.col("id").alias("early"), F.coalesce(F.col("kept").cast("int"), F.lit(2)).alias("k")), "early").groupBy("late").agg(F.max(F.when(F.col("k") == 1, 1).otherwise(0)).alias("beaten"), F.max(F.when(F.col("k") == 2, 1).otherwise(0)).alias("open"))
        state = state.join(near.withColumnRenamed("late", "id"), "id", "left").select("id", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("beaten") == 1, False).when(F.coalesce("open", F.lit(0)) == 0, True).alias("kept")).checkpoint()
    return state.where("kept").select("id")
