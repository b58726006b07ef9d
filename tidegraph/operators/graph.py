"""The property graph as tables: vertex and edge views of the relational tables, their counts, and a sync by difference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators.core import rollup_best, top_per_key
from tidegraph.operators.search import edges_with_ends

#: The views in the order in which they may be written, vertices first, with the columns that name a row.
KEYS: dict[str, tuple[str, ...]] = {
    "periods": ("key",), "entities": ("entity_id",), "macro_events": ("event_id",), "assets": ("asset_key",), "channels": ("name",),
    "in_period": ("event_id", "period_key"), "impacts": ("impact_id",), "involves": ("event_id", "entity_id"), "transmits_via": ("event_id", "channel_name"),
}
#: What the graph is counted by.
COUNTED = ("periods", "entities", "macro_events", "assets", "channels", "impacts", "involves", "transmits_via")


def asset_key(kind: Column, target: Column) -> Column:
    """Type in lower case, `:`, id as it is; both trimmed."""
    return F.concat(F.lower(F.trim(F.coalesce(kind, F.lit("")))), F.lit(":"), F.trim(F.coalesce(target, F.lit(""))))


def channel_key(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit(""))))


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) != ""


def _last(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Of rows of one key the greatest by their other columns, as upserts in that order leave it."""
    others = [c for c in rows.columns if c not in key]
    return top_per_key(rows, key, [F.desc_nulls_last(c) for c in others]) if others else rows.distinct()


def graph_views(chunks: DataFrame, mentions: DataFrame, events: DataFrame, shocks: DataFrame, evidence: DataFrame, impacts: DataFrame, channels: DataFrame, granularity: str = "month") -> dict[str, DataFrame]:
    """The views of KEYS, each a row a key.

    chunks (chunk_id, period_key, published), mentions (chunk_id, entity_id, display_name, entity_type, ticker), events (event_id,
    chunk_id, ...), shocks (event_id, shock_type), evidence (event_id, evidence_id, evidence_text), impacts (impact_id, event_id,
    target_type, target_id, ...), channels (event_id, channel_name, direction, strength, confidence). Events whose chunk has
    no period are left out; edges need both their ends. Shock types are listed in order, the first evidence by its id.
    """
    listed = shocks.groupBy("event_id").agg(F.array_sort(F.collect_list("shock_type")).alias("shock_types"))
    first = evidence.groupBy("event_id").agg(F.min_by(F.struct("evidence_id", "evidence_text"), "evidence_id").alias("e")).select("event_id", "e.*")
    placed = events.join(chunks.where(_filled("period_key")).select("chunk_id", "period_key", "published"), "chunk_id")
    macro = placed.join(listed, "event_id", "left").join(first, "event_id", "left").withColumn("shock_types", F.coalesce("shock_types", F.array().cast("array<string>")))
    named = impacts.withColumn("asset_key", asset_key(F.col("target_type"), F.col("target_id")))
    assets = named.where(_filled("target_id")).select("asset_key", "target_type", "target_id", F.col("target_id").alias("display_name"))
    edges = named.drop("target_type", "target_id")
    via = channels.withColumn("channel_name", channel_key(F.col("channel_name")))
    known = mentions.where(_filled("entity_id"))
    views = {
        "periods": chunks.where(_filled("period_key")).select(F.col("period_key").alias("key")).distinct().select("key", F.lit(granularity).alias("granularity"), F.col("key").alias("label")),
        "entities": rollup_best(known, "entity_id", ["display_name", "entity_type", "ticker"]), "macro_events": _last(macro, ["event_id"]), "assets": _last(assets, ["asset_key"]),
        "channels": via.where("channel_name <> ''").select(F.col("channel_name").alias("name")).distinct(),
    }
    ends = views["macro_events"].select("event_id")
    involved = events.select("event_id", "chunk_id").join(known.select("chunk_id", "entity_id").distinct(), "chunk_id").select("event_id", "entity_id").distinct()
    return views | {
        "in_period": views["macro_events"].select("event_id", "period_key"), "impacts": edges_with_ends(_last(edges, ["impact_id"]), ends, views["assets"], "event_id", "asset_key"),
        "involves": involved.join(ends, "event_id", "left_semi"), "transmits_via": edges_with_ends(_last(via, ["event_id", "channel_name"]), ends, views["channels"].withColumnRenamed("name", "channel_name"), "event_id", "channel_name"),
    }


def graph_counts(views: dict[str, DataFrame], names: Sequence[str] = COUNTED) -> DataFrame:
    """(view, n) of the five kinds of vertices and three of edges."""
    out = None
    for name in names:
        row = views[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("view"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def _hashed(rows: DataFrame, key: Sequence[str], side: str) -> DataFrame:
    """Key columns, a digest of the others, and the row itself."""
    others = [c for c in rows.columns if c not in key]
    digest = F.xxhash64(F.to_json(F.struct(*others), {"ignoreNullFields": "false"})) if others else F.lit(0).cast("long")
    return rows.select(*[F.col(k).alias(f"{side}_{k}") for k in key], digest.alias(f"{side}_hash"), F.struct(*rows.columns).alias(f"{side}_row"))


def changes(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """op (insert, update, delete) and the columns of the row, the old one's where it is deleted; rows that stay as they are don't occur.

    Tables have one row a key, without null keys, and the same columns. One full outer join by key; rows are told apart by a digest.
    """
    a, b = _hashed(old.select(new.columns), key, "old"), _hashed(new, key, "new")
    both = a.join(b, [F.col(f"old_{k}") == F.col(f"new_{k}") for k in key], "full_outer")
    op = F.when(F.col("old_hash").isNull(), "insert").when(F.col("new_hash").isNull(), "delete").when(F.col("old_hash") != F.col("new_hash"), "update")
    return both.select(op.alias("op"), F.coalesce("new_row", "old_row").alias("r")).where("op is not null").select("op", "r.*")


def applied(old: DataFrame, diff: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table after its changes."""
    kept = old.join(diff.select(*key), list(key), "left_anti").select(old.columns)
    return kept.unionByName(diff.where("op <> 'delete'").select(old.columns))


def graph_changes(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """`changes` of every view: an event that moves to another period loses its old edge, a dropped event its edges."""
    return {name: changes(old[name], new[name], key) for name, key in KEYS.items() if name in new}


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    # a version counts once its last table of changes is whole
    last = list(KEYS)[-1]
    done = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/changes/{last}/_SUCCESS"))
    return sorted(int(n) for n in names if n.isdigit() and done(n))


def sync(spark: SparkSession, views: dict[str, DataFrame], folder: str) -> int:
    """Writes the views as the next version under the folder, and under `<version>/changes` what differs from the last whole one.

    Returns the version's number. A version that was broken off is written anew by the next call. Readers of the changes
    apply vertices before edges, and the other way round for deletes, in the order of KEYS.
    """
    versions = _versions(spark, folder)
    at = versions[-1] + 1 if versions else 0
    for name in KEYS:
        views[name].write.mode("overwrite").parquet(f"{folder}/{at}/{name}")
    for name in KEYS:
        read = lambda n: spark.read.schema(views[name].schema).parquet(f"{folder}/{n}/{name}")  # noqa: E731, B023
        old = read(versions[-1]) if versions else read(at).limit(0)
        changes(old, read(at), KEYS[name]).write.mode("overwrite").parquet(f"{folder}/{at}/changes/{name}")
    return at
