"""Shared helpers of the corpus operators: staged tables, guarded joins, batch bounds, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small side up to which it is broadcast; beyond it the join is salted.
BROADCAST_ROWS = 10_000
SALTS = 64
#: Words of 64 bits that a sieve has at most.
SIEVE = 1 << 19

_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="tidegraph-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; its folder then stays for the cluster's own clean-up
        return


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns the table read back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/tidegraph-{spark.sparkContext.applicationId}"
    if root not in _made:
        _made.add(root)
        atexit.register(_remove, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Deletes a staged table that no later plan reads."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, f)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, which Spark bounds by bytes (spark.sql.execution.arrow.maxBytesPerBatch), of a few rows each."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def join_small(big: DataFrame, small: DataFrame, on: Column, salt: Column, big_key: str, small_key: str) -> DataFrame:
    """Joins a table that is usually small: broadcast if its counted rows allow it, else salted on the big side's rows.

    small must be staged (it is counted). The salted form splits a hot key over SALTS tasks.
    """
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, "inner")
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_bsalt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(spread, on & (F.col("_bsalt") == F.col("_salt")), "inner").drop("_salt", "_bsalt")


def sieved(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows with a column `_maybe`, which is true if the row's key, a long, is among those of keys, and false for most others.

    Rows stay where they are: each key sets one bit of at most SIEVE words, and these are broadcast, however many keys there
    are. More keys only make more other rows true (5 % at 1.7 million keys), so what is true must still be joined.
    """
    h = F.xxhash64(F.col(key), F.lit(53))
    word = F.pmod(F.shiftright(h, 6), F.lit(SIEVE).cast("long")).alias("_word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63).cast("long")).cast("int")).alias("_bit")
    words = keys.select(word, bit).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.select("*", word, bit).join(F.broadcast(words), "_word", "left")
    return met.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))).drop("_word", "_bit", "_bits")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0: rows never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node of its component. Alternating large-star and small-star rounds.

    Nodes without an edge don't occur. Each round is two aggregations, each with a join on the node that Spark can
    split where a node has many neighbours; rounds are logarithmic in the longest path. Edges never leave the
    executors; each round is a written table.
    """
    e = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        big = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        big = staged(big, "large-star")
        # here every edge runs from u to a smaller v
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        nxt = staged(small, "small-star")
        unstage(big)
        unstage(e)
        e = nxt
        # settled once every node has one edge, to a node without any
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        if ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or ups = 1 and least = 0").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    # settled: stars around each least node
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
