"""Incremental ingestion: tables that take each micro-batch once, and the staged pass from articles to chunks over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidegraph.operators.core import top_per_key


class LedgerTable:
    """Rows by a key, never twice, in parquet files: data/batch=<id>/bucket=<b> and, written after them, ledger/batch=<id>.

    A batch counts once its ledger entry is whole. One that was broken off is overwritten when it is replayed, one that
    counts is not written again. New keys are looked up in the buckets that the batch touches only.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str, order: Sequence[Column], buckets: int = 64):
        self.spark, self.folder, self.schema, self.key, self.order, self.buckets = spark, folder.rstrip("/"), schema, key, list(order), buckets

    def batches(self) -> list[int]:
        """The batches that count."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.folder}/ledger")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch=") and fs.exists(hadoop.Path(f"{self.folder}/ledger/{n}/_SUCCESS")))

    def _read(self, batches: Sequence[int]) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField("bucket", IntegerType()), StructField("batch", LongType())])
        if not batches:
            return self.spark.createDataFrame([], schema).drop("batch")
        rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/data").parquet(*[f"{self.folder}/data/batch={b}" for b in batches])
        return rows.drop("batch")

    def read(self) -> DataFrame:
        return self._read(self.batches()).select(self.schema.names)

    def unknown(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """The first row of each key that the batches before don't have, with its bucket."""
        rows = top_per_key(rows.select(self.schema.names), [self.key], self.order).withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        have = [b for b in self.batches() if before is None or b < before]
        if not have:
            return rows
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # `buckets` numbers at most
        known = self._read(have).where(F.col("bucket").isin(touched)).select("bucket", self.key)
        return rows.join(known, ["bucket", self.key], "left_anti")

    def write(self, rows: DataFrame, batch: int) -> DataFrame:
        """Takes a batch and returns the rows that are new with it; the same ones if it is replayed."""
        if batch not in self.batches():
            self.unknown(rows, batch).select(*self.schema.names, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/batch={batch}")
            self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")
        return self._read([batch]).select(self.schema.names)


def staged_pass(articles: LedgerTable, chunks: LedgerTable, gate: Callable[[DataFrame], DataFrame], chunker: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: what passes the gate goes into articles, the chunks of what is new there into chunks.

    A pass that breaks between the two tables is finished by its replay: the articles of a batch are read back from their table.
    """

    def run(batch: DataFrame, number: int) -> None:
        fresh = articles.write(gate(batch), number)
        chunks.write(chunker(fresh), number)

    return run
