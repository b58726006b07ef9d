"""Near-duplicate removal batch after batch: an index of the kept articles, looked up by the buckets that a batch touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tidegraph.operators.core import cut
from tidegraph.operators.nlp import near_dup_keep, set_features, verified
from tidegraph.streaming.ingest import LedgerTable


class NearIndex:
    """Kept articles (id, text, counts, bitmaps) and their bands, in tables that take a batch once (`LedgerTable`).

    Batches are in the order of their dates: what comes later never drops what was kept before, so batches keep what
    `near_dup_keep` keeps of all of them at once. Bands lie in bands/batch=<id>/bucket=<b>; a batch reads its own buckets only.
    """

    def __init__(self, spark: SparkSession, folder: str, words: int = 5, similarity: float = 0.86, buckets: int = 64):
        self.spark, self.folder, self.words, self.similarity, self.buckets = spark, folder.rstrip("/"), words, similarity, buckets
        schema = StructType([StructField("id", StringType()), StructField("text", StringType()), StructField("n", IntegerType()), StructField("bits", ArrayType(LongType()))])
        self.kept = LedgerTable(spark, f"{self.folder}/kept", schema, "id", [F.col("text")], buckets)

    def _members(self, features: DataFrame) -> DataFrame:
        return features.select("id", F.explode("bands").alias("band")).withColumn("bucket", F.pmod("band", F.lit(self.buckets)).cast("int"))

    def candidates(self, features: DataFrame, batches: list[int]) -> DataFrame:
        """(a, b): kept articles and those of the batch that share a band."""
        mine = cut(self._members(features))
        touched = [r.bucket for r in mine.select("bucket").distinct().collect()]  # `buckets` numbers at most
        paths = [f"{self.folder}/bands/batch={b}" for b in batches]
        theirs = self.spark.read.schema("id string, band long, bucket int, batch long").option("basePath", f"{self.folder}/bands").parquet(*paths).where(F.col("bucket").isin(touched))
        return theirs.select(F.col("id").alias("a"), "bucket", "band").join(mine.select(F.col("id").alias("b"), "bucket", "band"), ["bucket", "band"]).select("a", "b").distinct()

    def keep(self, articles: DataFrame, batch: int) -> DataFrame:
        """(id) of the batch's articles (id, day, text) that are kept; replays give the same. Ids that the index has are not taken again."""
        done = self.kept.batches()
        if batch not in done:
            before = [b for b in done if b < batch]
            known = self.kept._read(before).select("id", "text", "n", "bits")
            rows = cut(articles.select(F.col("id").cast("string").alias("id"), "day", "text").join(known.select("id"), "id", "left_anti"))
            features = cut(set_features(rows, self.words))
            if before:
                pairs = cut(self.candidates(features, before))
                met = known.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
                both = verified(pairs, features.select("id", "n", "bits").unionByName(met.select("id", "n", "bits")), rows.select("id", "text").unionByName(met.select("id", "text")), self.words, self.similarity)
                rows = cut(rows.join(both.select(F.col("b").alias("id")), "id", "left_anti"))
            ids = cut(near_dup_keep(rows, "id", "text", "day", self.words, self.similarity))
            chosen = features.join(ids, "id", "left_semi")
            self._members(chosen).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/bands/batch={batch}")
            self.kept.write(rows.join(ids, "id", "left_semi").select("id", "text").join(features.select("id", "n", "bits"), "id", "left"), batch)
        return self.kept._read([batch]).select("id")
