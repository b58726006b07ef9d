"""A streaming form of ingestion: articles or audit events to de-duplicated period counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.temporal import period_key


def period_counts(stream: DataFrame, id_col: str, time_col: str, by: str, late: str = "1 day", granularity: str = "month") -> DataFrame:
    """Counts per period and `by`, each id once within the watermark."""
    rows = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])
    return rows.groupBy(period_key(F.col(time_col), granularity).alias("period_key"), F.col(by)).agg(F.count("*").alias("n"))
