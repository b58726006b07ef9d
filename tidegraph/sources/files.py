"""Sources and sinks: scrape drops, dictionaries, market panels, keyed appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions import text as X
from tidegraph.operators.core import insert_or_ignore
from tidegraph.operators.mentions import entity_dictionary

ARTICLE = "url string, source string, source_rss string, status string, error string, title string, published string, text string, author string, source_provider string"


def read_scrapes(spark: SparkSession, path: str) -> DataFrame:
    """Articles of scrape payload files, a row each; a missing status is ok."""
    payload = spark.read.schema(f"scraped_at_utc string, count int, articles array<struct<{ARTICLE.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
    rows = payload.select("scraped_at_utc", F.explode("articles").alias("a")).select("a.*", "scraped_at_utc")
    return rows.withColumn("status", F.coalesce("status", F.lit("ok")))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, ticker, company_name) of a ticker dictionary: names, their forms without legal suffix, and listed
    aliases, canonical; the last row that claims an alias has it."""
    rows = spark.read.schema("ticker string, company_name string, aliases string").option("header", True).csv(path).withColumn("at", F.monotonically_increasing_id())
    name = X.canonical_name(F.col("company_name"))
    forms = F.concat(F.array(F.lower("ticker"), name, X.strip_legal(name)), F.transform(F.split(F.coalesce("aliases", F.lit("")), ";"), X.canonical_name))
    alias = rows.select(F.explode(F.array_distinct(forms)).alias("alias"), "ticker", "company_name", "at").where("alias <> ''")
    return alias.groupBy("alias").agg(F.max_by(F.struct("ticker", "company_name"), "at").alias("m")).select("alias", "m.*")


def read_entity_dictionary(spark: SparkSession, companies: str, institutions: str) -> DataFrame:
    """`mentions.entity_dictionary` of the two dictionary files, rows in the files' order."""
    read = lambda path, schema: spark.read.schema(schema).option("header", True).csv(path).withColumn("ord", F.monotonically_increasing_id())
    return entity_dictionary(read(companies, "ticker string, company_name string, aliases string"), read(institutions, "canonical_id string, display_name string, entity_type string, ticker string, aliases string"))


def read_panel(spark: SparkSession, path: str, metrics: dict[str, list[str]], date_col: str = "date") -> DataFrame:
    """Long bars (bar_date, ticker, a column a metric, bar_uid) of a wide panel; metrics: ticker to its columns, in the
    order Open, High, Low, Close, Volume."""
    wide = spark.read.parquet(path)
    names = ("open", "high", "low", "close", "volume")
    bars = F.array(*[F.struct(F.lit(t).alias("ticker"), *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(n) for n, c in zip(names, cols, strict=True)]) for t, cols in metrics.items()])
    rows = wide.select(F.to_date(date_col).alias("bar_date"), F.explode(bars).alias("b")).select("bar_date", "b.*")
    return rows.withColumn("bar_uid", F.concat_ws("_", "ticker", F.col("bar_date").cast("string")))


def append_new(spark: SparkSession, rows: DataFrame, path: str, key: str, order: list) -> None:
    """Insert-or-ignore into a table of parquet files, made if missing: only rows with a key it lacks are written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        rows.limit(0).write.parquet(path)
    have = spark.read.schema(rows.schema).parquet(path)
    fresh = insert_or_ignore(have.limit(0), rows, key, order).join(have.select(key), key, "left_anti")
    fresh.select(rows.columns).write.mode("append").parquet(path)
