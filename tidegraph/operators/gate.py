"""The article gate: what of scraped articles goes on, with its key, time, period and hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions import temporal as D
from tidegraph.functions import text as X
from tidegraph.operators.core import top_per_key
from tidegraph.operators.nlp import near_dup_keep


def article_id(url: Column, published: Column) -> Column:
    """The key of an article without one: a digest of its URL and day, so that another scrape finds it again."""
    return X.stable_key(F.coalesce(url, F.lit("")), F.date_format(published, "yyyy-MM-dd"))


def article_gate(articles: DataFrame, now: Column, skip: DataFrame | None = None, least_words: int = 80, granularity: str = "month", near: bool = True, similarity: float = 0.86) -> DataFrame:
    """Articles (ord, article_id, url, status, text, published, scraped_at) that pass, with published_ts, period_key, content_hash.

    Status ok or null; at least `least_words` words; of equal texts, white space at their ends aside, the first by ord. The
    time is the published one, else that of the scrape, else now; an article without an id gets one of URL and day. skip
    (article_id): known ones go, after the first of equal texts has been chosen. near: of near-duplicates the oldest stays, then
    the one of the least URL, then id. Null texts are no article; an empty table gives none.
    """
    bare = F.regexp_replace("text", X.ENDS, "")
    rows = articles.where((F.col("status") == "ok") | F.col("status").isNull()).withColumn("text", bare).where(X.word_count(F.col("text")) >= F.lit(max(least_words, 1)))
    rows = top_per_key(rows.withColumn("content_hash", X.content_hash(F.col("text"))), ["content_hash"], [F.col("ord")])
    rows = rows.withColumn("published_ts", F.coalesce(D.parse_published(F.col("published")), D.parse_published(F.col("scraped_at")), now.cast("timestamp")))
    own = F.nullif(F.col("article_id").cast("string"), F.lit(""))
    rows = rows.withColumns({"article_id": F.coalesce(own, article_id(F.col("url"), F.col("published_ts"))), "period_key": D.period_key(F.col("published_ts"), granularity)})
    if skip is not None:
        rows = rows.join(skip.select(F.col("article_id").cast("string").alias("article_id")).distinct(), "article_id", "left_anti")
    if not near:
        return rows
    # the greedy order is time, URL, id; near_dup_keep orders by its date column, then id
    kept = near_dup_keep(rows.select("article_id", "text", F.struct("published_ts", F.coalesce("url", F.lit("")).alias("url")).alias("at")), "article_id", "text", "at", similarity=similarity)
    return rows.join(kept.select(F.col("id").alias("article_id")), "article_id", "left_semi")
