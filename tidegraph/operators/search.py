"""Retrieval over chunks, articles, mentions, events and vectors, the knowledge tables and the graph's views.

chunks: chunk_id, article_id, text, published, period_key; articles: article_id, title, url, source; mentions: chunk_id,
entity_id; events: event_id, chunk_id, confidence, period_key; vectors: chunk_id, embedding. Other columns go along.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions import text as X
from tidegraph.functions import vectors as V
from tidegraph.functions.dates import let
from tidegraph.operators.core import neighbours, top_per_key


def filter_chunks(rows: DataFrame, ids: DataFrame | None = None, start: str | None = None, end: str | None = None, source: str | None = None, periods: Sequence[str] | None = None) -> DataFrame:
    """The conjunction of the given filters; ids: (chunk_id). Filters stand before any join, so they reach the scan."""
    if start:
        rows = rows.where(F.col("published") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("published") <= F.lit(end).cast("date"))
    if source:
        rows = rows.where(F.col("source") == source)
    if periods:
        rows = rows.where(F.col("period_key").isin(*periods))
    return rows.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi") if ids is not None else rows


def with_articles(chunks: DataFrame, articles: DataFrame) -> DataFrame:
    return chunks.join(articles, "article_id")


def entity_chunks(mentions: DataFrame, chunks: DataFrame, entity, limit: int = 800) -> DataFrame:
    """The newest chunks that mention an entity."""
    mine = mentions.where(F.col("entity_id") == entity).select("chunk_id")
    return chunks.join(mine, "chunk_id", "left_semi").orderBy(F.desc_nulls_last("published"), "chunk_id").limit(limit)


def event_chunks(links: DataFrame, events: DataFrame, chunks: DataFrame, key: Column, limit: int = 24, prior: float = 0.55, periods: Sequence[str] | None = None, **filters) -> DataFrame:
    """Chunks of the events that `links` (event_id, ...) ties to a key: the most confident `limit` events of the periods are
    taken first, date and source filters apply after. Adds prior: the confidence, or a default for null and zero."""
    mine = links.where(key).select("event_id").distinct()
    found = events.where(F.col("period_key").isin(*periods)) if periods else events
    top = found.join(mine, "event_id", "left_semi").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "event_id").limit(limit)
    top = top.select("event_id", "chunk_id", F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(prior)).alias("prior"))
    return filter_chunks(chunks.join(top, "chunk_id"), **filters)


def cooccurrence_chunks(mentions: DataFrame, chunks: DataFrame, entity, near: int = 3, limit: int = 4, **filters) -> DataFrame:
    """The newest rows (chunk, neighbour) of the entities that share most chunks with one; filters don't touch the counts."""
    around = neighbours(mentions, entity, near).select("entity_id")
    rows = mentions.select("chunk_id", "entity_id").distinct().join(around, "entity_id", "left_semi")
    rows = filter_chunks(chunks, **filters).join(rows, "chunk_id")
    return rows.orderBy(F.desc_nulls_last("published"), "chunk_id", "entity_id").limit(limit)


def similar(query: Sequence[float]) -> Column:
    """Cosine of the embedding column with a query vector."""
    return V.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))


def keyword_vector_score(question: str, query: Sequence[float], stop: Sequence[str] = X.QUESTION_STOP_WORDS) -> Column:
    """0.85 cosine + 0.15 share of the question's words in the text."""
    return 0.85 * similar(query) + 0.15 * X.keyword_overlap(F.lit(question), F.col("text"), stop)


def semantic_chunks(rows: DataFrame, question: str, query: Sequence[float], k: int = 8, stop: Sequence[str] = X.QUESTION_STOP_WORDS) -> DataFrame:
    """The k best chunks by vector and keywords; rows without a vector take no part."""
    scored = rows.where("embedding is not null").withColumn("score", keyword_vector_score(question, query, stop))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(k)


def event_vectors(events: DataFrame, query: Sequence[float], pool: int = 600, k: int = 8, least: float = 0.2) -> DataFrame:
    """Of the pool most confident events with a vector, the k most similar that are over `least`."""
    some = events.where("embedding is not null").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "event_id").limit(pool)
    return some.withColumn("score", similar(query)).where(F.col("score") > least).orderBy(F.desc("score"), "event_id").limit(k)


def rank_score(query: Sequence[float], as_of: Column, half_life: float = 5.0, semantic: float = 0.75, recent: float = 0.25) -> Column:
    """Weighted cosine and half-life decay; without a vector the semantic_score column or 0.5, without a date 0.8."""
    sim = F.when(F.col("embedding").isNotNull(), similar(query)).otherwise(F.coalesce(F.nullif("semantic_score", F.lit(0.0)), F.lit(0.5)))
    age = F.greatest(F.datediff(as_of, F.col("published")), F.lit(0))
    return semantic * sim + recent * F.coalesce(F.exp(-F.log(F.lit(2.0)) * age / half_life), F.lit(0.8))


def rank_rows(rows: DataFrame, score: Column, order: str | None = None) -> DataFrame:
    """One row a chunk, its best score first; of equal scores the first by the column `order`, if rows have one."""
    ties = [F.col(order)] if order else []
    return top_per_key(rows.where("chunk_id is not null").withColumn("score", score), ["chunk_id"], [F.desc("score"), *ties]).orderBy(F.desc("score"), *ties, "chunk_id")


def summary_chunks(rows: DataFrame, query: Sequence[float], as_of: Column, newest: int = 300, k: int = 24, days: float = 2.0) -> DataFrame:
    """The newest rows scored 0.7 cosine + 0.3 decay (0 without a vector or date); kind marks the best of each source."""
    pool = rows.orderBy(F.desc_nulls_last("published"), "chunk_id").limit(newest)
    sim = F.when(F.col("embedding").isNotNull(), similar(query)).otherwise(F.lit(0.0))
    age = F.greatest(F.datediff(as_of, F.col("published")), F.lit(0))
    pool = pool.withColumn("score", 0.7 * sim + 0.3 * F.coalesce(F.exp(-age / max(days, 0.1)), F.lit(0.0)))
    return diverse_first(pool, "score", "chunk_id").orderBy(F.desc("score"), "chunk_id").limit(k)


def diverse_first(rows: DataFrame, score: str, tie: str) -> DataFrame:
    """Adds kind: summary_diverse_source for the best row of each source, else summary_recency_semantic."""
    by = Window.partitionBy(F.lower(F.trim(F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))))).orderBy(F.desc(score), tie)
    return rows.withColumn("kind", F.when(F.row_number().over(by) == 1, "summary_diverse_source").otherwise("summary_recency_semantic"))


def semantic_near_dup(rows: DataFrame, group: str, rank: str, least: float = 0.9) -> DataFrame:
    """Rows of ranked pools without those that resemble a kept earlier one: by cosine if both have a vector, else by Jaccard
    of words of three letters or more. A pool is a question's few dozen candidates: one group, greedy in its order."""

    def keep(pool: pd.DataFrame) -> pd.DataFrame:
        import re

        import numpy as np

        out: list[int] = []
        words = [set(re.findall("[a-z0-9]{3,}", (t or "").lower())) for t in pool.sort_values(rank)["text"]]
        pool = pool.sort_values(rank)
        vecs = [None if e is None else np.asarray(e, float) for e in pool["embedding"]]

        def alike(i: int, j: int) -> float:
            if vecs[i] is not None and vecs[j] is not None:
                size = float(np.linalg.norm(vecs[i]) * np.linalg.norm(vecs[j]))
                return float(vecs[i] @ vecs[j]) / size if size else 0.0
            return len(words[i] & words[j]) / len(words[i] | words[j]) if words[i] and words[j] else 0.0

        for i in range(len(pool)):
            if all(alike(i, j) < least for j in out):
                out.append(i)
        return pool.iloc[out]

    return rows.groupBy(group).applyInPandas(keep, rows.schema)


def citation_numbers(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, label): S1, S2, ... by first appearance. Rows are one answer's sources: few, so one window."""
    first = rows.groupBy(key).agg(F.min(order).alias("_first"))
    return first.select(key, F.concat(F.lit("S"), F.row_number().over(Window.orderBy("_first", key)).cast("string")).alias("label"))


def context_block(rows: DataFrame, group: str, order: str, most: int = 400) -> DataFrame:
    """(group, context): a line `[label] source (date): excerpt` for each row, in order."""
    line = F.format_string("[%s] %s (%s): %s", F.col("label"), F.coalesce("source", F.lit("unknown")), F.coalesce(F.col("published").cast("string"), F.lit("unknown")), X.excerpt(F.col("text"), most))
    lines = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line")))).alias("x"))
    return lines.select(group, F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("context"))


def date_coverage(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """(first, last) day over the chunks' dates, or else their articles' timestamps; `unknown` without any."""
    day = F.coalesce(F.col("published").cast("string"), F.substring(F.col("article_time"), 1, 10))
    rows = articles.join(chunks, "article_id", "left").select(day.alias("day"))
    return rows.agg(*[F.coalesce(f("day"), F.lit("unknown")).alias(n) for f, n in ((F.min, "first"), (F.max, "last"))])


def drop_person_singletons(mentions: DataFrame, least_chunks: int = 2) -> DataFrame:
    """Mentions (chunk_id, entity_id, entity_type) but persons in fewer chunks. Counted once a person, then joined."""
    seen = mentions.where("entity_type = 'PER'").groupBy("entity_id").agg(F.countDistinct("chunk_id").alias("n")).where(F.col("n") < least_chunks).select("entity_id", F.lit("PER").alias("entity_type"))
    return mentions.join(seen, ["entity_id", "entity_type"], "left_anti")


def preferred_entity(rows: DataFrame, key: str) -> DataFrame:
    """One row a key: one with a ticker before one without, then the longer display name, then the first."""
    return top_per_key(rows, [key], [F.desc(F.coalesce(F.col("ticker"), F.lit("")) != ""), F.desc(F.char_length(F.coalesce("display_name", F.lit("")))), F.col("ord")])


def node_uid(entity: Column, period: Column) -> Column:
    return F.concat(F.replace(F.trim(F.lower(entity)), F.lit(" "), F.lit("_")), F.lit("::"), period)


def knowledge_nodes(mentions: DataFrame) -> DataFrame:
    """(entity_id, period_key, display_name, entity_type, ticker, source_chunks): first values by ord, types that are empty
    passed over; chunks distinct in order of first mention. Mentions without a ticker column give none."""
    if "ticker" not in mentions.columns:
        mentions = mentions.withColumn("ticker", F.lit(None).cast("string"))
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("ord")))
    head = lambda: F.min_by(F.struct("display_name", "ticker"), "ord")
    chunk = mentions.groupBy("entity_id", "period_key", "chunk_id").agg(F.min("ord").alias("ord"), head().alias("h"), first("entity_type").alias("entity_type")).select("*", "h.*")
    listed = F.array_sort(F.collect_list(F.struct("ord", "chunk_id")))
    nodes = chunk.groupBy("entity_id", "period_key").agg(head().alias("h"), first("entity_type").alias("entity_type"), listed.alias("x"))
    return nodes.select("entity_id", "period_key", "h.display_name", "entity_type", "h.ticker", F.transform("x", lambda r: r["chunk_id"]).alias("source_chunks"))


def knowledge_units(mentions: DataFrame, chunks: DataFrame, fallback: int = 500) -> DataFrame:
    """(knowledge_uid, kn_uid, chunk_id, text): for each entity, period and chunk the first three sentences that name the entity,
    or the chunk's first characters.

    A sentence names it by raw_name, where mentions have one, by display_name, or by entity_id if that isn't all capitals, as
    tickers are.
    """
    first = top_per_key(mentions, ["entity_id", "period_key", "chunk_id"], [F.col("ord")])
    name = F.col("entity_id").cast("string")
    terms = [F.col(c) for c in ("raw_name", "display_name") if c in mentions.columns] + [F.when((F.upper(name) != name) | (F.lower(name) == name), name)]
    named = F.struct(node_uid(name, F.col("period_key")).alias("kn_uid"), "ord", *[F.nullif(F.lower(t), F.lit("")).alias(f"t{i}") for i, t in enumerate(terms)])
    # a chunk's text meets all its entities at once, so that it is dealt, split and put into lower case once
    rows = first.groupBy("chunk_id").agg(F.collect_list(named).alias("named")).join(chunks.select("chunk_id", "text"), "chunk_id")

    def unit(m: Column, said: Column, low: Column) -> Column:
        holds = lambda s: reduce(Column.__or__, [F.coalesce(F.contains(s, m[f"t{i}"]), F.lit(False)) for i in range(len(terms))])
        text = F.array_join(F.slice(F.filter(said, lambda _, i: holds(F.get(low, i))), 1, 3), " ")
        return F.struct(m["kn_uid"].alias("kn_uid"), m["ord"].alias("ord"), text.alias("said"))

    units = let(X.sentences(F.col("text")), lambda said: let(F.transform(said, F.lower), lambda low: F.transform("named", lambda m: unit(m, said, low))))
    bare = F.transform("named", lambda m: F.struct(m["kn_uid"].alias("kn_uid"), m["ord"].alias("ord"), F.lit(None).cast("string").alias("said")))
    rows = rows.select("chunk_id", F.substring("text", 1, fallback).alias("start"), F.explode(F.when(F.col("text").isNull(), bare).otherwise(units)).alias("u"))
    text = F.when(F.col("u.said") != "", F.col("u.said")).otherwise(F.col("start"))
    uid = F.col("u.kn_uid")
    return rows.select(F.substring(F.md5(F.concat(uid, F.lit("::"), F.col("chunk_id").cast("string")).cast("binary")), 1, 16).alias("knowledge_uid"), uid.alias("kn_uid"), "chunk_id", F.col("u.ord").alias("ord"), text.alias("text"))


def node_descriptions(units: DataFrame) -> DataFrame:
    """(kn_uid, description): units' texts in order of first mention, without those that the description has already."""
    texts = units.groupBy("kn_uid", "text").agg(F.min("ord").alias("ord")).groupBy("kn_uid").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("x"))
    joined = F.aggregate("x", F.lit(""), lambda d, r: F.when(F.contains(d, r["text"]), d).otherwise(F.trim(F.concat(d, F.lit(" "), r["text"]))))
    return texts.select("kn_uid", joined.alias("description"))


def pending_embeddings(chunks: DataFrame, vectors: DataFrame, limit: int = 256) -> DataFrame:
    """The next chunks without a vector: newest first, then by place in their article."""
    have = vectors.where("embedding is not null").select("chunk_id")
    return chunks.join(have, "chunk_id", "left_anti").orderBy(F.desc_nulls_last("published"), "chunk_index", "chunk_id").limit(limit)


def parse_vector(raw: Column) -> Column:
    """A vector stored as JSON; null if it is no array of numbers."""
    return F.from_json(raw, "array<float>")


def edges_with_ends(edges: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Edges whose two ends exist; dangling ones go."""
    return edges.join(left.select(left_key), left_key, "left_semi").join(right.select(right_key), right_key, "left_semi")


def violations(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that a uniqueness constraint on non-null keys is broken by, with their number of rows."""
    some = F.lit(True)
    for k in key:
        some = some & F.col(k).isNotNull()
    return rows.where(some).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def hop_symbols(hops: DataFrame, symbols: dict[str, str], group: str, order: str, hop: str) -> DataFrame:
    """(group, symbol, hop): the market symbols of hops, the first hop that maps to one has it."""
    known = F.create_map(*[F.lit(x) for kv in symbols.items() for x in kv])
    rows = hops.withColumn("symbol", F.try_element_at(known, F.lower(F.trim(hop)))).where("symbol is not null")
    return top_per_key(rows, [group, "symbol"], [F.col(order)]).select(group, "symbol", hop)


def merge_links(*sources: DataFrame) -> DataFrame:
    """(url, provider) of ordered lists of links: the first list that has a URL names its provider, the list's order within it."""
    rows = None
    for i, s in enumerate(sources):
        s = s.select("url", "provider", F.lit(i).alias("_list"), F.col("ord").alias("_ord"))
        rows = s if rows is None else rows.unionByName(s)
    return top_per_key(rows.where("url is not null and url <> ''"), ["url"], [F.col("_list"), F.col("_ord")]).select("url", "provider")
