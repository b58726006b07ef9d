"""Entity linking and target resolution: exact and fuzzy alias links, phrases contained in a text, the tiers of a question."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions import text as X

#: Phrases that are cut from a question before it is matched.
QUESTION_PHRASES = (
    "what is the latest news on", "what is the latest news about", "latest news on", "latest news about", "news on", "news about",
    "what happened to", "tell me about", "latest on", "what do you know about", "give me an update on",
)
#: Entity labels that may link fuzzily.
FUZZY_LABELS = ("ORG", "MISC")


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel addition."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & at.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def _ratio(a: str, b: str) -> float:
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: the best ratio among the shared words and the shared words with either side's others, all sorted."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left, right = (" ".join([both, *sorted(s)]).strip() for s in (x - y, y - x))
    return max([_ratio(left, right)] + ([_ratio(both, left), _ratio(both, right)] if both else []))


def fuzzy_links(mentions: DataFrame, aliases: DataFrame, threshold: float = 92.0, margin: float = 2.0) -> DataFrame:
    """(mention, alias, score) of mentions with one clearly closest alias.

    Only aliases of the same first letter and of a length within max(4, half the mention's) are compared, each distinct
    mention once. None is given if a second alias reaches the threshold and is less than margin behind.
    """
    m = mentions.select("mention").where("mention <> ''").distinct()
    near = F.abs(F.char_length("alias") - F.char_length("mention")) <= F.greatest(F.lit(4), F.floor(F.char_length("mention") / 2))
    pairs = m.join(aliases.select("alias").distinct(), (F.substring("mention", 1, 1) == F.substring("alias", 1, 1)) & near)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    good = pairs.withColumn("score", score("mention", "alias")).where(F.col("score") >= threshold)
    by = Window.partitionBy("mention").orderBy(F.desc("score"), "alias")
    top = good.withColumn("_rn", F.row_number().over(by)).where("_rn <= 2")
    best = top.groupBy("mention").agg(F.min_by(F.struct("alias", "score"), "_rn").alias("b"), F.max(F.when(F.col("_rn") == 2, F.col("score"))).alias("second"))
    clear = F.col("second").isNull() | (F.col("b.score") - F.col("second") >= margin)
    return best.where(clear).select("mention", "b.alias", "b.score")


def link_mentions(mentions: DataFrame, aliases: DataFrame, threshold: float = 92.0) -> DataFrame:
    """mentions (mention, label, ...) with alias, link_method and link_score: exact, else fuzzy for organisations and
    miscellaneous names; unlinked rows have nulls. mention is canonical; aliases holds each alias once."""
    known = aliases.select(F.col("alias").alias("_exact")).distinct()
    rows = mentions.join(known, F.col("mention") == F.col("_exact"), "left")
    open_ = rows.where(F.col("_exact").isNull() & F.col("label").isin(*FUZZY_LABELS))
    fuzzy = fuzzy_links(open_, aliases, threshold).select(F.col("mention").alias("_m"), F.col("alias").alias("_alias"), "score")
    out = rows.join(fuzzy, (F.col("mention") == F.col("_m")) & F.col("_exact").isNull() & F.col("label").isin(*FUZZY_LABELS), "left")
    method = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_alias").isNotNull(), "fuzzy")
    return out.select(*mentions.columns, F.coalesce("_exact", "_alias").alias("alias"), method.alias("link_method"), F.when(F.col("_exact").isNotNull(), F.lit(100.0)).otherwise(F.col("score")).alias("link_score"))


def _pieces(text: Column) -> Column:
    """Runs of word characters and each other character, in order: joined, the text again."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+|\W"), F.lit(0))


def contained_aliases(texts: DataFrame, aliases: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, alias): the longest alias that stands in the text between word boundaries, ties to the least alias.

    Every run of as many pieces as some alias has is looked up by equality, so the work is linear in the text; aliases
    start and end in a word character.
    """
    a = aliases.select("alias").where("alias <> ''").distinct()
    sizes = sorted(r[0] for r in a.select(F.size(_pieces(F.col("alias")))).distinct().collect())
    if not sizes:
        return texts.select(F.col(id_col).alias("id"), F.lit(None).cast("string").alias("alias")).limit(0)
    run = lambda k: F.when(F.size("p") >= k, F.transform(F.sequence(F.lit(1), F.size("p") - (k - 1)), lambda i: F.array_join(F.slice("p", i, k), ""))).otherwise(F.array().cast("array<string>"))
    rows = texts.select(F.col(id_col).alias("id"), _pieces(F.col(text_col)).alias("p")).where(F.size("p") > 0)
    runs = rows.select("id", F.explode(F.array_distinct(F.concat(*[run(k) for k in sizes]))).alias("alias"))
    return runs.join(a, "alias").groupBy("id").agg(F.min_by("alias", F.struct(-F.char_length("alias"), "alias")).alias("alias"))


def normal_question(question: Column) -> Column:
    """The canonical question without set phrases, cut in the order given."""
    q = X.canonical_name(question)
    for p in QUESTION_PHRASES:
        q = F.replace(q, F.lit(p), F.lit(" "))
    return F.trim(F.regexp_replace(q, r"\s+", " "))


def resolve_targets(questions: DataFrame, tickers: DataFrame, names: DataFrame, entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(question_id, canonical_name, display_name, ticker, entity_type, confidence), a row per question.

    questions (question_id, question), tickers (alias, ticker), names (ticker, display_name), entities (alias,
    canonical_name, display_name, entity_type, ticker), mentions (canonical_name, display_name, entity_type, ticker,
    confidence). The first of: a ticker in capitals, a ticker's alias, an entity's alias (fuzzily too), an alias inside
    the question, an entity's alias inside it, a mentioned name. Without any the names are null and confidence is 0.
    """
    q = questions.select("question_id", "question", normal_question(F.col("question")).alias("q"))
    named = tickers.join(names, "ticker", "left").select("alias", F.col("ticker").alias("canonical_name"), F.coalesce("display_name", "alias").alias("display_name"), "ticker", F.lit("ORG").alias("entity_type"))
    known = entities.select("alias", "canonical_name", F.coalesce("display_name", "canonical_name").alias("display_name"), "ticker", F.coalesce("entity_type", F.lit("ORG")).alias("entity_type"))
    fields = ("canonical_name", "display_name", "ticker", "entity_type")

    def tier(df: DataFrame, rank: int, confidence: Column, tie: Column) -> DataFrame:
        return df.select("question_id", F.struct(F.lit(rank).alias("rank"), tie.cast("double").alias("tie"), *fields, confidence.cast("double").alias("confidence")).alias("t"))

    caps = q.select("question_id", F.posexplode(F.regexp_extract_all("question", F.lit(r"\b([A-Z]{1,5})\b"), F.lit(1))).alias("at", "ticker"))
    caps = caps.join(names, "ticker").select("question_id", "at", F.col("ticker").alias("canonical_name"), "display_name", "ticker", F.lit("ORG").alias("entity_type"))
    linked = link_mentions(q.select("question_id", F.col("q").alias("mention"), F.lit("ORG").alias("label")), known).where("alias is not null").select("question_id", "alias")
    inside = lambda table: contained_aliases(q, table, "question_id", "q").withColumnRenamed("id", "question_id").join(table, "alias")
    seen = mentions.groupBy(*fields).agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("c"))
    keys = seen.withColumn("alias", F.explode(F.array_distinct(F.array(F.lower("canonical_name"), F.lower("display_name")))))
    none = F.lit(0)
    found = tier(caps, 1, F.lit(0.99), F.col("at"))
    found = found.unionByName(tier(q.join(named, F.col("q") == F.col("alias")), 2, F.lit(0.98), none))
    found = found.unionByName(tier(linked.join(known, "alias"), 3, F.lit(0.97), none))
    found = found.unionByName(tier(inside(named), 4, F.lit(0.95), none)).unionByName(tier(inside(known), 5, F.lit(0.94), none))
    found = found.unionByName(tier(q.join(keys, F.col("q") == F.col("alias")), 6, F.greatest(F.lit(0.75), F.col("c")), -F.col("c")))
    best = found.groupBy("question_id").agg(F.min("t").alias("t"))
    return questions.select("question_id").join(best, "question_id", "left").select("question_id", *[f"t.{f}" for f in fields], F.coalesce("t.confidence", F.lit(0.0)).alias("confidence"))
