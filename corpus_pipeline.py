"""A training corpus from `documents`: five stages, each an operator of tidegraph.llm, each written and read again.

Removing a stage drops its decisions only: every stage takes any table with the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import langid, mixing, piecewise, quality, simhash
from tidegraph.llm.common import load, sieved, staged
from tidegraph.llm.queries import tokenizer_file
from tidegraph.shipping import shipped

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its language's calibrated probability is lower, or it has no letter.
LEAST_LANGUAGE_SCORE = 0.5


@shipped
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the line classifier rejects go. Labels come from the labels table, held-out ids excepted.

    Each row is judged by its own text: null and empty texts get the score of no good line, repeated rows and ids share
    nothing, a null id is kept or not like any other, an empty table gives an empty one.
    """
    model = quality.fit_quality_model(docs, load(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, carry=("lang", "source", "n_chars"))
    return scored.where("predicted = 1").select("doc_id", "text", "row.*")


@shipped
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter, or whose language the model can't tell, go; each is judged by its own text, as above.

    If no row has a language to learn from, the model tells none and all rows go.
    """
    pred = langid.predict_languages(docs, langid.fit_language_model(docs), carry=("lang", "source", "n_chars"))
    return pred.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("doc_id", "text", "row.*")


@shipped
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies, exact or near (five words, 0.8), one row stays: that of the least id, nulls last.

    Null and empty texts, and all others without words, are one group. Of rows that share that id and text one stays, the
    least by its other columns.
    """
    classes = simhash.near_classes(docs, words=5, similarity=0.8)
    classes = staged(classes.select(F.col("cls").alias("_cls"), F.col("least").alias("_least"), F.col("rows").alias("_rows"), "keep"), "kept")
    marked = sieved(docs.select(*COLUMNS, simhash.text_key(F.col("text")).alias("_cls")), classes.where("not keep or _rows > 1"), "_cls")
    unlike = marked.where("not _maybe").select(*COLUMNS)  # a row of its own that stays, where it is
    rows = marked.where("_maybe").join(classes.where("keep").drop("keep"), "_cls").where(F.col("doc_id").eqNullSafe(F.col("_least")))
    alone = unlike.unionByName(rows.where("_rows = 1").select(*COLUMNS))
    least = F.min(F.struct("lang", "source", "n_chars", "text"))  # texts of a class are equal
    several = rows.where("_rows > 1").groupBy("_cls", "doc_id").agg(least.alias("x")).select("doc_id", "x.*").select(*COLUMNS)
    return alone.unionByName(several)


@shipped
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources share 150 % of all words by weights 3, 1, 2, up to two passes of each: rows go, stay or come twice.

    A source whose target is below its size loses rows, one above it repeats some; rows without words go. See
    `mixing.drawn_rows` for repeated rows.
    """
    mix = staged(mixing.mix_sources(docs, weights=(3, 1, 2), share=1.5, max_passes=2), "mix")
    return mixing.drawn_rows(docs.select(*COLUMNS), mix).select(*COLUMNS)


@shipped
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row, decoded again."""
    return piecewise.encode_digests(docs, tokenizer_file())


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

#: Fitted models and fingerprints aren't SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
