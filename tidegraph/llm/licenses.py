"""Licence scans by diagonal voting, in DataFrame operations only.

Rolling word grams of every text are joined by hash to the positions where templates have them; a match votes for the
diagonal (text position - template position). Votes are bit masks of template positions, so merging neighbouring
diagonals, where words were inserted or left out, is a bitwise or. A span counts if its mask covers enough of the
template within a length like the template's. The gram is two words, and a third where the template goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import ascii_lower

#: What counts as a word, once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases found wherever their words stand consecutively.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
#: Notices of common public licences, matched with gaps.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def template_positions(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(tpl, label, base, grams, words, tpos, t0, t1, t2), a row for each gram of each template: a table of fixed size.

    Templates have 2 to 64 words of [a-z0-9]; label is the label's place in the sorted labels.
    """
    labels = label_names(phrases, notices)
    rows = []
    for n, (base, (label, text)) in enumerate([(True, x) for x in phrases] + [(False, x) for x in notices]):
        w = text.split()
        if not 2 <= len(w) <= 64 or not text.replace(" ", "").isalnum() or text != text.lower():
            raise ValueError(f"not a template: {text!r}")
        grams = max(1, len(w) - 2)
        for p in range(grams):
            third = f"'{w[p + 2]}'" if len(w) > 2 else "cast(null as string)"
            rows.append(f"({n}, {labels.index(label)}, {str(base).lower()}, {grams}, {len(w)}, {p}, '{w[p]}', '{w[p + 1]}', {third})")
    return spark.sql(f"select *, xxhash64(t0, t1) as tkey from values {', '.join(rows)} as t(tpl, label, base, grams, words, tpos, t0, t1, t2)")


def label_names(phrases=PHRASES, notices=NOTICES) -> list[str]:
    names = sorted({x[0] for x in (*phrases, *notices)})
    if len(names) > 62:
        raise ValueError("at most 62 labels")
    return names


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES, coverage: float = 0.6, gap: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per input row.

    n_base: places of phrases; first_word and last_word: the least and greatest word (from 0) where one starts, else
    null; base_labels: the labels of phrases; labels: those and the notices'; both distinct, sorted, joined by commas,
    empty if none. score: 1 with a phrase, else the best notice's coverage, else 0. A notice needs `coverage` of its
    grams on diagonals at most `gap` apart, in a span of at most one and a half times its length plus gap. Null texts
    are empty; repeated rows are scanned each; an empty table gives an empty result; extra columns are not read.
    """
    names = label_names(phrases, notices)
    tpl = template_positions(docs.sparkSession, phrases, notices)
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words.alias("w"))
    n = F.greatest(F.size("w"), F.lit(1))
    rows = rows.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), n).alias("b"), F.slice("w", F.lit(3), n).alias("c")).alias("z"))
    grams = rows.select("row", "doc_id", "n_words", F.posexplode_outer("z").alias("pos", "g"))
    grams = grams.select("row", "doc_id", "n_words", "pos", F.col("g.a").alias("a"), F.col("g.b").alias("b"), F.col("g.c").alias("c"))
    on = (F.xxhash64("a", "b") == F.col("tkey")) & (F.col("a") == F.col("t0")) & (F.col("b") == F.col("t1")) & (F.col("t2").isNull() | (F.col("c") == F.col("t2")))
    # a broadcast of the fixed templates: as many rows as they have words
    hits = grams.join(F.broadcast(tpl), on, "left").withColumn("diagonal", F.col("pos") - F.col("tpos"))
    keys = ["row", "doc_id", "n_words"]
    votes = hits.groupBy(*keys, "tpl", "label", "base", "grams", "words", "diagonal").agg(F.expr("bit_or(shiftleft(1L, tpos))").alias("mask"), F.min("pos").alias("from"), F.max("pos").alias("to"))
    whole = F.col("base") & (F.bit_count("mask") == F.col("grams"))
    order = Window.partitionBy("row", "tpl").orderBy("diagonal")
    fresh = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > gap)
    votes = votes.withColumn("run", F.sum(F.when(F.coalesce(fresh, F.lit(True)), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = votes.groupBy(*keys, "tpl", "label", "base", "grams", "words", "run").agg(F.expr("bit_or(mask)").alias("mask"), F.min("from").alias("from"), F.max("to").alias("to"))
    part = F.bit_count("mask") / F.col("grams")
    found = F.when(F.col("base"), whole).otherwise((part >= coverage) & (F.col("to") - F.col("from") + 3 <= F.col("words") * 1.5 + gap))
    spans = spans.withColumns({"found": F.coalesce(found, F.lit(False)), "part": part, "bit": F.expr("shiftleft(1L, coalesce(label, 63))")})
    base = F.col("found") & F.col("base")
    out = spans.groupBy(*keys).agg(
        F.sum(F.when(base, 1).otherwise(0)).alias("n_base"),
        F.min(F.when(base, F.col("from"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("from"))).cast("long").alias("last_word"),
        F.expr("coalesce(bit_or(case when found and base then bit end), 0L)").alias("bm"),
        F.expr("coalesce(bit_or(case when found then bit end), 0L)").alias("am"),
        F.coalesce(F.max(F.when(F.col("found"), F.col("part"))), F.lit(0.0)).cast("double").alias("score"),
    )
    listed = lambda m: F.concat_ws(",", *[F.when(F.col(m).bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(x)) for i, x in enumerate(names)])
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", listed("bm").alias("base_labels"), listed("am").alias("labels"), "score")
