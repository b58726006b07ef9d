import pytest
from pyspark.sql import functions as F

from tidegraph.operators import answers as A
from tidegraph.operators import linking as L


def test_token_set_ratio():
    assert L.token_set_ratio("acme", "acme corp") == 100 and L.token_set_ratio("", "a") == 0
    assert L.token_set_ratio("abcd", "abxd") == pytest.approx(75)
    assert L._common("abcbdab", "bdcaba") == 4
    assert L.token_set_ratio("new york times", "new york post") == pytest.approx(200 * 8 / 21)  # the shared words against the shorter side


def test_links(spark):
    aliases = spark.createDataFrame([("microsoft",), ("acme steel",), ("acme steal",), ("apple",)], "alias string")
    rows = [("microsoft", "PER"), ("microsofte", "ORG"), ("microsofte", "PER"), ("acme stael", "ORG"), ("zzz", "ORG"), ("", "ORG"), (None, "ORG"), ("microsofte", "ORG")]
    got = sorted((r.mention or "", r.label, r.alias, r.link_method) for r in L.link_mentions(spark.createDataFrame(rows, "mention string, label string"), aliases).collect())
    assert len(got) == 8
    assert [g for g in got if g[2]] == [("microsoft", "PER", "microsoft", "exact")] + [("microsofte", "ORG", "microsoft", "fuzzy")] * 2


def test_contained_word_boundaries(spark):
    texts = spark.createDataFrame([(1, "the fed and federal reserve act"), (2, "fedex grew"), (3, "at&t rose"), (4, ""), (5, None)], "id long, text string")
    aliases = spark.createDataFrame([("fed",), ("federal reserve",), ("at&t",), ("reserve",)], "alias string")
    assert {r.id: r.alias for r in L.contained_aliases(texts, aliases).collect()} == {1: "federal reserve", 3: "at&t"}
    assert L.contained_aliases(texts, aliases.limit(0)).count() == 0


def test_tiers(spark):
    q = spark.createDataFrame([(1, "Is XY or AB up?"), (2, "news about alpha beta"), (3, "tell me about the central bank"), (4, "why did alpha beta fall"), (5, "will the central bank act"), (6, "jane roe"), (7, "nothing here"), (8, None)], "question_id long, question string")
    tickers = spark.createDataFrame([("alpha beta", "AB"), ("ab", "AB")], "alias string, ticker string")
    names = spark.createDataFrame([("AB", "Alpha Beta")], "ticker string, display_name string")
    known = spark.createDataFrame([("the central bank", "cb", "Central Bank", "ORG", None)], "alias string, canonical_name string, display_name string, entity_type string, ticker string")
    seen = spark.createDataFrame([("jane roe", "Jane Roe", "PER", None, 0.9), ("jane roe", "Jane Roe", "PER", None, 0.4)], "canonical_name string, display_name string, entity_type string, ticker string, confidence double")
    got = {r.question_id: (r.canonical_name, r.confidence) for r in L.resolve_targets(q, tickers, names, known, seen).collect()}
    assert got == {1: ("AB", 0.99), 2: ("AB", 0.98), 3: ("cb", 0.97), 4: ("AB", 0.95), 5: ("cb", 0.94), 6: ("jane roe", 0.9), 7: (None, 0.0), 8: (None, 0.0)}


def test_answers(spark):
    text = "Answer\nNegative for banks, confidence: 150%.\nEvidence:\nRates rose [S2] [S9] [S2]\nTheory\nHowever, bullish."
    row = spark.createDataFrame([(text,), ("",), (None,)], "a string")
    known = F.array(F.lit("rate_hike"), F.lit("tariff"))
    got = [r.x for r in row.select(A.read_answer(F.col("a"), known).alias("x")).collect()]
    assert (got[0].direction, got[0].confidence, got[0].mechanisms, got[0].counter, got[0].overclaims) == ("negative", 100, ["rate_hike"], True, [])
    assert (got[1].direction, got[1].confidence) == ("unclear", None) and got[2].direction == "unclear"
    g = A.grounding(F.col("a"), F.array(F.lit("S1"), F.lit("S2")))
    first, empty, _ = (r.g for r in row.select(g.alias("g")).collect())
    assert first.used == ["S2"] and first.has_theory and empty["count"] == 0
    pass_ = A.case_passes(F.lit(0.5), F.lit(1.0), F.lit(0.5), g, F.lit(True))
    assert [r.p for r in row.select(pass_.alias("p")).collect()] == [True, False, False]
