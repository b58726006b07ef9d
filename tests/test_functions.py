import datetime

from pyspark.sql import functions as F

from tidegraph.functions import temporal as D
from tidegraph.functions import text as X
from tidegraph.operators import core, nlp


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first().asDict()


def test_names(spark):
    got = one(spark, a=X.canonical_name(F.lit("L'Oréal  S.A. & Co-op!")), b=X.strip_legal(F.lit("acme holdings inc")), c=X.strip_legal(F.lit("Acme, Inc. Co., Ltd.")), d=X.slug(F.lit(" A b/C ")))
    assert got == {"a": "loréal s a & co-op", "b": "acme", "c": "Acme", "d": "a-b-c"}


def test_dates(spark):
    forms = ["Mon, 06 Jan 2025 10:00:00 +0000", "2025-01-06T10:00:00Z", "2025-01-06T10:00:00+00:00", "20250106T100000", "2025-01-06 10:00:00", "20250106T1000"]
    got = spark.createDataFrame([(f,) for f in forms] + [("soon",), (None,)], "s string").select(D.parse_published(F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == [datetime.datetime(2025, 1, 6, 10)] * 6 + [None, None]
    day = lambda s: F.lit(s).cast("date")
    got = one(spark, w=D.period_key(day("2024-12-30"), "week"), q=D.period_key(day("2024-12-30"), "quarter"), r=D.period_range(day("2024-01-31"), day("2024-03-01")), n=D.period_range(day("2024-02-01"), day("2024-01-01")))
    assert got == {"w": "2025-W01", "q": "2024-Q4", "r": ["2024-01", "2024-02", "2024-03"], "n": None}


def test_pack():
    assert nlp.pack_sentences(None) == [] and nlp.pack_sentences(" ") == []
    got = nlp.pack_sentences("One two three. Four five six. Seven eight nine.", 8, 4)
    assert got == ["One two three. Four five six.", "Four five six. Seven eight nine."]
    assert nlp.pack_sentences("a " * 50 + ". b.", 8, 4)[0].startswith("a a")
    assert nlp.pack_sentences("One two three. " + "x " * 9 + ".", 8, 4)[1].startswith("One two three. x")  # the overlap stays over the target


def test_enums_and_json():
    allowed = ["rate_hike", "tariff", "strike"]
    assert nlp.snap("tariff", allowed) == ("tariff", "kept") and nlp.snap("Tariff", allowed) == ("tariff", "snapped") and nlp.snap("tarif", allowed) == ("tariff", "snapped") and nlp.snap(None, allowed) == (None, "dropped")
    assert nlp.repair_json('{"a": "}"} and {"b": 1} then {"c": "tr') == '{"a": "}"} and {"b": 1}'
    assert nlp.repair_json('{"events": [{"a": 1}, {"b": "x') is None and nlp.repair_json("none") is None and nlp.repair_json(None) is None
    assert nlp.repair_json('{"a": "\\"}{"} "open }') == '{"a": "\\"}{"}' and nlp.repair_json('{} "{}\\') == "{}"


def test_greedy_keep_is_not_components(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    order = spark.createDataFrame([(i, i) for i in range(5)], "id long, rank long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "a long, b long")
    assert sorted(r.id for r in core.greedy_keep(order, pairs).collect()) == [0, 2, 3]
