"""Changes applied to the old graph give the new one; a sync writes what differs, moved events lose their old period's edge."""

from tidegraph.operators import graph as G


def graph(spark, events, mentions=(("c1", "E1", "Acme", "ORG", ""), ("c1", "E1", "Acme Corp", "", "ACM"), ("c2", "E2", "", None, None), ("c9", "E3", "x", "", ""), ("c1", "", "y", "", ""))):
    t = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return G.graph_views(
        t([("c1", "2024-01", None), ("c2", "2024-02", None), ("c3", "", None), ("c4", None, None)], "chunk_id string, period_key string, published date"),
        t(mentions, "chunk_id string, entity_id string, display_name string, entity_type string, ticker string"), t(events, "event_id string, chunk_id string, event_type string, confidence double"),
        t([("m1", "b"), ("m1", "a")], "event_id string, shock_type string"), t([("m1", "e2", "late"), ("m1", "e1", "first")], "event_id string, evidence_id string, evidence_text string"),
        t([("i1", "m1", " FX", "USD ", "up"), ("i2", "m3", "fx", "USD", "up"), ("i3", "m1", "fx", "", "up")], "impact_id string, event_id string, target_type string, target_id string, direction string"),
        t([("m1", " Risk ", "up", "weak", None), ("m1", "risk", "down", "weak", None), ("m2", "", "up", "weak", None)], "event_id string, channel_name string, direction string, strength string, confidence double"),
    )


def held(spark, views):
    """The views as small tables of their own."""
    return {name: spark.createDataFrame(v.collect(), v.schema).coalesce(1) for name, v in views.items()}


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def test_views(spark):
    v = graph(spark, [("m1", "c1", "t", 0.5), ("m2", "c2", "t", None), ("m3", "c3", "t", 1.0), ("m4", "nowhere", "t", 1.0)])
    assert {r.view: r.n for r in G.graph_counts(v).collect()} == {"periods": 2, "entities": 3, "macro_events": 2, "assets": 1, "channels": 1, "impacts": 1, "involves": 2, "transmits_via": 1}
    m1 = v["macro_events"].where("event_id = 'm1'").first()
    assert (m1.shock_types, m1.evidence_id, m1.evidence_text, m1.period_key) == (["a", "b"], "e1", "first", "2024-01")
    assert rows(v["entities"])[0] == ("E1", "Acme Corp", "ORG", "ACM")
    assert [(r.impact_id, r.asset_key) for r in v["impacts"].collect()] == [("i1", "fx:USD")]


def test_changes_give_the_new_graph(spark, tmp_path):
    one = [("m1", "c1", "t", 0.5), ("m2", "c2", "t", None), ("m5", "c1", "t", 1.0)]
    two = [("m1", "c2", "t", 0.5), ("m2", "c2", "t", 0.25), ("m6", "c2", "t", 1.0)]
    old, new = held(spark, graph(spark, one)), held(spark, graph(spark, two))
    diff = held(spark, G.graph_changes(old, new))
    for name, key in G.KEYS.items():
        assert rows(G.applied(old[name], diff[name], key)) == rows(new[name]), name
    assert sorted((r.op, r.event_id, r.period_key) for r in diff["in_period"].collect()) == [("delete", "m1", "2024-01"), ("delete", "m5", "2024-01"), ("insert", "m1", "2024-02"), ("insert", "m6", "2024-02")]
    assert sorted((r.op, r.event_id) for r in diff["macro_events"].collect()) == [("delete", "m5"), ("insert", "m6"), ("update", "m1"), ("update", "m2")]
    folder = str(tmp_path / "graph")
    assert [G.sync(spark, g, folder) for g in (old, new, new)] == [0, 1, 2]
    read = lambda at, name: spark.read.parquet(f"{folder}/{at}/changes/{name}")
    for name, key in G.KEYS.items():
        assert rows(G.applied(old[name], read(1, name), key)) == rows(new[name])
        assert read(2, name).count() == 0
