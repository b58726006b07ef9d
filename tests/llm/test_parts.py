"""Operators' own interfaces: typed parts, near-duplicates, media formats, broken archives, the pipeline's stages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import chat, licenses, media, mixing, simhash, warc


def test_parts(spark):
    turn = [("text", "see <|image:9|> ", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None), (None, "x", None, None, None, None, None), ("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3)]
    df = spark.createDataFrame([(1, 0, "user", turn), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.parse_chats(chat.format_chats(df, parts_col="parts")).first()
    assert [(a["index"], a["type"], a["ref"], a["tokens"]) for a in r.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 25), (2, "document", "c.pdf", 1728)]
    assert r.turns[0].text == "see <|image:9|> <|image:0|>x<|audio:1|><|document:2|>" and r.loss_text == ""


def test_near_duplicates(spark):
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, group = [], {}
    for g in range(30):
        base = say(300)
        for k in range(1 + g % 4):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(len(w))] = "changed"
            rows.append((len(rows), " ".join(w)))
            group[rows[-1][0]] = g
        if g % 5 == 0:
            rows.append((len(rows), " ".join(base)))
            group[rows[-1][0]] = g
    rows.append((len(rows), None))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted(r.doc_id for r in got if r.keep)
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    assert len(got) == len(rows) and kept == sorted([*first.values(), len(rows) - 1])


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_hamming_edges_of_large_postings(spark, bits):
    rng = random.Random(bits)
    fps = {rng.getrandbits(64) for _ in range(50)}
    base = rng.getrandbits(64)
    fps |= {base ^ rng.getrandbits(9) for _ in range(300)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f, [f]) for f in signed], "id long, f array<bigint>")
    from tidegraph.llm.common import components

    got = {r.node: r.root for r in components(simhash.hamming_edges(df, bits)).collect()}
    up = {f: f for f in signed}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    assert {f: got.get(f, f) for f in signed} == {f: find(f) for f in signed}


def test_images():
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (37, 23), dtype=np.uint8)
    assert (media.decode_image(media.encode_pgm(grey.tobytes(), 23)) == grey).all()
    text = b"P2 # note\n23 37\n255\n" + b" ".join(b"%d" % v for v in grey.ravel())
    assert (media.decode_image(text) == grey).all()
    rgb = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode_image(b"P6\n7 5\n255\n" + rgb.tobytes()) == rgb).all()
    import struct

    rows = b"".join(r[:, ::-1].tobytes() + b"\0" * 3 for r in rgb[::-1])
    bmp = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(rows), 0, 0, 54, 40, 7, 5, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (media.decode_image(bmp) == rgb).all()
    up = np.kron(grey, np.ones((3, 5)))
    small = media.area_resize(up, 37, 23)
    assert np.allclose(small, grey) and np.isclose(media.area_resize(grey, 8, 9).mean(), grey.mean())
    for bad in (b"", b"P5", b"GIF", b"P5\n9 9\n255\nxx", b"BM12"):
        with pytest.raises((ValueError, IndexError, struct.error)):
            media.decode_image(bad)


def test_broken_archives():
    good = warc.write_record(1, "u", b"abc" * 1000) + warc.write_record(2, None, b"abc" * 1000, 1)
    assert [(r["type"], r["size"]) for r in warc.read_records(good)] == [("response", 3000), ("revisit", 3000)]
    import gzip

    plain = gzip.decompress(good)
    assert len(list(warc.read_records(plain))) == 2 and list(warc.read_records(b"")) == []
    for bad in (good[:-9], plain[:-9], plain.replace(b"abcabc", b"abcabd", 1)):
        with pytest.raises(ValueError):
            list(warc.read_records(bad))


def test_notice_with_gaps(spark):
    text = "x Permission is hereby granted, free of charge, to any individual person obtaining a copy of this software and the associated documentation files"
    got = licenses.scan_licenses(spark.createDataFrame([(1, text), (2, "permission is hereby granted")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0].labels == "mit" and 0.6 <= got[0].score < 1 and got[1].labels == ""


def test_splitting_tree(spark):
    root = spark.sql("select array(1000L, 300L, 0L, 57L) as counts")
    got = mixing.split_quotas(root, 21, 1357, 42).orderBy("shard").collect()
    assert [sum(c) for c in zip(*(r.counts for r in got), strict=True)] == [1000, 300, 0, 57]
    assert [r.shard for r in got] == list(range(21)) and {sum(r.counts) for r in got} <= {64, 65}
    assert all(min(r.counts) >= 0 for r in got) and len({tuple(r.counts) for r in got}) > 5


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_id", F.lit(1))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == P.COLUMNS, name
        assert out.count() >= (1 if "mixing" not in name else docs.count())
    assert P.STAGES[-1][1](spark, docs, sf).count() == docs.count()
    assert P.run(spark, sf).count() > 100
