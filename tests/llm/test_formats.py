"""Media and WARC beyond our own output: depths, broken samples, other digests, chunked bodies, files, stored forms."""

import base64
import gzip
import hashlib
import io
import struct

import numpy as np
import pytest

from tidegraph.llm import media, mixing, warc


def test_netpbm_depths():
    assert media.decode_image(b"P2 2 1 4\n0 4").tolist() == [[0, 255]]
    assert media.decode_image(b"P5 2 1 127\n" + bytes([0, 127])).tolist() == [[0, 255]]
    with pytest.raises(ValueError, match="over"):
        media.decode_image(b"P2 1 1 255\n999999999999")


def test_bmp_fields():
    head = b"BM" + struct.pack("<IHHI", 0, 0, 0, 66) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 32, 3, 4, 0, 0, 0, 0)
    pixel = bytes([1, 2, 3, 0])
    assert media.decode_image(head + struct.pack("<III", 0xFF0000, 0xFF00, 0xFF) + pixel).tolist() == [[[3, 2, 1]]]
    with pytest.raises(ValueError, match="fields"):
        media.decode_image(head + struct.pack("<III", 0xFF, 0xFF00, 0xFF0000) + pixel)


def test_features_and_tiles(spark):
    pgm = media.encode_pgm(bytes(range(256)) * 9, 48)
    rows = [(1, pgm, "x"), (1, pgm, "x"), (2, b"P2 1 1 9\n99", "x"), (3, None, "x"), (4, b"", "x"), (None, b"BM", "x")]
    table = spark.createDataFrame(rows, "k long, media binary, tile string")
    got = media.media_features(table, ["k"]).collect()
    assert len(got) == 6 and sum(r.error is None for r in got) == 2
    one = next(r for r in got if r.k == 1)
    image = media.decode_image(pgm).astype(float)
    assert (one.height, one.width) == image.shape
    want = media.area_resize(image, *media.TILE)
    ys, xs = np.linspace(0, image.shape[0], 9), np.linspace(0, image.shape[1], 10)
    over = lambda a, b, n: np.clip(np.minimum(b, np.arange(n) + 1) - np.maximum(a, np.arange(n)), 0, None)
    brute = [[over(ys[i], ys[i + 1], 48) @ image @ over(xs[j], xs[j + 1], 48) / ((ys[1] - ys[0]) * (xs[1] - xs[0])) for j in range(9)] for i in range(8)]
    assert np.allclose(want, brute)
    assert np.load(io.BytesIO(one.tile)).tolist() == np.rint(want).astype(int).tolist()
    assert media.media_features(table.limit(0), ["k"]).count() == 0
    docs = spark.createDataFrame([(1, "ab", 1), (1, "ab", 1), (2, None, 1)], "doc_id long, text string, media int")
    tiles = media.media_digests(media.payload_images(docs))
    found = media.tile_features(tiles).collect()
    assert len(found) == 3 and len({r.feature for r in found if r.doc_id == 1}) == 1
    for r, t in zip(sorted(found, key=str), sorted(tiles.collect(), key=str), strict=True):
        assert r.feature.startswith(f"{media.difference_hash(np.load(io.BytesIO(t.tile))):016x}")


def record(kind, block, head):
    raw = f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"
    return gzip.compress(raw)


def test_other_archives(spark, tmp_path):
    body = b"hello world"
    chunked = b"5\r\nhello\r\n6;x=y\r\n world\r\n0\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 999\r\n\r\n"
    sha256 = hashlib.sha256(body).hexdigest()
    sha1 = base64.b32encode(hashlib.sha1(http + chunked).digest()).decode()
    good = record("response", http + chunked, f"WARC-Payload-Digest: sha256:{sha256}\r\nWARC-Block-Digest: sha1:{sha1}\r\n")
    odd = record("response", http + body, "WARC-Payload-Digest: blake3:abc\r\n")
    big = record("response", b"HTTP/1.1 200 OK\r\n\r\n" + b"z" * 300_000, "")
    got = list(warc.read_records(io.BytesIO(good + odd + big)))
    assert [r["payload"] for r in got] == [chunked, body, b"z" * 300_000]
    with pytest.raises(ValueError, match="payload digest"):
        list(warc.read_records(record("response", http + body, f"WARC-Payload-Digest: sha256:{'0' * 64}\r\n")))
    with pytest.raises(ValueError, match="no length"):
        list(warc.read_records(gzip.compress(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n")))
    with pytest.raises(ValueError, match="inside"):
        list(warc.read_records(good[:-20]))
    (tmp_path / "a.warc.gz").write_bytes(good + odd)
    (tmp_path / "b.warc").write_bytes(gzip.decompress(big))
    assert warc.read_archives(warc.warc_files(spark, str(tmp_path))).count() == 3


def test_written_mix(spark, tmp_path):
    docs = spark.createDataFrame([(i % 97, f"w{i} " * (i % 13 + 1), f"s{i % 4}", i) for i in range(400)] + [(None, None, None, 0), (1000, "a", None, 1), (1000, "a", None, 1)], "doc_id long, text string, source string, shard int")
    mix = mixing.mix_sources(docs, docs_per_block=4, blocks_per_shard=8).cache()
    mixing.write_mix(docs, mix, str(tmp_path / "mix"))
    out = spark.read.parquet(str(tmp_path / "mix"))
    assert set(out.columns) == {*docs.columns, "mix_shard", "mix_pass"} and out.select("mix_shard").distinct().count() > 5
    target = {r.source: r.target for r in mix.select("source", "target").distinct().collect()}
    words = {r.source: r.n for r in out.groupBy("source").agg({"text": "count"}).withColumnRenamed("count(text)", "n").collect()}
    took = {}
    for r in out.collect():
        took[r.source] = took.get(r.source, 0) + len(r.text.split())
    assert all(abs(took.get(s, 0) - t) <= 14 for s, t in target.items() if s), (took, target, words)
    # the tree deals each source's blocks over the shards: every shard draws of every large source, and sums are the quotas
    drawn = {}
    for r in mix.collect():
        for d in r.draws:
            if d["words"]:
                drawn.setdefault(r.source, {}).setdefault(d["shard"], 0)
                drawn[r.source][d["shard"]] += d["words"]
    assert all(sum(drawn[s].values()) == int(target[s]) for s in drawn) and all(len(drawn[f"s{i}"]) > 4 for i in range(4))
    with pytest.raises(ValueError, match="taken"):
        mixing.mixed_rows(docs.withColumnRenamed("shard", "mix_shard"), mix)


def test_tree_of_quotas(spark):
    """Sums over shards are the quotas; a shard has its share of the blocks; one source's count has the mean and variance of the law."""
    quotas, shards = [70, 20, 10], 10
    counts = []
    for seed in range(40):
        root = spark.createDataFrame([(quotas,)], "counts array<bigint>")
        rows = sorted(mixing.split_quotas(root, shards, 100, seed).collect(), key=lambda r: r.shard)
        assert [sum(r.counts[i] for r in rows) for i in range(3)] == quotas and all(sum(r.counts) == 10 for r in rows)
        counts += [r.counts[0] for r in rows]
    assert abs(np.mean(counts) - 7) < 1e-9 and abs(np.var(counts) - 10 * 0.7 * 0.3 * 90 / 99) < 0.5
