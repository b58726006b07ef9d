"""Each opN query against a brute-force version, on given rows and on rows with nulls, ties, repeats and odd texts."""

import base64
import collections
import hashlib
import itertools
import os
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from tidegraph.llm import queries as Q

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n\n", "a", "a b", "A B", "cc by cc  BY\ncc-by all rights reserved, General Public License", "</s><0x0A>▁▁ x␛1", "日本語 テスト 😀\r\nİı ß", "0 1 2 3", "word " * 30000, "x" * 200000, "a b", "a b"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10_000 + i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "src0", 0, i, "extra") for i, t in enumerate(ODD)]
    odd.append((3, "repeated id with another text", "en", "src1", 0, 1, "extra"))
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, size int, h string")
    docs.unionByName(more, allowMissingColumns=True).write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    conv = spark.createDataFrame([(900, 0, "user", None, 1), (900, 1, "assistant", "", 1), (900, 1, "assistant", "[INST]<|end|>␛0<<SYS>>[[INST]<</s>", 1), (901, 0, None, "x<", 1), (901, 1, "assistant", "|turn|>", 1)], "conv_id long, turn long, role string, text string, start int")
    spark.read.parquet(f"{SF}/conversations.parquet").unionByName(conv, allowMissingColumns=True).write.parquet(f"{d}/conversations.parquet")
    pages = spark.createDataFrame([(5000, "u\r\n1", "same", 1), (5001, None, "same", 1), (4999, "u", "same", 1), (5002, "u", None, 1), (5003, "u", "", 1), (5004, "u", "é" * 300000, 1)], "page_id long, url string, html string, key int")
    spark.read.parquet(f"{SF}/pages.parquet").unionByName(pages, allowMissingColumns=True).write.parquet(f"{d}/pages.parquet")
    emb = [(1000 + i, v, 0, 1) for i, v in enumerate([None, [], [None] + [0.1] * 63, [float("nan")] * 64, [float("inf")] * 64, [0.5, 1.0], [0.5, 1.0], [-0.5, 2.0]])]
    emb += [(1050, [0.1] * 64, 0, 1), (1051, [0.1] * 64, 0, 1), (1052, [0.1] * 64, 0, 1), (1100, [0.0] * 64, 0, 1), (1150, [0.1, -0.2], 0, 1)]
    emb = spark.createDataFrame(emb, "vec_id long, embedding array<float>, label int, v int")
    spark.read.parquet(f"{SF}/embeddings.parquet").unionByName(emb, allowMissingColumns=True).write.parquet(f"{d}/embeddings.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("none")
    for t in os.listdir(SF):
        spark.read.parquet(f"{SF}/{t}").limit(0).write.parquet(f"{d}/{t}")
    return str(d)


def rows(sf, table):
    return pq.read_table(f"{sf}/{table}.parquet").to_pylist()


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("name", [q for q in Q.QUERIES if q != "pipeline"])
def test_empty(spark, empty, name):
    got = Q.QUERIES[name](spark, empty).collect()
    assert len(got) == (1 if name.startswith("op4") else 0)


def test_mix(spark, sf):
    got = Q.op1_mix_sources(spark, sf).collect()
    docs = rows(sf, "documents")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((d["doc_id"], size(d["text"])) for d in docs) == collections.Counter((r.doc_id, r.size) for r in got)
    total = collections.Counter()
    for d in docs:
        total[d["source"]] += size(d["text"])
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(total.values())
    while open_ and left > 1e-9:  # deal, stop at twice the size, deal the excess again
        deal, left, w = left, 0.0, sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += deal * weight[s] / w
            if target[s] >= 2 * total[s]:
                left += target[s] - 2 * total[s]
                target[s] = 2.0 * total[s]
                open_.discard(s)
    by = {(d["doc_id"], size(d["text"])): d["source"] for d in docs}
    taken = collections.Counter()
    for r in got:
        s = by[r.doc_id, r.size]
        assert r.source_size == total[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(tuple, got)) == sorted(map(tuple, Q.op1_mix_sources(spark, sf).collect()))


def brute_fingerprint(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {n: find(n) for n in nodes}


def test_simhash(spark, sf):
    docs = rows(sf, "documents")
    fps = [(d["doc_id"], brute_fingerprint(d["text"], 3)) for d in docs]
    comp = brute_components(sorted({f for _, f in fps}), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, f in fps:
        least[comp[f]] = min(i, least.get(comp[f], i))
    want = sorted((i, f"{f:016x}", least[comp[f]]) for i, f in fps)
    assert want == sorted((r.doc_id, r.fingerprint, r.component_id) for r in Q.op2_simhash_components(spark, sf).collect())


def test_pieces(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_file())
    want = []
    for d in rows(sf, "documents"):
        ids = sp.encode(d["text"] or "")
        want.append((d["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(want) == sorted(tuple(r)[:4] for r in Q.op3_piece_codec(spark, sf).collect())


def test_chat(spark, sf):
    conv = collections.defaultdict(list)
    for r in rows(sf, "conversations"):
        conv[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    conv[-1] = [(0, "user", Q.PROBE), (1, "assistant", Q.PROBE)]
    want = {}
    for c, t in conv.items():
        t.sort()
        said = "".join(x for _, r, x in t if r == "assistant")
        want[c] = (len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in t).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    got = {r.conv_id: tuple(r)[1:5] for r in Q.op4_chat_format(spark, sf).collect()}
    assert got == want


def test_media(spark, sf):
    want = []
    for d in rows(sf, "documents"):
        raw = (d["text"] or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want.append((d["doc_id"], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted(want) == sorted(tuple(r)[:5] for r in Q.op5_media_payloads(spark, sf).collect())


def test_warc(spark, sf):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in rows(sf, "pages")]
    least = {}
    for i, h in pages:
        least[h] = min(i, least.get(h, i))
    want = [(i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if least[h] == i else "revisit", None if least[h] == i else least[h]) for i, h in pages]
    assert sorted(want, key=key) == sorted(map(tuple, Q.op6_warc_roundtrip(spark, sf).collect()), key=key)


def test_licenses(spark, sf):
    want = []
    for d in rows(sf, "documents"):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or ""))
        at = [(i, lab) for lab, p in (("cc-by", ["cc", "by"]), ("gpl", ["general", "public", "license"]), ("reserved", ["all", "rights", "reserved"])) for i in range(len(w)) if w[i : i + len(p)] == p]
        want.append((d["doc_id"], len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    got = Q.op7_license_scan(spark, sf).collect()
    assert sorted(want, key=key) == sorted((tuple(r)[:6] for r in got), key=key)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)


def test_topk(spark, sf):
    vecs = [(r["vec_id"], np.floor(np.array(r["embedding"], float) * 256).astype(np.int64)) for r in rows(sf, "embeddings") if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    want = []
    for i, v in vecs:
        if i % 50 == 0:
            best = sorted((-int(v @ u), j) for j, u in vecs if j != i and len(u) == len(v))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(want) == sorted(map(tuple, Q.op8_exact_topk(spark, sf).collect()))


def test_language(spark, sf):
    docs = {(d["doc_id"], d["text"]): d for d in rows(sf, "documents")}
    got = Q.op9_language_id(spark, sf).collect()
    assert len(got) == len(rows(sf, "documents"))
    by = {d["doc_id"]: d for d in docs.values() if d["doc_id"] < 10_000 and d["doc_id"] != 3}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if r.doc_id >= 10_000:
            text = ODD[r.doc_id - 10_000]
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    apart = [r for r in got if r.held_out and r.doc_id in by]
    assert sum(r.lang_pred == by[r.doc_id]["lang"] for r in apart) >= 0.97 * len(apart)


def test_quality(spark):
    got = {r.doc_id: r for r in Q.op10_line_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["quality"] for r in rows("/root/testdata/sf0.01", "labels")}
    apart = [i for i in labels if got[i].held_out]
    assert len(apart) > 30 and sum(got[i].predicted == labels[i] for i in apart) >= 0.93 * len(apart)


def test_quality_odd(spark, sf):
    got = Q.op10_line_quality(spark, sf).collect()
    assert len(got) == len(rows(sf, "documents")) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
