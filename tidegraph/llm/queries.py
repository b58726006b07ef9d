"""The queries opN_<name> over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import chat, exponion, langid, licenses, media, minhash, mixing, piecewise, quality, simhash, topk, warc
from tidegraph.llm.common import load, staged

MODEL = "piece_bpe_32k.model"


def tokenizer_file(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra column: the draws as pass:shard:words."""
    mix = mixing.mix_sources(load(spark, sf_dir, "documents"))
    draws = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["pass"].cast("string"), d["shard"].cast("string"), d["words"].cast("string"))), ",")
    return mix.select("doc_id", "size", "source_size", "target", "taken", draws.alias("draws"))


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(load(spark, sf_dir, "documents"), words=3, max_bits=2)


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.encode_digests(load(spark, sf_dir, "documents"), tokenizer_file())


PROBE = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql(f"select * from values (-1L, 0L, 'user', '{PROBE}'), (-1L, 1L, 'assistant', '{PROBE}') as t(conv_id, turn, role, text)")
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    read = chat.parse_chats(chat.format_chats(turns))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op5_media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media are stored as a table and read back, and so are their NPY tiles."""
    stored = staged(media.payload_images(load(spark, sf_dir, "documents")), "media")
    return media.tile_features(staged(media.media_digests(stored), "tiles"))


def op6_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(load(spark, sf_dir, "pages"))
    return warc.read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(load(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return langid.predict_languages(docs, langid.fit_language_model(docs))


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality_model(docs, load(spark, sf_dir, "labels")))


def op11_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(load(spark, sf_dir, "documents"), words=5, similarity=0.85)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.vector_codes(load(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.vector_clusters(load(spark, sf_dir, "embeddings"), k=8, rounds=10, scale=1024, dims=64)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's columns that SQL can state too: sizes, and the targets, in thousandths of a word."""
    return op1_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round(F.col("target") * 1000).cast("long").alias("target_milli"))


def media_payload_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's columns of the payload that SQL can state too."""
    return op5_media_payloads(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def license_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's columns of its base, which SQL can state too."""
    return op7_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_simhash_components, op3_piece_codec, op4_chat_format, op5_media_payloads, op6_warc_roundtrip, op7_license_scan, op8_exact_topk, op9_language_id, op10_line_quality, op11_minhash_components, op12_vector_codes, op13_centroid_clusters, pipeline, mix_targets, media_payload_columns, license_base_columns)
}


def _means(name: str, members: str, entries: str, keys: str) -> str:
    """CTE `name` (keys, c): the floored mean of the members of each entry, or the entry itself where it has none."""
    on = " AND ".join(f"e.{k} = m.{k}" for k in keys.split(", "))
    floored = "(s - ((s % n) + n) % n) // n"
    return f"""{name} AS MATERIALIZED (
            SELECT {", ".join(f"e.{k}" for k in keys.split(", "))}, coalesce(m.c, e.c) AS c FROM {entries} e LEFT JOIN (
                SELECT {keys}, list(CAST({floored} AS BIGINT) ORDER BY i) AS c FROM (
                    SELECT {keys}, i, sum(x) AS s, count(*) AS n FROM (SELECT {keys}, generate_subscripts(x, 1) AS i, unnest(x) AS x FROM {members}) GROUP BY ALL
                ) GROUP BY {keys}) m ON {on})"""


def _codes_sql(rounds: int = 2) -> str:
    """op12 by comparing every part with every entry, round after round."""
    fine = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0 AND len(embedding) % 16 = 0"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
            SELECT n, vec_id, label, p, x, (b).e AS e, (b).d AS d FROM (
                SELECT q.n, q.vec_id, q.label, q.p, q.x, min({{'d': CAST(list_sum(list_transform(list_zip(q.x, k.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'e': k.e}}) AS b
                FROM q JOIN b{r} k USING (p) GROUP BY ALL))""")
        if r < rounds:
            steps.append(_means(f"b{r + 1}", f"a{r}", f"b{r}", "p, e"))
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE {fine}
        ), q AS MATERIALIZED (
            SELECT n, vec_id, label, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS x FROM v, (SELECT unnest(range(16)) AS p)
            WHERE len(v) = (SELECT len(v) FROM v WHERE n = 0)
        ), b0 AS MATERIALIZED (SELECT p, n AS e, x AS c FROM q WHERE n < 64),
        {", ".join(steps)},
        digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b{rounds}),
        r AS (SELECT n, vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY n, vec_id, label)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM digest) AS codebooks_sha256 FROM r"""


def _clusters_sql(rounds: int = 10) -> str:
    """op13 by comparing every vector with every centroid, round after round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
            SELECT n, vec_id, x, (b).e AS e, (b).d AS d FROM (
                SELECT q.n, q.vec_id, q.x, min({{'d': CAST(list_sum(list_transform(list_zip(q.x, k.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'e': k.e}}) AS b
                FROM q CROSS JOIN b{r} k GROUP BY ALL))""")
        if r < rounds:
            steps.append(_means(f"b{r + 1}", f"a{r}", f"b{r}", "e"))
    return f"""
        WITH q AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, embedding) - 1 AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), b0 AS MATERIALIZED (SELECT n AS e, x AS c FROM q WHERE n < 8 AND vec_id IS NOT NULL),
        {", ".join(steps)}
        SELECT vec_id, CAST(a{rounds}.e AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.e) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(b{rounds}.c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN b{rounds} ON a{rounds}.e = b{rounds}.e"""


#: DuckDB SQL, over whole tables. What a fitted model, XXH64 or a tokenizer decides is held against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op4_chat_format": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), sized AS (
            SELECT *, list_sum(list_transform([role, text], lambda x: length(x) + length(x) - length(replace(x, '␛', ''))
                + 2 * len(list_filter(range(1, length(x) + 1), lambda i: regexp_matches(substr(x, i, 12), '(?i)^[<\[](\||/?s>|/?INST\]|<?/?SYS>>|/?(image|audio|document):)')))))
                + 8 + 8 + 7 AS chars
            FROM rows
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op6_warc_roundtrip": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS payload_bytes, CAST(CAST(unhex(sha1(payload)) AS BIT) AS VARCHAR) AS bits, min(page_id) OVER (PARTITION BY payload) AS least FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
            list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
                + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
                + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
            CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
        FROM d""",
    "op8_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "mix_targets": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS nth FROM d GROUP BY source),
        w AS (SELECT *, [3.0, 1.0, 2.0][nth % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
        -- the level at which sources up to one, in order of most / weight, are full and the others share the rest by weight
        l AS (SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        f AS (SELECT min_by(level, (most / weight, nth)) AS level FROM l WHERE level <= most / weight)
        SELECT doc_id, size, source_size, CAST(round(1000 * least(most, coalesce(f.level * weight, most))) AS BIGINT) AS target_milli
        FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source CROSS JOIN f""",
    "media_payload_columns": r"""
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
        p AS (SELECT doc_id, octet_length(raw) AS n, greatest(1, (octet_length(raw) + 575) // 576) * 576 AS size, raw FROM d)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(size AS BIGINT) AS payload_bytes, sha256(raw || repeat('\xFF'::BLOB, size - n)) AS payload_sha256 FROM p""",
    "license_base_columns": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        m AS (SELECT doc_id, words, list_filter(range(1, len(words) + 1), lambda i: words[i] = 'cc' AND words[i + 1] = 'by') AS cc,
            list_filter(range(1, len(words) + 1), lambda i: words[i] = 'general' AND words[i + 1] = 'public' AND words[i + 2] = 'license') AS gpl,
            list_filter(range(1, len(words) + 1), lambda i: words[i] = 'all' AND words[i + 1] = 'rights' AND words[i + 2] = 'reserved') AS res FROM w)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(cc) + len(gpl) + len(res) AS BIGINT) AS n_base,
            CAST(list_min(cc || gpl || res) - 1 AS BIGINT) AS first_word, CAST(list_max(cc || gpl || res) - 1 AS BIGINT) AS last_word,
            concat_ws(',', CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(res) > 0 THEN 'reserved' END) AS base_labels
        FROM m""",
    "op11_minhash_components": r"""
        WITH RECURSIVE w AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS MATERIALIZED (SELECT n, doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END) AS g FROM w),
        c AS MATERIALIZED (SELECT min(doc_id) AS id, g, len(g) AS size FROM g WHERE len(g) > 0 GROUP BY g),
        u AS MATERIALIZED (SELECT id, size, unnest(g) AS s FROM c),
        l AS MATERIALIZED (
            SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.s = b.s AND a.id < b.id AND 100 * least(a.size, b.size) >= 85 * greatest(a.size, b.size)
            GROUP BY a.id, b.id, a.size, b.size HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))),
        e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(id, least) AS (SELECT id, id FROM c UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.id),
        m AS (SELECT id, min(least) AS component FROM r GROUP BY id)
        SELECT doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
        FROM g LEFT JOIN c ON c.g = g.g LEFT JOIN m ON m.id = c.id""",
    "op12_vector_codes": _codes_sql(),
    "op13_centroid_clusters": _clusters_sql(),
}
