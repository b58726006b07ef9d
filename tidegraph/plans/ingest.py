"""The article gate over documents, with its SQL (near-duplicates aside, which tests hold against brute force)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.operators import gate
from tidegraph.operators import pages as P
from tidegraph.plans.catalogue import BARE, WORDS, query

NOW = "2024-05-06 07:08:09"


@query(rf"""with a as (select doc_id, text, case when doc_id % 5 <> 0 then cast(doc_id as varchar) end as id, 'http://x/' || doc_id as url, case doc_id % 9 when 0 then 'error' when 1 then null else 'ok' end as status,
    case when doc_id % 4 <> 0 then cast(date '2024-01-01' + cast(doc_id % 90 as int) as varchar) when doc_id % 8 <> 0 then '2023-02-03' else '{NOW[:10]}' end as day from documents),
  g as (select *, sha256({BARE}) as h, row_number() over (partition by sha256({BARE}) order by doc_id) as rn from a where (status = 'ok' or status is null) and {WORDS} >= 80),
  k as (select *, coalesce(id, md5(url || '::' || day)) as article_id from g where rn = 1)
  select doc_id, article_id, substr(h, 1, 16) as content_hash, day, substr(day, 1, 7) as period_key from k where article_id not in (select cast(vec_id as varchar) from embeddings where label = 0)""")
def article_gate(t):
    """Status, length, equal texts, time fallbacks, keys, known articles."""
    d = F.col("doc_id")
    rows = t.documents.select(
        "doc_id", d.alias("ord"), F.when(d % 5 != 0, d.cast("string")).alias("article_id"), F.concat(F.lit("http://x/"), d.cast("string")).alias("url"), F.when(d % 9 == 0, "error").when(d % 9 != 1, "ok").alias("status"), "text",
        F.when(d % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(d, F.lit(90)).cast("int")).cast("string")).alias("published"), F.when(d % 8 != 0, "2023-02-03T04:05:06").alias("scraped_at"),
    )
    skip = t.embeddings.where("label = 0").select(F.col("vec_id").alias("article_id"))
    out = gate.article_gate(rows, F.lit(NOW), skip, near=False)
    return out.select("doc_id", "article_id", "content_hash", F.date_format("published_ts", "yyyy-MM-dd").alias("day"), "period_key")


_PLAIN = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query(rf"""select page_id, sha256(regexp_replace({_PLAIN.format("regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', '', 'g')")}, '[\s]+', '', 'g')) as text,
  trim(regexp_replace({_PLAIN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '\s+', ' ', 'g')) as title from pages""")
def page_content(t):
    """The main text of every page, white space aside, and its title: no navigation, advertisement, script or footer."""
    c = P.main_content(t.pages)
    return c.select("page_id", F.sha2(F.regexp_replace("text", r"\s+", "").cast("binary"), 256).alias("text"), "title")
