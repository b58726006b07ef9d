"""Every registered query of the engine, with the SQL that states the same result.

The given tables stand in for the domain: orders are macro events (and their chunks), lineitem mentions and impacts,
events the processing audit, documents articles, embeddings chunk vectors, conversations turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.functions import temporal as D
from tidegraph.functions import text as X
from tidegraph.functions import vectors as V
from tidegraph.operators import core as C
from tidegraph.operators import nlp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def mentions(self) -> DataFrame:
        return self.lineitem.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id"))

    @property
    def impacts(self) -> DataFrame:
        return self.lineitem.select(F.col("l_orderkey").alias("event_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("impact_id"), F.col("l_returnflag").alias("target_type"), F.col("l_suppkey").alias("target_id"))

    @property
    def macro_events(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("event_type"), F.col("o_custkey").alias("article_id"), F.col("o_totalprice").alias("confidence"), F.col("o_orderdate").cast("date").alias("published"))

    @property
    def articles(self) -> DataFrame:
        return self.documents.select("doc_id", "text", "source", "lang", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(90)).cast("int")).alias("published"))

    @property
    def audit(self) -> DataFrame:
        return self.events.select("event_id", F.col("user_id").alias("chunk_id"), F.col("event_type").alias("status"), "value", F.col("ts").alias("created_at"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


M = "(select distinct l_orderkey as c, l_partkey as e from lineitem)"
ART = "(select doc_id, text, source, lang, date '2024-01-01' + cast(doc_id % 90 as int) as published from documents)"


@query(f"""select e as entity_id, count(distinct i) as impact_links, count(distinct o) as event_count from (
  select m.e, o.o_orderkey as o, l.l_orderkey * 10 + l.l_linenumber as i from {M} m join orders o on o.o_orderkey = m.c join lineitem l on l.l_orderkey = o.o_orderkey)
  group by e order by impact_links desc, event_count desc, e limit 20""")
def impact_leaderboard(t):
    return C.impact_leaderboard(t.mentions, t.macro_events, t.impacts)


@query("""select o_orderkey as event_id, o_orderpriority as event_type, o_totalprice as confidence, c_name as owner from orders left join customer on o_custkey = c_custkey
  where coalesce(o_totalprice, 0) >= 1000 order by o_totalprice desc nulls last, o_orderdate desc, o_orderkey limit 25""")
def latest_events_floor(t):
    c = t.customer.select("c_custkey", F.col("c_name").alias("owner"))
    e = t.macro_events.where(F.coalesce("confidence", F.lit(0.0)) >= 1000)
    return e.join(c, F.col("article_id") == F.col("c_custkey"), "left").orderBy(F.desc_nulls_last("confidence"), F.desc("published"), "event_id").limit(25).select("event_id", "event_type", "confidence", "owner")


@query("""select o_orderkey as event_id, count(l_orderkey) as children, coalesce(string_agg(cast(l_suppkey as varchar), ',' order by l_linenumber, l_suppkey), '') as suppliers
  from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey""")
def event_evidence_nested(t):
    kids = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("k"))
    e = t.orders.join(kids, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return e.select(F.col("o_orderkey").alias("event_id"), F.coalesce(F.size("k"), F.lit(0)).cast("long").alias("children"), F.coalesce(F.array_join(F.transform("k", lambda x: x["l_suppkey"].cast("string")), ","), F.lit("")).alias("suppliers"))


@query("""select event_id, event_type as status, value from events where value > 50 or event_type in ('error', 'signup') order by ts desc, event_id limit 50""")
def questionable_audit(t):
    return t.audit.where((F.col("value") > 50) | F.col("status").isin("error", "signup")).orderBy(F.desc("created_at"), "event_id").limit(50).select("event_id", "status", "value")


@query(f"""with m as {M} select e as entity_id, count(*) as shared from m where e <> 1 and c in (select c from m where e = 1) group by e order by shared desc, e limit 3""")
def cooccurrence_neighbors(t):
    return C.neighbours(t.mentions, 1)


@query(f"""with m as {M}, s as (select c from m group by c having count(*) <= 10)
  select x.e as a, y.e as b, min(x.c) as chunk_id, count(*) as n from m x join m y on x.c = y.c and x.e < y.e where x.c in (select c from s) group by 1, 2""")
def cooccurrence_edges(t):
    return C.cooccurring(t.mentions, 10).groupBy("a", "b").agg(F.min("chunk_id").alias("chunk_id"), F.count("*").alias("n"))


@query("select distinct o_orderkey as event_id, l_partkey as entity_id from orders join lineitem on o_orderkey = l_orderkey")
def involves_edges(t):
    return t.macro_events.join(t.mentions, "chunk_id").select("event_id", "entity_id").distinct()


@query("select c_nationkey as k, max(nullif(c_name, '')) as c_name, max(nullif(c_mktsegment, '')) as c_mktsegment from customer group by 1")
def entity_rollup(t):
    return C.rollup_best(t.customer.withColumnRenamed("c_nationkey", "k"), "k", ["c_name", "c_mktsegment"])


@query("select l_orderkey as event_id, string_agg(l_returnflag, ',' order by l_returnflag) as shocks from lineitem group by 1")
def shock_list_per_event(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.array_join(F.array_sort(F.collect_list("l_returnflag")), ",").alias("shocks"))


@query("select l_orderkey as event_id, min(l_linenumber * 1000000 + l_suppkey) as first_evidence from lineitem group by 1")
def first_evidence(t):
    best = t.lineitem.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.min(F.struct("l_linenumber", "l_suppkey")).alias("f"))
    return best.select("event_id", (F.col("f.l_linenumber").cast("long") * 1000000 + F.col("f.l_suppkey")).alias("first_evidence"))


@query("select distinct lower(trim(l_returnflag)) || ':' || trim(cast(l_suppkey as varchar)) as asset_key, l_returnflag as target_type, l_suppkey as target_id from lineitem")
def asset_nodes(t):
    return t.impacts.select(F.concat(F.lower(F.trim("target_type")), F.lit(":"), F.trim(F.col("target_id").cast("string"))).alias("asset_key"), "target_type", "target_id").distinct()


@query("""select 'entity' as kind, count(distinct l_partkey) as n from lineitem union all select 'event', count(*) from orders
  union all select 'asset', count(*) from (select distinct l_returnflag, l_suppkey from lineitem) union all select 'involves', count(*) from (select distinct l_orderkey, l_partkey from lineitem)""")
def graph_counts(t):
    one = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one("entity", t.mentions.select("entity_id").distinct()).union(one("event", t.macro_events)).union(one("asset", t.impacts.select("target_type", "target_id").distinct())).union(one("involves", t.mentions.distinct()))


@query("select c_custkey as chunk_id from customer where not exists (select 1 from events where user_id = c_custkey)")
def unprocessed_antijoin(t):
    return C.unprocessed(t.customer.select(F.col("c_custkey").alias("chunk_id")), t.audit)


@query("select c_custkey as chunk_id from customer where not exists (select 1 from events where user_id = c_custkey and event_type = 'purchase' and value > 80)")
def failed_only_antijoin(t):
    return C.unprocessed(t.customer.select(F.col("c_custkey").alias("chunk_id")), t.audit.withColumn("success", (F.col("status") == "purchase") & (F.col("value") > 80)), only_failed=True)


@query("""select 'line' as link, (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')) as orphans
  union all select 'order', (select count(*) from orders where o_orderkey not in (select l_orderkey from lineitem))""")
def orphan_counts(t):
    a = t.lineitem.join(t.orders.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("orphans")).select(F.lit("line").alias("link"), "orphans")
    b = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("orphans")).select(F.lit("order").alias("link"), "orphans")
    return a.union(b)


@query("select user_id as chunk_id, max(ts) as newest from events where event_type = 'error' group by 1 order by newest desc, chunk_id limit 20")
def retry_queue_distinct(t):
    return t.audit.where("status = 'error'").groupBy("chunk_id").agg(F.max("created_at").alias("newest")).orderBy(F.desc("newest"), "chunk_id").limit(20)


@query("select user_id as chunk_id, event_id, event_type as status from (select *, row_number() over (partition by user_id order by ts desc, event_id) as rn from events) where rn = 1")
def latest_run_per_chunk(t):
    return C.top_per_key(t.audit, ["chunk_id"], [F.desc("created_at"), F.col("event_id")]).select("chunk_id", "event_id", "status")


@query("select event_type as status, cast(props->>'$.k' as int) as k, count(*) as n from events where event_type in ('error', 'click') group by 1, 2 order by n desc, status, k limit 40")
def enum_report(t):
    return t.audit.where(F.col("status").isin("error", "click")).groupBy("status", "k").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status", "k").limit(40)


@query("""select coalesce(a.c_custkey, b.c_custkey) as c_custkey, coalesce(b.c_name, a.c_name) as c_name, coalesce(b.c_acctbal, a.c_acctbal) as c_acctbal
  from (select * from customer where c_custkey % 3 <> 0) a full join (select c_custkey, upper(c_name) as c_name, case when c_custkey % 2 = 0 then c_acctbal * 2 end as c_acctbal from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0) b on a.c_custkey = b.c_custkey""")
def merge_upsert(t):
    old = t.customer.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", "c_acctbal")
    new = t.customer.where("c_custkey % 2 = 0 or c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") * 2).alias("c_acctbal"))
    return C.merge_upsert(old, new, "c_custkey", ["c_name", "c_acctbal"])


@query("""select l_orderkey as k, l_suppkey as v from (select l_orderkey, l_suppkey, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey) as rn from lineitem) x
  where rn = 1 and l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'O') union all select o_orderkey, o_custkey from orders where o_orderstatus = 'O'""")
def insert_or_ignore(t):
    have = t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"), F.lit(0).alias("n"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("v"), F.col("l_linenumber").alias("n"))
    return C.insert_or_ignore(have, rows, "k", [F.col("n"), F.col("v")]).select("k", "v")


BARE = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
WORDS = r"len(regexp_extract_all(text, '[^ \t\n\r\f\v]+'))"


@query(rf"""select doc_id, substr(sha256({BARE}), 1, 16) as content_hash, strftime(published, '%Y-%m') as period_key from (
  select *, row_number() over (partition by sha256({BARE}) order by doc_id) as rn from {ART} where {WORDS} >= 80) where rn = 1""")
def quality_gate(t):
    a = t.articles.where(X.word_count(F.col("text")) >= 80).withColumn("content_hash", X.content_hash(F.col("text")))
    return C.top_per_key(a, ["content_hash"], [F.col("doc_id")]).select("doc_id", "content_hash", D.period_key(F.col("published")).alias("period_key"))


@query(rf"select substr(sha256({BARE}), 1, 16) as content_hash, min(doc_id) as doc_id, count(*) as copies from documents group by 1")
def exact_dedup(t):
    return t.documents.groupBy(X.content_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(r"""select page_id, length(s) as n_chars, sha256(s) as h from (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as s from pages)""")
def html_text_strip(t):
    return t.pages.select("page_id", X.strip_html(F.col("html")).alias("s")).select("page_id", F.char_length("s").cast("long").alias("n_chars"), F.sha2(F.col("s").cast("binary"), 256).alias("h"))


_MARKS = " + ".join(f"len(regexp_extract_all(s, '{m}'))" for m in X.NAVIGATION_MARKERS)


@query(rf"""with p as (select page_id, url, lower(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) as s from pages),
  w as (select *, list_filter(string_split(s, ' '), lambda x: x <> '') as words, {_MARKS} as marks from p)
  select page_id, len(words) < 80 or marks / greatest(len(words), 1) > 0.08 or len(list_distinct(words)) / greatest(len(words), 1) < 0.35 or coalesce(contains(lower(url), '/videos/'), false) as boilerplate from w""")
def boilerplate_gate(t):
    return t.pages.select("page_id", "url", X.strip_html(F.col("html")).alias("s")).select("page_id", X.is_boilerplate(F.col("s"), F.col("url")).alias("boilerplate"))


@query(rf"select doc_id, cast(trunc({WORDS} / 0.75) as int) as tokens from documents")
def approx_tokens(t):
    return t.documents.select("doc_id", X.approx_tokens(F.col("text")).alias("tokens"))


TERMS = (("the", "and"), ("in", "of"), ("ou", "with"))


@query("""select doc_id, cast(2 * (contains(l, 'the')::int + contains(l, 'and')::int) + contains(l, 'in')::int + contains(l, 'of')::int - 2 * (contains(l, 'ou')::int + contains(l, 'with')::int) as int) as score
  from (select doc_id, lower(text) as l from documents)""")
def term_score(t):
    return t.documents.select("doc_id", X.macro_score(F.col("text"), *TERMS).alias("score"))


@query(r"""select doc_id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')), ['the', 'and', 'tion'])) / 3.0, 6) as overlap from documents -- 'with' is a stop word""")
def keyword_overlap(t):
    return t.documents.select("doc_id", F.round(X.keyword_overlap(F.lit("The and tion with"), F.col("text")), 6).alias("overlap"))


@query(r"""select p_partkey, lower(trim(regexp_replace(regexp_replace(regexp_replace(p_name, '[''`]', '', 'g'), '[^\w\s&-]', ' ', 'g'), '\s+', ' ', 'g'))) as canonical from part""")
def canonical_names(t):
    return t.part.select("p_partkey", X.canonical_name(F.col("p_name")).alias("canonical"))


@query(r"select doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) as n from documents")
def sentence_split(t):
    return t.documents.select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n"))


@query(r"""with recursive s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as parts from documents),
  w as (select doc_id, parts, list_transform(parts, lambda x: cast(trunc(len(regexp_extract_all(x, '\S+')) / 0.75) as int)) as n from s where len(parts) > 0),
  -- before sentence k: from where the open chunk starts, and the chunks closed so far as [start, end]
  g as (select doc_id, 1 as k, 1 as start, cast([] as int[][]) as done from w
    union all
    select g.doc_id, g.k + 1, case when full_ then g.k - tail else g.start end, case when full_ then list_append(g.done, [g.start, g.k - 1]) else g.done end
    from (select g.*, g.k > g.start and list_sum(n[g.start:g.k - 1]) + n[g.k] > 400 as full_,
        len(list_filter(range(1, g.k - g.start + 1), lambda j: list_sum(n[g.k - j:g.k - 1]) <= 50)) as tail from g join w on w.doc_id = g.doc_id where g.k <= len(n)) g),
  e as (select g.doc_id, w.parts, list_append(g.done, [g.start, g.k - 1]) as c from g join w on w.doc_id = g.doc_id where g.k = len(w.n) + 1),
  c as (select doc_id, unnest(range(0, len(c))) as chunk_index, unnest(list_transform(c, lambda x: array_to_string(parts[x[1]:x[2]], ' '))) as chunk from e)
  select doc_id, cast(chunk_index as int) as chunk_index, cast(trunc(len(regexp_split_to_array(chunk, '\s+')) / 0.75) as int) as token_count, sha256(chunk) as h from c""")
def chunk_pack(t):
    return nlp.chunks(t.articles, "doc_id", "text").select("doc_id", "chunk_index", "token_count", F.sha2(F.col("chunk").cast("binary"), 256).alias("h"))


@query(f"select doc_id, strftime(published, '%Y-%m') as m, strftime(published, '%G-W%V') as w, year(published) || '-Q' || quarter(published) as q from {ART}")
def period_keys(t):
    p = F.col("published")
    return t.articles.select("doc_id", D.period_key(p).alias("m"), D.period_key(p, "week").alias("w"), D.period_key(p, "quarter").alias("q"))


@query("""select o_orderkey, strftime(x, '%Y-%m') as period_key from (select o_orderkey, unnest(generate_series(date_trunc('month', o_orderdate), date_trunc('month', o_orderdate + interval 70 day), interval 1 month)) as x from orders)""")
def period_range_expand(t):
    d = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", F.explode(D.period_range(d, F.date_add(d, 70))).alias("period_key"))


COS = "list_cosine_similarity(e.embedding::double[], q.v::double[])"
QV = "(select embedding as v from embeddings where vec_id = 0)"


def _scored(t):
    q = F.broadcast(t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("v")).limit(1))  # one row
    return t.embeddings.where("vec_id <> 0").join(q).withColumn("cos", V.cosine(F.col("embedding"), F.col("v")))


@query(f"select e.vec_id, round({COS}, 6) as score from embeddings e, {QV} q where e.vec_id <> 0 order by {COS} desc, vec_id limit 10")
def vector_topk(t):
    return _scored(t).orderBy(F.desc("cos"), "vec_id").limit(10).select("vec_id", F.round("cos", 6).alias("score"))


@query(f"select e.vec_id, round(0.75 * {COS} + 0.25 * exp(-ln(2) * (e.vec_id % 30) / 5.0), 6) as score from embeddings e, {QV} q where e.vec_id <> 0")
def recency_rank(t):
    return _scored(t).select("vec_id", F.round(0.75 * F.col("cos") + 0.25 * D.recency(F.col("vec_id") % 30, 5.0), 6).alias("score"))


@query(f"select e.vec_id, round(0.70 * {COS} + 0.30 * exp(-(e.vec_id % 30) / 2.0), 6) as score from embeddings e, {QV} q where e.vec_id <> 0")
def summary_rank(t):
    return _scored(t).select("vec_id", F.round(0.70 * F.col("cos") + 0.30 * D.recency_fold(F.col("vec_id") % 30, 2.0), 6).alias("score"))


@query("""with r as (select o_orderkey, o_totalprice as s, row_number() over (order by o_totalprice desc, o_orderkey) as rk from orders order by rk limit 100)
  select o_orderkey, row_number() over (order by (rk > 18), case when rk <= 18 then -(0.15 * s + 0.85 * (o_orderkey % 97)) else rk end, o_orderkey) as pos from r""")
def rerank_head(t):
    top = t.orders.select("o_orderkey", F.col("o_totalprice").alias("s")).orderBy(F.desc("s"), "o_orderkey").limit(100)
    r = top.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("s"), "o_orderkey")))
    head = F.col("rk") <= 18
    return r.select("o_orderkey", F.row_number().over(Window.orderBy(~head, F.when(head, -(0.15 * F.col("s") + 0.85 * (F.col("o_orderkey") % 97))).otherwise(F.col("rk")), "o_orderkey")).cast("long").alias("pos"))


@query("select doc_id, source from (select *, row_number() over (partition by lower(trim(coalesce(source, 'unknown'))) order by n_chars desc, doc_id) as rn from documents) where rn <= 1")
def source_cap(t):
    return C.top_per_key(t.documents.withColumn("s", F.lower(F.trim(F.coalesce("source", F.lit("unknown"))))), ["s"], [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "source")


@query("select o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) where rn <= 2")
def article_cap(t):
    return C.top_per_key(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_orderkey")


@query("""select o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn, max(case when o_orderstatus = 'P' then 1 else 0 end) over (partition by o_custkey) as hard from orders) where rn <= 2 or hard = 1""")
def prefilter_topn_per_article(t):
    by = Window.partitionBy("o_custkey")
    o = t.orders.withColumns({"rn": F.row_number().over(by.orderBy(F.desc("o_totalprice"), "o_orderkey")), "hard": F.max((F.col("o_orderstatus") == "P").cast("int")).over(by)})
    return o.where("rn <= 2 or hard = 1").select("o_orderkey")


@query("select o_orderkey as chunk_id, o_orderdate as published from orders join (select distinct l_orderkey from lineitem where l_partkey = 7) on l_orderkey = o_orderkey order by o_orderdate desc, o_orderkey limit 800")
def entity_chunks(t):
    m = t.lineitem.where("l_partkey = 7").select("l_orderkey")
    return t.orders.join(m, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(800).select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderdate").alias("published"))


@query("select distinct o_orderkey as event_id, o_totalprice as prior, l_returnflag as direction from orders join lineitem on o_orderkey = l_orderkey where l_suppkey = 5 order by o_totalprice desc, o_orderkey, direction limit 24")
def asset_event_chunks(t):
    i = t.lineitem.where("l_suppkey = 5").select("l_orderkey", F.col("l_returnflag").alias("direction")).distinct()
    return t.orders.join(i, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("prior"), "direction").orderBy(F.desc("prior"), "event_id", "direction").limit(24)


@query("""select chunk_id, kind, score from (select *, row_number() over (partition by chunk_id order by score desc, kind) as rn from (
  select l_orderkey as chunk_id, 'entity' as kind, max(l_quantity) as score from lineitem where l_returnflag = 'R' group by 1 union all select l_orderkey, 'asset', max(l_quantity) from lineitem where l_linestatus = 'O' group by 1)) where rn = 1""")
def hybrid_union_best(t):
    part = lambda cond, kind: t.lineitem.where(cond).groupBy(F.col("l_orderkey").alias("chunk_id")).agg(F.max("l_quantity").alias("score")).withColumn("kind", F.lit(kind))
    return C.top_per_key(part("l_returnflag = 'R'", "entity").unionByName(part("l_linestatus = 'O'", "asset")), ["chunk_id"], [F.desc("score"), F.col("kind")])


@query("select conv_id, turn, last_value(case when length(text) % 3 = 0 then length(text) end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as carried from conversations")
def carryover(t):
    c = t.conversations.withColumn("e", F.when(F.char_length("text") % 3 == 0, F.char_length("text").cast("long")))
    return C.carry_forward(c, "conv_id", "turn", "e", "carried").select("conv_id", "turn", "carried")


@query("select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations) where rn <= 3")
def recent_turns(t):
    return C.top_per_key(t.conversations, ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn")


@query("""with b as (select event_type as symbol, cast(ts as date) as bar_date, round(sum(value), 4) as close from events group by 1, 2), n as (select *, row_number() over (partition by symbol order by bar_date desc) as rn from b)
  select symbol, bar_date, round((close / nullif(lag(close) over (partition by symbol order by bar_date), 0) - 1) * 100, 3) as pct from n where rn <= 5""")
def close_returns(t):
    b = t.events.groupBy(F.col("event_type").alias("symbol"), F.col("ts").cast("date").alias("bar_date")).agg(F.round(F.sum("value"), 4).alias("close"))
    return C.close_returns(b).select("symbol", "bar_date", F.round("pct", 3).alias("pct"))


@query("select s_suppkey as ticker, metric, value from (select s_suppkey, s_acctbal as close, cast(s_nationkey as double) as volume from supplier) unpivot (value for metric in (close, volume))")
def panel_unpivot(t):
    wide = t.supplier.select(F.col("s_suppkey").alias("ticker"), F.col("s_acctbal").alias("close"), F.col("s_nationkey").cast("double").alias("volume"))
    return wide.unpivot("ticker", ["close", "volume"], "metric", "value")


@query("""with e as (select l_orderkey as k, list(distinct l_suppkey) as x from lineitem where l_quantity > 20 group by 1), o as (select l_orderkey as k, list(distinct l_suppkey) as y from lineitem where l_discount > 0.04 group by 1)
  select k, len(list_intersect(x, y)) as hits, round(len(list_intersect(x, y)) / len(x), 4) as recall, round(len(list_intersect(x, y)) / len(y), 4) as precision from e join o using (k)""")
def set_recall_precision(t):
    side = lambda cond, c: t.lineitem.where(cond).groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_suppkey").alias(c))
    j = side("l_quantity > 20", "x").join(side("l_discount > 0.04", "y"), "k")
    h, r, p = C.score_set(F.col("x"), F.col("y"))
    return j.select("k", h.cast("long").alias("hits"), r.alias("recall"), p.alias("precision"))


@query()  # SQL over the shingles of long texts is too slow; tests/test_near_dup_keep.py has the brute force
def near_dup_keep(t):
    return nlp.near_dup_keep(t.articles, "doc_id", "text", "published")


@query("select event_type as period, count(distinct user_id) as users, count(*) as n from events group by 1")
def status_histogram(t):
    return t.events.groupBy(F.col("event_type").alias("period")).agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n"))


@query(f"select strftime(published, '%Y-%m') as period_key, source, count(*) as n from {ART} group by 1, 2")
def period_counts(t):
    return t.articles.groupBy(D.period_key(F.col("published")).alias("period_key"), "source").agg(F.count("*").alias("n"))
