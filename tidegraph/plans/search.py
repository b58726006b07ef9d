"""Queries of retrieval, knowledge tables, graph views and question predicates, with their SQL.

Stand-ins: orders are chunks and events, customers their articles (segment as source), lineitem mentions and impacts,
documents texts, embeddings vectors of the documents with their ids, conversations questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions import intents as I
from tidegraph.operators import core as C
from tidegraph.operators import search as S
from tidegraph.plans.catalogue import COS, QV, Tables, query

AS_OF = "2024-04-01"
#: The parameters of the retrieval queries: one entity, one asset, one source.
ENTITY, ASSET, SOURCE = 7, 5, "BUILDING"

CHUNKS = "(select o_orderkey as chunk_id, o_custkey as article_id, cast(o_orderdate as date) as published, strftime(o_orderdate, '%Y-%m') as period_key, o_orderpriority as text, c_mktsegment as source, c_name as title from orders join customer on o_custkey = c_custkey)"
TEXTS = "(select d.doc_id as chunk_id, d.text, d.source, e.embedding, case when d.doc_id % 7 <> 0 then date '2024-01-01' + cast(d.doc_id % 90 as int) end as published from documents d left join embeddings e on e.vec_id = d.doc_id)"


def chunk_rows(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("article_id"), F.col("o_orderdate").cast("date").alias("published"), F.date_format("o_orderdate", "yyyy-MM").alias("period_key"), F.col("o_orderpriority").alias("text"))
    return S.with_articles(o, t.customer.select(F.col("c_custkey").alias("article_id"), F.col("c_mktsegment").alias("source"), F.col("c_name").alias("title")))


def event_rows(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("chunk_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("confidence"), F.date_format("o_orderdate", "yyyy-MM").alias("period_key"))


def text_rows(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("chunk_id"), "text", "source", F.when(F.col("doc_id") % 7 != 0, F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(90)).cast("int"))).alias("published"))
    return d.join(t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")


def query_vector(t: Tables) -> list[float]:
    """The question's vector: one row."""
    row = t.embeddings.where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else []


@query(f"""select chunk_id, title, source, published from {CHUNKS} where published between date '1996-02-01' and date '1998-12-31' and source = '{SOURCE}'
  and period_key in ('1996-03', '1997-05', '1998-07') and chunk_id in (select l_orderkey from lineitem where l_returnflag = 'R')""")
def chunks_by_ids(t):
    ids = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("chunk_id"))
    return S.filter_chunks(chunk_rows(t), ids, "1996-02-01", "1998-12-31", SOURCE, ["1996-03", "1997-05", "1998-07"]).select("chunk_id", "title", "source", "published")


_TOP_EVENTS = """(select o_orderkey as event_id, case when o_orderstatus <> 'P' then o_totalprice end as confidence from orders where o_orderkey in (select l_orderkey from lineitem where {key})
  {periods} order by coalesce(confidence, 0) desc, o_orderkey limit 24)"""


@query(f"""select event_id, chunk_id, coalesce(nullif(confidence, 0), 0.55) as prior, published from {_TOP_EVENTS.format(key=f"l_partkey = {ENTITY}", periods="")} e join {CHUNKS} c on c.chunk_id = e.event_id where published >= date '1996-01-01'""")
def graph_event_chunks(t):
    links = t.lineitem.select(F.col("l_orderkey").alias("event_id"), "l_partkey")
    return S.event_chunks(links, event_rows(t), chunk_rows(t), F.col("l_partkey") == ENTITY, start="1996-01-01").select("event_id", "chunk_id", "prior", "published")


@query(f"""select event_id, chunk_id, coalesce(nullif(confidence, 0), 0.55) as prior, source from {_TOP_EVENTS.format(key=f"l_suppkey = {ASSET}", periods="and strftime(o_orderdate, '%Y') <> '1997' and strftime(o_orderdate, '%Y-%m') in ('1996-01', '1996-02', '1996-03', '1998-01', '1998-02', '1998-03')")} e join {CHUNKS} c on c.chunk_id = e.event_id""")
def graph_asset_chunks(t):
    links = t.lineitem.select(F.col("l_orderkey").alias("event_id"), "l_suppkey")
    periods = ["1996-01", "1996-02", "1996-03", "1998-01", "1998-02", "1998-03"]
    return S.event_chunks(links, event_rows(t), chunk_rows(t), F.col("l_suppkey") == ASSET, periods=periods).select("event_id", "chunk_id", "prior", "source")


@query(f"""with m as (select distinct l_orderkey as c, l_partkey as e from lineitem), n as (select e, count(*) as shared from m where e <> {ENTITY} and c in (select c from m where e = {ENTITY}) group by e order by shared desc, e limit 3)
  select c.chunk_id, m.e as entity_id, c.published from m join {CHUNKS} c on c.chunk_id = m.c where m.e in (select e from n) and c.published <= date '2000-12-31' order by c.published desc, c.chunk_id, m.e limit 4""")
def expansion_chunks(t):
    return S.cooccurrence_chunks(t.mentions, chunk_rows(t), ENTITY, end="2000-12-31").select("chunk_id", "entity_id", "published")


@query(f"select vec_id as event_id, round(s, 6) as score from (select e.vec_id, {COS} as s from (select * from embeddings order by label desc, vec_id limit 600) e, {QV} q) where s > 0.2 order by s desc, vec_id limit 8")
def event_vector_search(t):
    e = t.embeddings.select(F.col("vec_id").alias("event_id"), F.col("label").alias("confidence"), "embedding")
    return S.event_vectors(e, query_vector(t)).select("event_id", F.round("score", 6).alias("score"))


QUESTION = "the river and old house market news"
_OVERLAP = "len(list_intersect(list_distinct(regexp_extract_all(lower(e.text), '[a-z0-9]{3,}')), ['the', 'river', 'and', 'old', 'house', 'market', 'news'])) / 7.0"


@query(f"select e.chunk_id, round(0.85 * {COS} + 0.15 * {_OVERLAP}, 6) as score from {TEXTS} e, {QV} q where e.embedding is not null order by 0.85 * {COS} + 0.15 * {_OVERLAP} desc, e.chunk_id limit 8")
def keyword_vector_search(t):
    return S.semantic_chunks(text_rows(t), QUESTION, query_vector(t)).select("chunk_id", F.round("score", 6).alias("score"))


_AGE = f"greatest(date '{AS_OF}' - e.published, 0)"


@query(f"select e.chunk_id, round(0.75 * case when e.embedding is null then 0.5 else {COS} end + 0.25 * coalesce(exp(-ln(2) * {_AGE} / 5.0), 0.8), 6) as score from {TEXTS} e, {QV} q")
def rank_with_defaults(t):
    rows = text_rows(t).withColumn("semantic_score", F.lit(None).cast("double"))
    return S.rank_rows(rows, S.rank_score(query_vector(t), F.lit(AS_OF).cast("date"))).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"""with p as (select * from {TEXTS} order by published desc nulls last, chunk_id limit 300),
  s as (select e.chunk_id, e.source, 0.7 * case when e.embedding is null then 0.0 else {COS} end + 0.3 * coalesce(exp(-{_AGE} / 2.0), 0.0) as score from p e, {QV} q),
  r as (select *, row_number() over (partition by lower(trim(coalesce(nullif(source, ''), 'unknown'))) order by score desc, chunk_id) as rn from s)
  select chunk_id, round(score, 6) as score, case when rn = 1 then 'summary_diverse_source' else 'summary_recency_semantic' end as kind from r order by r.score desc, chunk_id limit 24""")
def summary_retrieval(t):
    return S.summary_chunks(text_rows(t), query_vector(t), F.lit(AS_OF).cast("date")).select("chunk_id", F.round("score", 6).alias("score"), "kind")


@query("select source, 'S' || row_number() over (order by min(doc_id), source) as label from documents group by source")
def citation_map(t):
    return S.citation_numbers(t.documents, "source", "doc_id").select("source", "label")


@query("""with d as (select lang, doc_id, source, trim(regexp_replace(text, '\\s+', ' ', 'g')) as flat from documents)
  select lang, sha256(string_agg('[' || doc_id || '] ' || coalesce(source, 'unknown') || ' (unknown): ' || case when length(flat) > 400 then substr(flat, 1, 397) || '...' else flat end, chr(10) order by doc_id)) as context from d group by lang""")
def answer_context(t):
    rows = t.documents.withColumns({"label": F.col("doc_id").cast("string"), "published": F.lit(None).cast("date")})
    return S.context_block(rows, "lang", "doc_id").select("lang", F.sha2(F.col("context").cast("binary"), 256).alias("context"))


@query("select coalesce(min(d), 'unknown') as first, coalesce(max(d), 'unknown') as last from (select coalesce(cast(cast(o_orderdate as date) as varchar), substr('1994-05-06T07:08:09', 1, 10)) as d from customer left join orders on o_custkey = c_custkey)")
def date_coverage(t):
    articles = t.customer.select(F.col("c_custkey").alias("article_id"), F.lit("1994-05-06T07:08:09").alias("article_time"))
    return S.date_coverage(articles, t.orders.select(F.col("o_custkey").alias("article_id"), F.col("o_orderdate").cast("date").alias("published")))


_TYPED = "(select distinct l_orderkey as chunk_id, l_suppkey * 1000 + l_partkey % 40 as entity_id, case when l_partkey % 3 = 0 then 'PER' else 'ORG' end as entity_type from lineitem)"


@query(f"with m as {_TYPED} select entity_type, count(*) as n, count(distinct entity_id) as entities from m where entity_type <> 'PER' or entity_id in (select entity_id from m where entity_type = 'PER' group by 1 having count(distinct chunk_id) >= 2) group by 1")
def person_singletons(t):
    m = t.lineitem.select(F.col("l_orderkey").alias("chunk_id"), (F.col("l_suppkey") * 1000 + F.col("l_partkey") % 40).alias("entity_id"), F.when(F.col("l_partkey") % 3 == 0, "PER").otherwise("ORG").alias("entity_type")).distinct()
    return S.drop_person_singletons(m).groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("entities"))


@query("""select brand, p_partkey, display_name from (select p_brand as brand, p_partkey, p_name as display_name, row_number() over (partition by p_brand order by p_size % 2 = 0 desc, length(p_name) desc, p_partkey) as rn from part) where rn = 1""")
def preferred_entities(t):
    rows = t.part.select(F.col("p_brand").alias("brand"), "p_partkey", F.col("p_name").alias("display_name"), F.when(F.col("p_size") % 2 == 0, "T").alias("ticker"), F.col("p_partkey").alias("ord"))
    return S.preferred_entity(rows, "brand").select("brand", "p_partkey", "display_name")


_MENTIONS = """(select l_partkey as entity_id, strftime(o_orderdate, '%Y-Q') || quarter(o_orderdate) as period_key, l_orderkey as chunk_id, l_orderkey * 10 + l_linenumber as ord, l_shipdate, o_orderpriority as text,
  nullif(l_returnflag, 'N') as entity_type, 'part ' || l_partkey as display_name from lineitem join orders on o_orderkey = l_orderkey)"""


def _mentions(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    period = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-Q"), F.quarter("o_orderdate").cast("string"))
    return rows.select(F.col("l_partkey").alias("entity_id"), period.alias("period_key"), F.col("l_orderkey").alias("chunk_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("o_orderpriority").alias("text"), F.nullif("l_returnflag", F.lit("N")).alias("entity_type"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("display_name"))


@query(f"""with m as {_MENTIONS}, c as (select entity_id, period_key, chunk_id, min(ord) as ord from m group by 1, 2, 3), l as (select entity_id, period_key, string_agg(chunk_id, ',' order by ord, chunk_id) as chunks from c group by 1, 2)
  select entity_id, period_key, chunks, display_name from l join (select distinct entity_id, period_key, display_name from m) using (entity_id, period_key)""")
def knowledge_nodes(t):
    return S.knowledge_nodes(_mentions(t)).select("entity_id", "period_key", F.array_join(F.transform("source_chunks", lambda c: c.cast("string")), ",").alias("chunks"), "display_name")


@query(f"""with u as (select distinct entity_id || '::' || period_key as kn_uid, chunk_id, substr(text, 1, 500) as text from {_MENTIONS})
  select substr(md5(kn_uid || '::' || chunk_id), 1, 16) as knowledge_uid, kn_uid, chunk_id, text from u""")
def knowledge_units(t):
    m = _mentions(t)
    return S.knowledge_units(m.drop("text"), m.select("chunk_id", "text").distinct()).select("knowledge_uid", "kn_uid", "chunk_id", "text")


@query(f"""with t as (select entity_id || '::' || period_key as kn_uid, text, min(ord) as ord from {_MENTIONS} group by 1, 2) select kn_uid, string_agg(text, ' ' order by ord, text) as description from t group by 1""")
def knowledge_descriptions(t):
    m = _mentions(t)
    return S.node_descriptions(S.knowledge_units(m.drop("text"), m.select("chunk_id", "text").distinct()))


@query("""select doc_id as chunk_id, published from (select doc_id, date '2024-01-01' + cast(doc_id % 90 as int) as published from documents where doc_id not in (select vec_id from embeddings)) order by published desc, doc_id % 5, doc_id limit 256""")
def pending_embeddings(t):
    c = t.articles.select(F.col("doc_id").alias("chunk_id"), "published", (F.col("doc_id") % 5).alias("chunk_index"))
    return S.pending_embeddings(c, t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")).select("chunk_id", "published")


@query("select l_partkey, l_suppkey, count(*) as n from lineitem where l_partkey in (select p_partkey from part where p_size < 25) and l_suppkey in (select s_suppkey from supplier where s_acctbal > 0) group by 1, 2")
def edges_with_ends(t):
    left = t.part.where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"))
    right = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    e = S.edges_with_ends(t.lineitem.select("l_partkey", "l_suppkey"), left, right, "l_partkey", "l_suppkey")
    return e.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem where l_orderkey is not null and l_linenumber is not null group by 1, 2 having count(*) > 1")
def constraint_violations(t):
    return S.violations(t.lineitem, ["l_orderkey", "l_linenumber"])


SYMBOLS = {"click": "SPY", "view": "SPY", "purchase": "XLY", "error": "VIX"}


@query("""with h as (select user_id, event_type, ts, event_id, case event_type when 'click' then 'SPY' when 'view' then 'SPY' when 'purchase' then 'XLY' when 'error' then 'VIX' end as symbol from events)
  select user_id, symbol, event_type as hop from (select *, row_number() over (partition by user_id, symbol order by event_id) as rn from h where symbol is not null) where rn = 1""")
def hop_symbols(t):
    return S.hop_symbols(t.events.withColumnRenamed("event_type", "hop"), SYMBOLS, "user_id", "event_id", "hop")


@query("""with h as (select user_id, case event_type when 'click' then 'SPY' when 'view' then 'SPY' when 'purchase' then 'XLY' when 'error' then 'VIX' end as symbol from events),
  b as (select symbol, bar_date, round(sum(value), 4) as close from (select case event_type when 'click' then 'SPY' when 'purchase' then 'XLY' when 'error' then 'VIX' end as symbol, cast(ts as date) as bar_date, value from events) where symbol is not null group by 1, 2),
  n as (select *, row_number() over (partition by symbol order by bar_date desc) as rn from b), r as (select symbol, bar_date, (close / nullif(lag(close) over (partition by symbol order by bar_date), 0) - 1) * 100 as pct from n where rn <= 5)
  select user_id, symbol, count(pct) as returns, round(max_by(pct, bar_date), 3) as last_pct from (select distinct user_id, symbol from h where symbol is not null) join r using (symbol) group by 1, 2""")
def market_context(t):
    hops = S.hop_symbols(t.events.withColumnRenamed("event_type", "hop"), SYMBOLS, "user_id", "event_id", "hop")
    to = F.when(F.col("event_type") == "click", "SPY").when(F.col("event_type") == "purchase", "XLY").when(F.col("event_type") == "error", "VIX")
    bars = t.events.select(to.alias("symbol"), F.col("ts").cast("date").alias("bar_date"), "value").where("symbol is not null").groupBy("symbol", "bar_date").agg(F.round(F.sum("value"), 4).alias("close"))
    r = C.close_returns(bars)
    return hops.join(r, "symbol").groupBy("user_id", "symbol").agg(F.count("pct").alias("returns"), F.round(F.max_by("pct", "bar_date"), 3).alias("last_pct"))


@query("""select url, provider from (select *, row_number() over (partition by url order by l, ord) as rn from (
  select url, 'primary' as provider, 0 as l, page_id as ord from pages where length(html) > 1500 union all select url, 'feed', 1, -page_id from pages) where url is not null and url <> '') where rn = 1""")
def merged_links(t):
    a = t.pages.where("length(html) > 1500").select("url", F.lit("primary").alias("provider"), F.col("page_id").alias("ord"))
    return S.merge_links(a, t.pages.select("url", F.lit("feed").alias("provider"), (-F.col("page_id")).alias("ord")))


def _any(col: str, terms) -> str:
    quoted = lambda x: x.replace("'", "''")
    return "(" + " or ".join(f"contains({col}, '{quoted(x)}')" for x in terms) + ")"


_SOURCE = " ".join(f"when contains(q, '{k}') then '{v}'" for k, v in I.SOURCE_KEYWORDS)


@query(f"""select conv_id, turn, {_any('q', I.MARKET_HINTS)} as market, {_any('q', I.CAUSAL_HINTS)} and {_any('q', I.CAUSAL_ANCHORS)} as causal,
  {_any('q', I.SUMMARY_TERMS)} and ({_any('q', I.SUMMARY_TIMES)} or {_any('q', I.SUMMARY_DOMAINS)}) as summary, {_any('q', I.HARD_TITLES)} as hard, case {_SOURCE} end as source,
  case when {_any('q', ('today', 'daily'))} and not contains(q, 'yesterday') then date '{AS_OF}' when contains(q, 'yesterday') and not {_any('q', ('today', 'daily'))} then date '{AS_OF}' - 1 end as day
  from (select *, lower(coalesce(text, '')) || case conv_id % 6 when 0 then ' Summary of today''s news from Bloomberg' when 1 then ' why is oil price rise due to the war' when 2 then ' recap of yesterday and today' when 3 then ' daily recap' when 4 then ' overview yesterday' else '' end as said, lower(said) as q from conversations)""")
def question_intents(t):
    tail = F.when(F.col("conv_id") % 6 == 0, " Summary of today's news from Bloomberg").when(F.col("conv_id") % 6 == 1, " why is oil price rise due to the war").when(F.col("conv_id") % 6 == 2, " recap of yesterday and today").when(F.col("conv_id") % 6 == 3, " daily recap").when(F.col("conv_id") % 6 == 4, " overview yesterday").otherwise("")
    q = F.concat(F.coalesce("text", F.lit("")), tail)
    c = t.conversations.withColumn("q", q)
    q = F.col("q")
    return c.select("conv_id", "turn", I.is_market_question(q).alias("market"), I.is_causal_question(q).alias("causal"), I.is_summary_question(q).alias("summary"), I.is_hard_include(F.lit(None).cast("string"), q).alias("hard"), I.source_asked(q).alias("source"), I.summary_dates(q, F.lit(AS_OF).cast("date"))["start"].alias("day"))


@query(f"""select n_nationkey as k, lower(n_name) in ({", ".join(f"'{x}'" for x in I.COUNTRIES)}) as country, lower(n_name) in ({", ".join(f"'{x}'" for x in I.COUNTRIES + I.REGIONS)}) as place, len(regexp_extract_all(n_name, '\\S+')) >= 2 as person from nation""")
def name_predicates(t):
    n = F.lower("n_name")
    return t.nation.select(F.col("n_nationkey").alias("k"), I.is_country(n).alias("country"), I.is_known_location(n).alias("place"), I.is_prominent_person(n).alias("person"))


@query(r"""with x as (select conv_id, turn, case turn % 3 when 0 then '<think>plan' || chr(10) || '</think> ' || text when 1 then text || ' <think>open ' || text else text end as raw from conversations)
  select conv_id, turn, sha256(regexp_replace(regexp_replace(regexp_replace(raw, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*', '', 'g'), '^\s+|\s+$', '', 'g')) as clean from x""")
def think_tags(t):
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>plan\n</think> "), "text")).when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" <think>open "), "text")).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", F.sha2(I.strip_think(raw).cast("binary"), 256).alias("clean"))


@query("""select e.event_id, e.event_type as status, o.o_orderkey as macro_event_id, c.c_name as title from events e left join orders o on o.o_custkey = e.user_id and e.event_type <> 'view' left join customer c on c.c_custkey = o.o_custkey
  where e.value > 50 or e.event_type in ('error', 'signup') order by e.ts desc, e.event_id, o.o_orderkey limit 200""")
def questionable_events(t):
    """Audit rows with the events of their run, the events' chunk and article, none or several each."""
    a = t.audit.where((F.col("value") > 50) | F.col("status").isin("error", "signup"))
    o = t.orders.select(F.col("o_orderkey").alias("macro_event_id"), F.col("o_custkey").alias("run_id"))
    c = t.customer.select(F.col("c_custkey").alias("article_id"), F.col("c_name").alias("title"))
    j = a.join(o, (F.col("chunk_id") == F.col("run_id")) & (F.col("status") != "view"), "left").join(c, F.col("run_id") == F.col("article_id"), "left")
    return j.orderBy(F.desc("created_at"), "event_id", F.asc_nulls_last("macro_event_id")).limit(200).select("event_id", "status", "macro_event_id", "title")


@query("select c.period_key, count(*) as events, min(o_orderkey) as first_event from orders e left join (select o_orderkey as k, case when o_custkey % 5 <> 0 then strftime(o_orderdate, '%Y-%m') else '' end as period_key from orders) c on c.k = e.o_orderkey where c.period_key <> '' group by 1")
def event_vertices(t):
    c = t.orders.select(F.col("o_orderkey").alias("chunk_id"), F.when(F.col("o_custkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise("").alias("period_key")).where("period_key <> ''")
    return t.macro_events.select("event_id", "chunk_id").join(c, "chunk_id").groupBy("period_key").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


@query("select distinct strftime(o_orderdate, '%Y-%m') as key, 'month' as granularity, strftime(o_orderdate, '%Y-%m') as label from orders")
def period_vertices(t):
    p = F.date_format("o_orderdate", "yyyy-MM")
    return t.orders.select(p.alias("key"), F.lit("month").alias("granularity"), p.alias("label")).where("key <> ''").distinct()


@query("select distinct l_orderkey as event_id, lower(trim(l_returnflag)) as channel, l_linestatus as direction from lineitem where coalesce(trim(l_returnflag), '') <> ''")
def channel_edges(t):
    return t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.lower(F.trim("l_returnflag")).alias("channel"), F.col("l_linestatus").alias("direction")).where("channel <> ''").distinct()


@query("select l_orderkey as event_id, lower(trim(l_returnflag)) || ':' || trim(cast(l_suppkey as varchar)) as asset_key, max(l_quantity) as strength from lineitem where l_orderkey in (select o_orderkey from orders) group by 1, 2")
def impact_edges(t):
    key = F.concat(F.lower(F.trim("l_returnflag")), F.lit(":"), F.trim(F.col("l_suppkey").cast("string")))
    rows = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return rows.groupBy(F.col("l_orderkey").alias("event_id"), key.alias("asset_key")).agg(F.max("l_quantity").alias("strength"))


@query("select distinct l_partkey as entity_id, p_type as entity_type from lineitem join part on p_partkey = l_partkey where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT')")
def entities_of_chunks(t):
    got = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("chunk_id"))
    m = S.filter_chunks(t.mentions, got).select("entity_id").distinct()
    return m.join(t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("entity_type")), "entity_id")


@query("select p_partkey as entity_id, s_suppkey as instrument_id from part join supplier on p_partkey % 100 = s_suppkey and p_size > 10")
def entity_instruments(t):
    e = t.part.where("p_size > 10").select(F.col("p_partkey").alias("entity_id"), (F.col("p_partkey") % 100).alias("ticker"))
    return e.join(t.supplier.select(F.col("s_suppkey").alias("ticker"), F.col("s_suppkey").alias("instrument_id")), "ticker").select("entity_id", "instrument_id")


@query("select role, count(*) as total, count(*) filter (length(text) % 2 = 0) as passed, round(count(*) filter (length(text) % 2 = 0) / count(*), 4) as rate from conversations group by 1")
def suite_totals(t):
    ok = F.sum((F.char_length("text") % 2 == 0).cast("long"))
    return t.conversations.groupBy("role").agg(F.count("*").alias("total"), ok.alias("passed"), F.round(ok / F.count("*"), 4).alias("rate"))
