"""Queries of retrieval for a table of questions, with their SQL.

Stand-ins: user turns of conversations are questions, with the vector of their conversation's number; documents are chunks,
embeddings their vectors; orders are events, lineitem mentions, involved entities and impacts. What a question asks for
is dealt by its conversation's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.text import QUESTION_STOP_WORDS
from tidegraph.operators import batch_search as B
from tidegraph.operators import retrieval as R
from tidegraph.plans.catalogue import Tables, query

AS_OF = "2024-04-01"


def questions(t: Tables) -> DataFrame:
    c = t.conversations.where("role = 'user'").select("conv_id", "turn", "text")
    n, some = F.col("conv_id"), lambda d, r, x: F.when(F.col("conv_id") % d == r, x)
    day = lambda s: F.lit(s).cast("date")
    q = c.select(
        (n * 1000 + F.col("turn")).alias("question_id"), "text", F.when(n % 3 != 0, n * 7 + F.col("turn")).alias("entity_id"), some(2, 0, n % 50).alias("asset_id"),
        some(5, 0, F.array(F.lit("2024-01"), F.lit("2024-03"))).alias("periods"), some(4, 1, day("2024-01-20")).alias("start"), some(4, 1, day("2024-03-10")).alias("end"), some(7, 0, F.lit("src1")).alias("source"), "conv_id",
    )
    return q.join(t.embeddings.select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("vector")), "conv_id", "left").drop("conv_id")


def chunks(t: Tables) -> DataFrame:
    day = F.when(F.col("doc_id") % 7 != 0, F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(90)).cast("int")))
    d = t.documents.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 40).alias("article_id"), "text", "source", day.alias("published")).withColumn("period_key", F.date_format("published", "yyyy-MM"))
    return d.join(t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")


def events(t: Tables) -> DataFrame:
    e = t.orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("chunk_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("confidence"), F.concat(F.lit("2024-0"), (1 + F.col("o_orderkey") % 3).cast("string")).alias("period_key"))
    return e.join(t.embeddings.select(F.col("vec_id").alias("event_id"), "embedding"), "event_id", "left")


def links(t: Tables) -> tuple[DataFrame, DataFrame]:
    item = t.lineitem
    return item.select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("event_id")), item.select(F.col("l_suppkey").alias("asset_id"), F.col("l_orderkey").alias("event_id"), F.col("l_returnflag").alias("direction"), F.col("l_quantity").alias("strength"))


_STOP = ", ".join(f"'{w}'" for w in QUESTION_STOP_WORDS)
_COS = "coalesce(list_cosine_similarity({0}::double[], {1}::double[]), 0.0)"
_WITH = f"""q as materialized (
    select conv_id * 1000 + turn as question_id, text, case when conv_id % 3 <> 0 then conv_id * 7 + turn end as entity_id, case when conv_id % 2 = 0 then conv_id % 50 end as asset_id,
      case when conv_id % 5 = 0 then ['2024-01', '2024-03'] end as periods, case when conv_id % 4 = 1 then date '2024-01-20' end as a, case when conv_id % 4 = 1 then date '2024-03-10' end as b,
      case when conv_id % 7 = 0 then 'src1' end as source, embedding as vector,
      list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')), lambda w: not list_contains([{_STOP}], w)) as words
    from conversations left join embeddings on vec_id = conv_id where role = 'user'),
  c as materialized (select *, strftime(published, '%Y-%m') as period_key from (
    select doc_id as chunk_id, doc_id % 40 as article_id, text, source, case when doc_id % 7 <> 0 then date '2024-01-01' + cast(doc_id % 90 as int) end as published, embedding,
      list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{3,}}')) as words from documents left join embeddings on vec_id = doc_id)),
  e as materialized (select o_orderkey as event_id, o_orderkey as chunk_id, case when o_orderstatus <> 'P' then o_totalprice end as confidence, '2024-0' || (1 + o_orderkey % 3) as period_key, embedding
    from orders left join embeddings on vec_id = o_orderkey)"""
_DATED = "(q.a is null or coalesce(c.published >= q.a, false)) and (q.b is null or coalesce(c.published <= q.b, false)) and (q.source is null or coalesce(c.source = q.source, false))"
_MEETS = f"{_DATED} and (q.periods is null or coalesce(list_contains(q.periods, c.period_key), false))"


def _semantic(name: str, who: str, k: int) -> str:
    return f"""{name} as materialized (select * from (select *, row_number() over (partition by question_id order by score desc, chunk_id) as place from (
    select q.question_id, c.chunk_id, {_COS.format("q.vector", "c.embedding")} as cos,
      0.85 * {_COS.format("q.vector", "c.embedding")} + 0.15 * coalesce(len(list_intersect(q.words, c.words)) / nullif(len(q.words), 0), 0) as score
    from {who} q join c on c.embedding is not null and {_MEETS})) where place <= {k})"""


def _event_search(name: str, who: str, k: int) -> str:
    pool = lambda where: f"(select event_id from (select event_id, row_number() over (order by coalesce(confidence, 0) desc, event_id) as rn from e {where}) where rn <= 600)"
    return f"""{name} as materialized (select x.question_id, c.chunk_id, x.event_id, x.score, x.place from (
    select *, row_number() over (partition by question_id order by score desc, event_id) as place from (
      select q.question_id, e.event_id, e.chunk_id, {_COS.format("q.vector", "e.embedding")} as score from {who} q join e on e.embedding is not null and case when q.periods is null
        then e.event_id in {pool("")} else e.event_id in {pool("where period_key in ('2024-01', '2024-03')")} end) where score > 0.2) x
    join q on q.question_id = x.question_id join e on e.event_id = x.event_id join c on c.chunk_id = e.chunk_id and {_DATED} where x.place <= {k})"""


@query(f"with {_WITH}, {_semantic('s', 'q', 8)} select question_id, chunk_id, cast(place as int) as place, round(score, 6) as score, round(cos, 6) as semantic_score from s")
def batch_semantic_search(t):
    """R6 for every question."""
    best = B.best_matches(chunks(t), questions(t), 8)
    return B._placed(best, [F.desc("score"), F.col("chunk_id")], 8).select("question_id", "chunk_id", "place", F.round("score", 6).alias("score"), F.round("semantic_score", 6).alias("semantic_score"))


@query(f"with {_WITH}, {_event_search('s', 'q', 12)} select question_id, chunk_id, event_id, cast(place as int) as place, round(score, 6) as prior from s")
def batch_event_search(t):
    """R4 for every question, with its chunks."""
    return B.event_search(questions(t), events(t), chunks(t)).select("question_id", "chunk_id", "event_id", "place", F.round("prior", 6).alias("prior"))


_PRIOR = "coalesce(nullif(confidence, 0), 0.55)"
_LINKED = """{name} as materialized (select x.question_id, c.chunk_id, x.event_id, {prior} as prior, x.place{extra} from (
    select *, row_number() over (partition by question_id order by coalesce(confidence, 0) desc, event_id{extra}) as place from (
      select distinct q.question_id, q.{key}, e.event_id, e.chunk_id, e.confidence{extra} from q join lineitem on {item} = q.{key} join e on e.event_id = l_orderkey
      where q.periods is null or list_contains(q.periods, e.period_key))) x
    join q on q.question_id = x.question_id join c on c.chunk_id = x.chunk_id and {dated} where x.place <= {k})"""
_ASSETS = _LINKED.format(name="t2", prior=_PRIOR, key="asset_id", item="l_suppkey", dated=_DATED, k=8, extra=", l_returnflag, l_quantity")


@query(f"with {_WITH}, {_ASSETS} select question_id, chunk_id, event_id, cast(place as int) as place, prior, l_returnflag as direction, l_quantity as strength from t2")
def batch_asset_events(t):
    """R3 for every question that names an asset, with the impact's attributes."""
    return B.event_candidates(questions(t), "asset_id", links(t)[1], events(t), chunks(t), "macro_event_asset", 8).drop("kind")


_NEAR = """m as materialized (select distinct l_partkey as entity_id, l_orderkey as chunk_id from lineitem),
  n as materialized (select * from (select asked, entity_id as neighbour, row_number() over (partition by asked order by shared desc, entity_id) as rn from (
    select x.entity_id as asked, y.entity_id, count(*) as shared from m x join m y on x.chunk_id = y.chunk_id and x.entity_id <> y.entity_id
    where x.entity_id in (select entity_id from q) group by all)) where rn <= 3)"""
_RANK = """scored as (select l.*, 0.75 * case when c.embedding is null then coalesce(nullif(prior, 0), 0.5) else coalesce(list_cosine_similarity(q.vector::double[], c.embedding::double[]), 0.0) end
      + 0.25 * coalesce(exp(-ln(2) * greatest(date '{as_of}' - c.published, 0) / 5.0), 0.8) as score
    from lists l join q using (question_id) join c using (chunk_id)),
  best as (select question_id, chunk_id, min_by({{'kind': kind, 'score': score}}, {{'s': -score, 'l': list, 'p': place}}) as b, min({{'l': list, 'p': place}}) as met from scored group by all),
  ranked as (select question_id, chunk_id, b.kind as kind, b.score as score, row_number() over (partition by question_id order by b.score desc, met, chunk_id) as position from best)"""


@query(f"""with {_WITH}, {_NEAR},
  t0 as materialized (select * from (select q.question_id, c.chunk_id, row_number() over (partition by q.question_id order by c.published desc nulls last, c.chunk_id) as place
    from q join m on m.entity_id = q.entity_id join c on c.chunk_id = m.chunk_id and {_MEETS}) where place <= 800),
  {_LINKED.format(name="t1", prior=_PRIOR, key="entity_id", item="l_partkey", dated=_DATED, k=24, extra="")}, {_ASSETS},
  plain as materialized (select * from q where entity_id is null), {_event_search("t3", "plain", 8)},
  l0 as materialized (select question_id, chunk_id, 'entity_mentions' as kind, cast(null as double) as prior, place, 0 as list from t0
    union all select question_id, chunk_id, 'macro_event_entity', prior, place, 1 from t1 union all select question_id, chunk_id, 'macro_event_asset', prior, place, 2 from t2
    union all select question_id, chunk_id, 'macro_event_semantic', score, place, 3 from t3),
  short0 as materialized (select * from q where entity_id is not null and question_id not in (select question_id from l0 group by 1 having count(distinct chunk_id) >= 4)),
  t4 as materialized (select * from (select q.question_id, c.chunk_id, row_number() over (partition by q.question_id order by c.published desc nulls last, c.chunk_id, n.neighbour) as place
    from short0 q join n on n.asked = q.entity_id join m on m.entity_id = n.neighbour join c on c.chunk_id = m.chunk_id and {_MEETS}) where place <= 4),
  l1 as materialized (select * from l0 union all select question_id, chunk_id, 'cooccurrence', null, place, 4 from t4),
  short1 as materialized (select * from plain union all select * from q where entity_id is not null and question_id not in (select question_id from l1 group by 1 having count(distinct chunk_id) >= 4)),
  {_semantic("t5", "short1", 8)},
  lists as materialized (select * from l1 union all select question_id, chunk_id, 'semantic', cos, place, 5 from t5),
  {_RANK.format(as_of=AS_OF)}
  select question_id, chunk_id, kind, round(score, 6) as score, cast(position as int) as position from ranked where position <= 8""")
def batch_retrieve(t):
    """R10 over the retrievers, for every question."""
    involves, impacts = links(t)
    mentions = involves.withColumnRenamed("event_id", "chunk_id")
    best = B.retrieve(questions(t), mentions, involves, impacts, events(t), chunks(t), F.lit(AS_OF).cast("date"))
    return best.select("question_id", "chunk_id", "kind", F.round("score", 6).alias("score"), "position")


@query(f"""with {_WITH}, {_semantic("s", "q", 24)}, lists as (select question_id, chunk_id, 'semantic' as kind, cos as prior, place, 0 as list from s), {_RANK.format(as_of=AS_OF)},
  p as (select *, position <= 18 as head, case when position <= 18 then 0.15 * score + 0.85 * (chunk_id % 97 / 97.0) else score end as s2 from ranked)
  select question_id, chunk_id, round(s2, 6) as score, cast(row_number() over (partition by question_id order by not head, case when head then -s2 else 0 end, position) as int) as position from p""")
def batch_rerank(t):
    """V8: vector score and decay, then a scorer's scores over the first 18 of each question."""
    q, c = questions(t), chunks(t)
    found = B.ranked(B.semantic_candidates(q, c, 24).withColumn("list", F.lit(0)), q, c, F.lit(AS_OF).cast("date"))
    scores = found.select("question_id", "chunk_id", (F.col("chunk_id") % 97 / 97.0).alias("rerank_score"))
    return B.reranked(found, scores).select("question_id", "chunk_id", F.round("score", 6).alias("score"), "position")


@query(f"""with {_WITH},
  pool as (select * from (select q.question_id, q.vector, c.*, row_number() over (partition by q.question_id order by c.published desc nulls last, c.chunk_id) as rn from q join c on {_MEETS}) where rn <= 300),
  s as (select question_id, chunk_id, article_id, source, 0.7 * case when embedding is null then 0 else {_COS.format("vector", "embedding")} end + 0.3 * coalesce(exp(-greatest(date '{AS_OF}' - published, 0) / 2.0), 0) as score from pool),
  d as (select * from (select *, row_number() over (partition by question_id order by score desc, chunk_id) as rn from s) where rn <= 24),
  a as (select * from (select * exclude (rn), row_number() over (partition by question_id, article_id order by score desc, chunk_id) as rn from d) where rn <= 2),
  o as (select * from (select * exclude (rn), row_number() over (partition by question_id, lower(trim(coalesce(source, 'unknown'))) order by score desc, chunk_id) as rn from a) where rn <= 1)
  select question_id, chunk_id, source, round(score, 6) as score, count(*) over (partition by question_id) >= 3 as enough from o""")
def batch_summary(t):
    """R14 for every question: newest pool, score, caps an article and a source, the guard on sources."""
    rows = B.summary_candidates(questions(t), chunks(t), F.lit(AS_OF).cast("date"))
    return R.summary_list(rows).select("question_id", "chunk_id", "source", F.round("score", 6).alias("score"), "enough")
