"""Further registered queries: linking, target resolution, answer grading. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegraph.functions import text as X
from tidegraph.operators import answers as A
from tidegraph.operators import linking as L
from tidegraph.operators import retrieval as R
from tidegraph.plans.catalogue import query


def _plain(c):
    """ASCII letters and digits, lower-cased, parted by single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


_SQL_PLAIN = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
_ANSWER = "'Answer: ' || text || ' [S' || (item_id % 6) || '] [S1] [S9]'"


def _first_words(n: int):
    return F.array_join(F.slice(F.split(_plain(F.col("text")), " "), 1, n), " ")


@query(f"""with a as (select distinct array_to_string(list_slice(string_split({_SQL_PLAIN}, ' '), 1, 2), ' ') as alias from benchmark),
  d as (select doc_id, ' ' || {_SQL_PLAIN} || ' ' as t from documents)
  select doc_id, alias from (select doc_id, alias, row_number() over (partition by doc_id order by length(alias) desc, alias) as rn
  from d join a on contains(t, ' ' || alias || ' ')) where rn = 1""")
def contained_alias(t):
    docs = t.documents.select("doc_id", _plain(F.col("text")).alias("text"))
    aliases = t.benchmark.select(_first_words(2).alias("alias"))
    return L.contained_aliases(docs, aliases, "doc_id", "text").withColumnRenamed("id", "doc_id")


@query()
def mention_links(t):
    """Three-word openings of the passages linked to their two-word openings."""
    mentions = t.benchmark.select("item_id", _first_words(3).alias("mention"), F.when(F.col("item_id") % 4 == 0, "PER").otherwise("ORG").alias("label"))
    return L.link_mentions(mentions, t.benchmark.select(_first_words(2).alias("alias")).distinct())


@query("""select c_custkey as question_id, lower(n_name) as canonical_name, cast(0.97 as double) as confidence from customer join nation on c_nationkey = n_nationkey""")
def question_targets(t):
    """A question about each customer's nation, by the nations' names as entity aliases."""
    q = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("question_id"), F.concat(F.lit("Latest news on "), F.lower("n_name")).alias("question"))
    none = t.spark.createDataFrame([], "alias string, ticker string, display_name string")
    known = t.nation.select(X.canonical_name(F.col("n_name")).alias("alias"), F.lower("n_name").alias("canonical_name"), F.col("n_name").alias("display_name"), F.lit("LOC").alias("entity_type"), F.lit(None).cast("string").alias("ticker"))
    seen = known.select("canonical_name", "display_name", "entity_type", "ticker", F.lit(0.5).alias("confidence"))
    return L.resolve_targets(q, none.select("alias", "ticker"), none.select("ticker", "display_name"), known, seen).select("question_id", "canonical_name", "confidence")


_SQL_DIRECTION = "case " + " ".join(f"when regexp_matches(lower(text), '{p}') then '{d}'" for p, d in A.DIRECTIONS) + " else 'unclear' end"


@query(f"select conv_id, turn, {_SQL_DIRECTION} as direction from conversations")
def answer_direction(t):
    return t.conversations.select("conv_id", "turn", A.direction(F.coalesce("text", F.lit(""))).alias("direction"))


@query(r"""select item_id, least(cast(nullif(regexp_extract('Rates: ' || (item_id * 7) || '% . Confidence: ' || (item_id * 3) || ' % of ' || text,
  '(?i)confidence[:\s]+([0-9]{1,3})\s*%', 1), '') as int), 100) as confidence from benchmark""")
def answer_confidence(t):
    n = lambda k: (F.col("item_id") * k).cast("string")
    return t.benchmark.select("item_id", A.confidence(F.concat(F.lit("Rates: "), n(7), F.lit("% . Confidence: "), n(3), F.lit(" % of "), F.col("text"))).alias("confidence"))


def _sql_hits(patterns) -> str:
    return " + ".join(f"regexp_matches(lower(text), '{p}')::int" for p in patterns)


@query(f"""select conv_id, turn, {_sql_hits(A.HEDGES)} as hedges, {_sql_hits(A.OVERCLAIMS)} as overclaims, regexp_matches(lower(text), '{A.DOMINANCE}') as dominance,
  regexp_matches(lower(text), '{A.COUNTER}') as counter from conversations""")
def answer_language(t):
    c = F.col("text")
    return t.conversations.select("conv_id", "turn", F.size(A.hits(c, A.HEDGES)).alias("hedges"), F.size(A.hits(c, A.OVERCLAIMS)).alias("overclaims"), F.lower(c).rlike(A.DOMINANCE).alias("dominance"), F.lower(c).rlike(A.COUNTER).alias("counter"))


@query("""with a as (select item_id, """ + _ANSWER + r""" as answer from benchmark), u as (select item_id, list_sort(list_distinct(list_filter(
  regexp_extract_all(answer, '\[(S[0-9]+)\]', 1), lambda x: x in ('S0', 'S1', 'S2', 'S3')))) as used from a)
  select item_id, array_to_string(used, ',') as used, len(used) as n from u""")
def citation_grounding(t):
    answer = F.concat(F.lit("Answer: "), F.col("text"), F.lit(" [S"), (F.col("item_id") % 6).cast("string"), F.lit("] [S1] [S9]"))
    g = A.grounding(answer, F.array(*[F.lit(f"S{i}") for i in range(4)]))
    return t.benchmark.select("item_id", F.array_join(g["used"], ",").alias("used"), g["count"].cast("long").alias("n"))


@query(f"""select conv_id, turn, regexp_replace(text, '{R.REFERENCES}', 'Acme $1', 'g') as rewritten from conversations where turn > 0
  union all select conv_id, turn, text from conversations where turn = 0""")
def coreference(t):
    """References replaced by the entity that the first turn of each conversation names."""
    none = F.lit(None).cast("date")
    turns = t.conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"), F.col("text").alias("query"), F.when(F.col("turn") == 0, "Acme $1").alias("display_name"), none.alias("date_start"), none.alias("date_end"))
    return R.resolve_references(turns).select(F.col("session_id").alias("conv_id"), F.col("turn_index").alias("turn"), "rewritten")


@query("""with f as (select lower(o_orderpriority) as hop, o_orderkey as chunk_id, o_totalprice as score from orders),
  b as (select * from (select *, row_number() over (partition by hop order by score desc, chunk_id) as rn from f) where rn <= 4)
  select chunk_id, hop from b""")
def causal_hops(t):
    """One chain over all priorities, each named twice."""
    hops = t.orders.select("o_orderpriority").distinct().select(F.lit(1).alias("question_id"), F.explode(F.array(F.lit(0), F.lit(9))).alias("k"), "o_orderpriority")
    hops = hops.select("question_id", (F.substring("o_orderpriority", 1, 1).cast("int") + F.col("k")).alias("at"), F.concat(F.lit(" "), "o_orderpriority").alias("hop"))
    found = t.orders.select(F.lower("o_orderpriority").alias("hop"), F.col("o_orderkey").alias("chunk_id"), F.col("o_totalprice").alias("score"))
    return R.causal_hops(hops, found).select("chunk_id", "hop")


@query("""with r as (select o_custkey as question_id, o_orderkey as chunk_id, o_totalprice as score, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as tier from orders),
  h as (select question_id, count(*) filter (tier < 1) as h1, count(*) filter (tier < 2) as h2 from r group by 1),
  u as (select r.* from r join h using (question_id) where tier = 0 or (tier = 1 and h1 < 4) or (tier = 2 and h2 < 4))
  select question_id, chunk_id, 'tier_' || tier as kind from (select *, row_number() over (partition by question_id order by score desc, chunk_id) as rn from u) where rn <= 8""")
def retrieval_cascade(t):
    rows = t.orders.select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_totalprice").alias("score"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("tier"))
    return R.cascade([rows.where(F.col("tier") == i).withColumn("kind", F.lit(f"tier_{i}")) for i in range(3)]).select("question_id", "chunk_id", "kind")


@query("""with a as (select lang as question_id, doc_id as chunk_id, doc_id % 50 as article_id, source, cast(n_chars as double) as score from documents),
  c as (select * from (select *, row_number() over (partition by question_id, article_id order by score desc, chunk_id) as rn from a) where rn <= 2),
  s as (select question_id, chunk_id, row_number() over (partition by question_id, lower(trim(coalesce(source, 'unknown'))) order by score desc, chunk_id) as rs from c)
  select question_id, chunk_id, count(*) over (partition by question_id) >= 3 as enough from s where rs <= 1""")
def summary_caps(t):
    d = t.documents.select(F.col("lang").alias("question_id"), F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 50).alias("article_id"), "source", F.col("n_chars").cast("double").alias("score"))
    return R.summary_list(d).select("question_id", "chunk_id", "enough")


@query("select user_id as chunk_id, max(ts) as queued_at from events where event_type = 'error' group by 1")
def retry_list(t):
    return R.retry_list(t.events.select(F.col("user_id").alias("chunk_id"), F.col("event_type").alias("queue_name"), F.col("ts").alias("created_at")), "error")
