"""Queries of mention extraction over documents, with their SQL.

The dictionary: the first one to three words of each benchmark passage, an entity of the least item that opens so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions import intents as I
from tidegraph.functions import text as X
from tidegraph.operators import mentions as M
from tidegraph.operators import search as S
from tidegraph.plans.catalogue import Tables, query


def dictionary(t: Tables, sizes=(1, 2, 3)) -> DataFrame:
    w = F.split(X.canonical_name(F.col("text")), " ")
    rows = t.benchmark.select("item_id", F.explode(F.array(*[F.when(F.size(w) >= n, F.array_join(F.slice(w, 1, n), " ")) for n in sizes])).alias("alias")).where("alias <> ''")
    rows = rows.groupBy("alias").agg(F.min("item_id").alias("item_id"))
    kind = F.when(F.col("item_id") % 3 == 0, "PER").when(F.col("item_id") % 3 == 1, "ORG").otherwise("MISC")
    name = F.concat(F.lit("b"), F.col("item_id").cast("string"))
    return rows.select("alias", name.alias("canonical_name"), F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("display_name"), kind.alias("entity_type"), F.when(F.col("item_id") % 2 == 0, F.upper(name)).alias("ticker"))


def _texts(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("chunk_id"), "text")


_WORDS = "list_filter(string_split(lower(regexp_replace(regexp_replace(coalesce(text, ''), '[''`]', '', 'g'), '[^\\p{L}\\p{N}_&-]+', ' ', 'g')), ' '), lambda x: x <> '')"
def _spans(aliases: str) -> str:
    return f"""b as (select item_id, {_WORDS} as w from benchmark),
  dict as (select alias, min(item_id) as item_id from (select item_id, array_to_string(w[1:n], ' ') as alias from b, (select unnest([1, 2, 3]) as n) where len(w) >= n) group by 1),
  places as (select unnest({list(I.COUNTRIES + I.REGIONS)!r}) as alias), a as ({aliases}),
  d as materialized (select doc_id, {_WORDS} as w from documents),
  g as (select doc_id, i - 1 as pos, n, array_to_string(w[i : i + n - 1], ' ') as alias from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d), (select unnest([1, 2, 3]) as n) where i + n - 1 <= len(w)),
  h as materialized (select doc_id, pos, max(n) as n, max_by(g.alias, n) as alias from g join a using (alias) group by 1, 2),
  nxt as materialized (select x.*, y.pos as after from h x asof left join h y on x.doc_id = y.doc_id and x.pos + x.n <= y.pos),
  spans as (select doc_id, pos, n, alias, after from nxt where (doc_id, pos) in (select doc_id, min(pos) from h group by 1)
    union all select n.* from spans s join nxt n on n.doc_id = s.doc_id and n.pos = s.after)"""


@query(f"with recursive {_spans('select alias from dict')} select doc_id as chunk_id, cast(pos as int) as pos, cast(n as int) as words, alias from spans")
def gazetteer_spans(t):
    """Every place where an alias stands, leftmost and longest."""
    return M.gazetteer_spans(_texts(t), dictionary(t)).select("chunk_id", F.col("at").alias("pos"), "words", "alias")


_FOUND = f"""{_spans("select alias from dict union select alias from places")},
  m as (select doc_id, pos, 'b' || item_id as name, 'Item ' || item_id as display, case item_id % 3 when 0 then 'PER' when 1 then 'ORG' else 'MISC' end as kind from spans join dict using (alias) where length(alias) >= 2
    union all select doc_id, pos, alias, null, 'LOC' from spans where alias not in (select alias from dict) and length(alias) >= 2),
  f as (select doc_id, name, min(pos) as ord, max(kind) as kind, max(display) as display from m group by 1, 2),
  kept as (select * from f where kind <> 'PER' or name in (select name from f where kind = 'PER' group by 1 having count(*) >= 2))"""


@query(f"with recursive {_FOUND} select doc_id as chunk_id, name as canonical_name, cast(ord as int) as ord, kind as entity_type, md5(doc_id || '::' || name) as mention_id from kept")
def extracted_mentions(t):
    """A row a chunk and entity, persons of a single chunk dropped."""
    return M.extract_mentions(_texts(t), dictionary(t)).select("chunk_id", "canonical_name", "ord", "entity_type", "mention_id")


@query(f"""with b as (select item_id, {_WORDS} as w from benchmark), dict as (select w[1] as alias, 'b' || min(item_id) as name, 'item ' || min(item_id) as display, min(item_id) % 3 = 0 as person from b where len(w) > 0 group by 1),
  d as (select doc_id, text, {_WORDS} as w from documents), m as materialized (select distinct doc_id, x.name, x.alias, x.display, x.person from (select doc_id, unnest(w) as alias from d) join dict x using (alias) where length(alias) >= 2),
  kept as (select * from m where not person or name in (select name from m where person group by 1 having count(*) >= 2)),
  s as (select k.*, text, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '' and (contains(lower(s), alias) or contains(lower(s), display) or contains(lower(s), name))) as said
    from kept k join documents using (doc_id))
  select substr(md5(name || '::2024-01::' || doc_id), 1, 16) as knowledge_uid, doc_id as chunk_id, sha256(array_to_string(said[1:3], ' ')) as text from s where len(said) > 0""")
def knowledge_sentences(t):
    """Knowledge units of the passages' first words: the sentences that name them."""
    one = dictionary(t, (1,))
    m = M.extract_mentions(_texts(t), one, places=False).select("chunk_id", F.col("canonical_name").alias("entity_id"), "display_name", "raw_name", "ord", F.lit("2024-01").alias("period_key"), "entity_type", "ticker")
    units = S.knowledge_units(m, _texts(t), fallback=0).where("text <> ''")
    return units.select("knowledge_uid", "chunk_id", F.sha2(F.col("text").cast("binary"), 256).alias("text"))
