"""Entity mentions of chunks: spans found by a dictionary's automaton, linked, filtered, once a chunk and entity."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions import intents as I
from tidegraph.functions import text as X
from tidegraph.operators.core import cut, top_per_key
from tidegraph.operators.linking import link_mentions
from tidegraph.operators.search import drop_person_singletons

#: Aliases up to which their automaton goes to the tasks; beyond, runs of words are joined with the aliases.
GAZETTEER = 200_000
#: The labels of entities that are kept.
LABELS = ("ORG", "PER", "LOC", "MISC")

_TOKEN = re.compile(r"[\w&\-'`]+")
_QUOTES = "'`"


def tokens(text: str | None) -> list[tuple[str, int, int]]:
    """(canonical word, start, end) in order, the words that `canonical_name` would leave; quotes at a word's ends are outside."""
    out = []
    for m in _TOKEN.finditer(text or ""):
        word = m[0].replace("'", "").replace("`", "").lower()
        if word:
            out.append((word, m.start() + len(m[0]) - len(m[0].lstrip(_QUOTES)), m.start() + len(m[0].rstrip(_QUOTES))))
    return out


class Trie:
    """The aliases by their words. Walking it from each word of a text finds the longest alias that starts there."""

    def __init__(self, aliases: Iterable[str]):
        self.root: dict = {}
        for a in aliases:
            node = self.root
            for w in a.split():
                node = node.setdefault(w, {})
            node[None] = a

    def spans(self, words: list[str]) -> list[tuple[int, int, str]]:
        """(place of the first word, words, alias): from the left, the longest alias at each place, none inside another."""
        out, i = [], 0
        while i < len(words):
            node, n, best = self.root, 0, None
            while i + n < len(words) and (node := node.get(words[i + n])) is not None:
                n += 1
                if None in node:
                    best = (i, n, node[None])
            if best:
                out.append(best)
            i += best[1] if best else 1
        return out


def leftmost_longest(found: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """`Trie.spans` of all spans that match."""
    out, free = [], 0
    for at, n, alias in sorted(found, key=lambda s: (s[0], -s[1])):
        if at >= free:
            out.append((at, n, alias))
            free = at + n
    return out


def gazetteer_spans(chunks: DataFrame, aliases: DataFrame, most: int = GAZETTEER) -> DataFrame:
    """(chunk_id, at, words, start, end, raw_name, alias): where chunks (chunk_id, text) hold canonical aliases (alias).

    Aliases match whole words, in any case; of overlapping ones the leftmost, then the longest stays. at counts words, start
    and end characters of the text, which raw_name is cut from. Null and empty texts and aliases give nothing. Up to `most`
    aliases go to the tasks as one automaton; more are joined with the runs of words of their lengths, spans then meeting a
    chunk at a time.
    """
    id_type = chunks.schema["chunk_id"].dataType.simpleString()
    schema = f"chunk_id {id_type}, at int, words int, start int, end int, raw_name string, alias string"
    names = ["chunk_id", "at", "words", "start", "end", "raw_name", "alias"]
    a = aliases.select(F.trim(F.regexp_replace("alias", r"\s+", " ")).alias("alias")).where("alias <> ''").distinct()
    listed = [r.alias for r in a.limit(most + 1).collect()]  # most + 1 rows at most

    def rows(chunk, text: str, words: list, spans: list) -> list[tuple]:
        out = []
        for at, n, alias in spans:
            start, end = words[at][1], words[at + n - 1][2]
            out.append((chunk, at, n, start, end, text[start:end], alias))
        return out

    def batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    if len(listed) <= most:
        trie = chunks.sparkSession.sparkContext.broadcast(Trie(listed))

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = tokens(text)
                    out += rows(c, text, words, trie.value.spans([w[0] for w in words]))
                if out:
                    yield batch(out, b.schema.field(0).type)

        return chunks.select("chunk_id", "text").mapInArrow(walk, schema)

    sizes = sorted(r.n for r in a.select(F.size(F.split("alias", " ")).alias("n")).distinct().collect())

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = tokens(text)
                out += rows(c, text, words, [(i, n, " ".join(w[0] for w in words[i : i + n])) for n in sizes for i in range(len(words) - n + 1)])
            if out:
                yield batch(out, b.schema.field(0).type)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by = {(s["at"], s["words"]): s for s in spans}
                for at, n, alias in leftmost_longest((s["at"], s["words"], s["alias"]) for s in spans):
                    s = by[at, n]
                    out.append((c, at, n, s["start"], s["end"], s["raw_name"], alias))
            if out:
                yield batch(out, b.schema.field(0).type)

    hits = chunks.select("chunk_id", "text").mapInArrow(runs, schema).join(a, "alias")
    met = hits.groupBy("chunk_id").agg(F.collect_list(F.struct("at", "words", "start", "end", "raw_name", "alias")).alias("spans"))
    return met.mapInArrow(settle, schema)


def resolve_mentions(spans: DataFrame, dictionary: DataFrame, threshold: float = 92.0) -> DataFrame:
    """spans (chunk_id, ord, raw_name, label, ...) linked and filtered, the first of each chunk and entity.

    Adds canonical_name, display_name, entity_type, ticker, link_method, link_score, mention_id. Names of at least two
    characters with one of LABELS: those that the dictionary (alias, canonical_name, display_name, entity_type, ticker)
    links, exactly or fuzzily; else persons of two words or more and known places, by their own names.
    """
    named = spans.where(F.col("label").isin(*LABELS) & (F.char_length(F.trim("raw_name")) >= 2)).withColumn("mention", X.canonical_name(F.col("raw_name")))
    linked = link_mentions(named, dictionary.select("alias"), threshold)
    known = dictionary.select(F.col("alias").alias("_alias"), *[F.col(c).alias(f"_{c}") for c in ("canonical_name", "display_name", "entity_type", "ticker")])
    rows = linked.join(known, F.col("alias") == F.col("_alias"), "left")
    own = ((F.col("label") == "PER") & I.is_prominent_person(F.col("mention"))) | ((F.col("label") == "LOC") & I.is_known_location(F.col("mention")))
    rows = rows.where(F.col("_alias").isNotNull() | own)
    out = rows.select(
        *spans.columns, F.coalesce("_canonical_name", "mention").alias("canonical_name"), F.coalesce("_display_name", F.trim("raw_name")).alias("display_name"),
        F.coalesce("_entity_type", "label").alias("entity_type"), F.col("_ticker").alias("ticker"), F.coalesce("link_method", F.lit("ner_heuristic")).alias("link_method"), "link_score",
    )
    first = top_per_key(out, ["chunk_id", "canonical_name"], [F.col("ord")])
    return first.withColumn("mention_id", X.stable_key(F.col("chunk_id").cast("string"), F.col("canonical_name")))


def extract_mentions(chunks: DataFrame, dictionary: DataFrame, people: DataFrame | None = None, least_chunks: int = 2, places: bool = True) -> DataFrame:
    """Mentions of chunks (chunk_id, text) by the dictionary's aliases, known `places` and `people` (alias): spans, links, filters.

    A person in fewer than least_chunks chunks goes. Adds start and end, characters of the text. See `gazetteer_spans`
    and `resolve_mentions`.
    """
    spark = chunks.sparkSession
    label = dictionary.select("alias", F.coalesce("entity_type", F.lit("ORG")).alias("label"), F.lit(0).alias("rank"))
    known = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in I.COUNTRIES + I.REGIONS])).alias("alias"), F.lit("LOC").alias("label"), F.lit(1).alias("rank"))
    rows = label.unionByName(known) if places else label
    if people is not None:
        rows = rows.unionByName(people.select("alias", F.lit("PER").alias("label"), F.lit(2).alias("rank")))
    rows = top_per_key(rows, ["alias"], [F.col("rank"), F.col("label")]).select("alias", "label")
    # spans and links are read several times below; each reading would walk all texts again
    spans = cut(gazetteer_spans(chunks, rows).join(rows, "alias").select("chunk_id", F.col("at").alias("ord"), "start", "end", "raw_name", "label"))
    found = cut(resolve_mentions(spans, dictionary))
    return drop_person_singletons(found.withColumn("entity_id", F.col("canonical_name")), least_chunks).drop("entity_id")


def entity_dictionary(companies: DataFrame, institutions: DataFrame) -> DataFrame:
    """(alias, canonical_name, display_name, entity_type, ticker): one entity an alias.

    companies: ord, ticker, company_name, aliases (parted by `;`); the last company that claims a form has it.
    institutions: ord, canonical_id, display_name, entity_type, ticker, aliases. Forms count with and without legal suffix.
    Of entities that share a form, one with a ticker stands before one without, then the longer display name, then the first.
    """
    parts = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    both = lambda c: F.array(X.canonical_name(c), X.canonical_name(X.strip_legal(c)))

    def forms(df: DataFrame, surface: Column) -> DataFrame:
        rows = df.select("*", F.posexplode(surface).alias("_at", "_form")).select("*", F.posexplode(both(F.col("_form"))).alias("_k", "alias"))
        return rows.where("alias <> ''").drop("_form")

    ticker = F.upper(F.trim(F.coalesce("ticker", F.lit(""))))
    c = companies.select("ord", ticker.alias("ticker"), F.trim("company_name").alias("display_name"), "aliases").where("ticker <> '' and display_name <> ''")
    names = c.groupBy("ticker").agg(F.max_by("display_name", "ord").alias("display_name"))
    claimed = forms(c, F.concat(F.array("display_name"), parts(F.col("aliases")))).groupBy("alias").agg(F.max_by("ticker", F.struct("ord", "_at", "_k")).alias("ticker"), F.min(F.struct("ord", "_at", "_k")).alias("met"))
    listed = claimed.join(names, "ticker").select(F.struct(F.lit(0).alias("t"), F.col("met.ord").cast("long").alias("ord"), F.col("met._at").alias("at"), F.col("met._k").alias("k")).alias("first"), "ticker", "display_name", F.array("alias", "ticker").alias("surface"))
    listed = listed.select("first", F.col("ticker").alias("canonical_name"), "display_name", F.lit("ORG").alias("entity_type"), "ticker", "surface")

    i = institutions.select("ord", F.trim(F.coalesce("canonical_id", F.lit(""))).alias("cid"), F.trim(F.coalesce("display_name", F.lit(""))).alias("name"), F.coalesce(F.nullif(F.upper(F.trim("entity_type")), F.lit("")), F.lit("ORG")).alias("entity_type"), F.nullif(ticker, F.lit("")).alias("ticker"), "aliases")
    key = F.coalesce("ticker", X.slug(X.canonical_name(F.coalesce(F.nullif("cid", F.lit("")), "name"))))
    i = i.withColumn("canonical_name", key).where("canonical_name <> ''")
    surface = F.concat(F.array("name", "cid"), F.when(F.col("ticker").isNotNull(), F.array("ticker")).otherwise(F.array().cast("array<string>")), parts(F.col("aliases")))
    other = i.select(F.struct(F.lit(1).alias("t"), F.col("ord").cast("long").alias("ord"), F.lit(0).alias("at"), F.lit(0).alias("k")).alias("first"), "canonical_name", F.coalesce(F.nullif("name", F.lit("")), "canonical_name").alias("display_name"), "entity_type", "ticker", surface.alias("surface"))
    rows = forms(listed.unionByName(other), F.col("surface"))
    order = [F.desc(F.coalesce("ticker", F.lit("")) != ""), F.desc(F.char_length("display_name")), F.col("first"), F.col("_at"), F.col("_k")]
    return top_per_key(rows, ["alias"], order).select("alias", "canonical_name", "display_name", "entity_type", "ticker")
