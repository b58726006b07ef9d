"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over blocks of documents.

All of it is DataFrame operations. Documents of a source are dealt into blocks by a hash of id and text; a source's tape
is its blocks in permuted order, repeated at most `max_passes` times, and its quota is the tape's first `floor(target)`
words. The quotas, in blocks, are split among output shards by a binary tree whose every node draws the left half's
counts from the multivariate hypergeometric distribution; a shard then takes disjoint runs of each source's permuted
blocks, and `write_mix` shuffles rows within a shard. The tree decides where a block goes, the permutation which blocks
are drawn.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.common import join_small, staged

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Blocks under one step of the two-level running sums.
SUPER = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_passes: int = 2) -> DataFrame:
    """One row per source of (source, source_size, n_docs): adds sid, weight and target.

    Sources by code point, null last, take the weights in turn. `share` times all sizes is dealt by weight up to
    max_passes times each size; what is above a limit is dealt again by weight, which ends at
    target = min(limit, level * weight) with one level for all: found by running sums in the order limit / weight.
    The windows hold one row per source, as does the array of quotas that the tree splits: sources are few beside documents.
    """
    byname = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("sid", F.row_number().over(byname) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    room = (F.col("source_size") * max_passes).cast("double")
    whole = Window.partitionBy()
    ranked = ranked.withColumns({"weight": w, "room": room})
    ranked = ranked.withColumns({"ratio": F.col("room") / F.col("weight"), "budget": F.sum("source_size").over(whole) * F.lit(float(share))})
    order = Window.orderBy("ratio", "sid")
    before = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", (F.col("budget") - before) / after)
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(whole)
    ranked = ranked.withColumn("found", found["level"])
    target = F.least(F.col("room"), F.coalesce(F.greatest(F.col("found"), F.lit(0.0)) * F.col("weight"), F.col("room")))
    return ranked.withColumn("target", target).select("source", "sid", "n_docs", "source_size", "weight", "target")


def _log_factorial(x: str) -> str:
    return f"(if({x} <= 20, ln(double(factorial(int(least({x}, 20L))))), {x} * ln(double({x})) - {x} + 0.5D * ln(6.283185307179586D * {x}) + 1D / (12D * {x}) - 1D / (360D * {x} * {x} * {x})))"


def hypergeometric(total: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL for a hypergeometric draw: inverse distribution over the window of 9 deviations round the mode.

    Beyond the window lies less than 1e-15 of the mass; a uniform that falls there takes the window's last value.
    """
    lf = _log_factorial
    lo = f"greatest(0L, {drawn} - ({total} - {marked}))"
    hi = f"least({marked}, {drawn})"
    mode = f"bigint(floor(double({drawn} + 1) * double({marked} + 1) / double({total} + 2)))"
    reach = f"bigint(16 + 9 * sqrt(double({drawn}) * {marked} / greatest(1L, {total})))"
    const = f"({lf(marked)} + {lf(f'({total} - {marked})')} + {lf(drawn)} + {lf(f'({total} - {drawn})')} - {lf(total)})"
    p = f"exp({const} - {lf('x')} - {lf(f'({marked} - x)')} - {lf(f'({drawn} - x)')} - {lf(f'({total} - {marked} - {drawn} + x)')})"
    first, last = f"greatest({lo}, {mode} - {reach})", f"least({hi}, {mode} + {reach})"
    step = f"named_struct('cum', s.cum + if(s.cum > {uniform}, 0D, {p}), 'at', if(s.cum > {uniform}, s.at, x))"
    return f"aggregate(sequence({first}, {last}), named_struct('cum', 0D, 'at', {lo}), (s, x) -> {step}, s -> s.at)"


def split_quotas(root: DataFrame, shards: int, total: int, seed: int) -> DataFrame:
    """(shard, counts): root has one row, counts array<long>, the block quota of each source. Level by level, a node's
    blocks go to its halves by multivariate-hypergeometric draws; sums over shards equal the root exactly."""
    node = root.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "counts")
    for level in range(max(0, math.ceil(math.log2(max(1, shards))))):
        node = node.withColumn("mid", F.expr("(lo + hi) div 2"))
        node = node.withColumn("need", F.expr(f"bigint(floor(mid * {total}D / {shards})) - bigint(floor(lo * {total}D / {shards}))"))
        u = f"(pmod(xxhash64({seed}L, lo, hi, size(a.out)), 9007199254740992L) / 9007199254740992D)"
        draw = hypergeometric("a.n", "c", "a.need", u)
        left = f"""aggregate(counts, named_struct('n', aggregate(counts, 0L, (t, c) -> t + c), 'need', need, 'out', cast(array() as array<bigint>)),
            (a, c) -> named_struct('n', a.n - c, 'need', a.need - {draw}, 'out', concat(a.out, array({draw}))), a -> a.out)"""
        node = node.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, F.expr(left)))
        node = node.selectExpr("""explode(if(left is null, array(named_struct('lo', lo, 'hi', hi, 'counts', counts)),
            array(named_struct('lo', lo, 'hi', mid, 'counts', left), named_struct('lo', mid, 'hi', hi, 'counts', zip_with(counts, left, (c, l) -> c - l))))) as n""").select("n.*")
        if level == 8:
            node = node.repartition("lo")
    return node.select(F.col("lo").alias("shard"), "counts")


def _tape(docs_per_block: int, seed: int) -> tuple[Column, Column, Column]:
    """The block of a row by its source's n_docs and its hash h; the block's turn by sid and block; its part of the tape by its turn and n_docs."""
    block = F.pmod("h", F.ceil(F.col("n_docs") / docs_per_block))
    return block, F.xxhash64("sid", "block", F.lit(seed)), F.pmod("turn", F.ceil(F.col("n_docs") / (docs_per_block * SUPER)))


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_passes: int = 2, docs_per_block: int = 64, blocks_per_shard: int = 64, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, row_key, source, size, source_size, target, draws, sid, n_docs, taken), one row per input row.

    draws: array of (pass, shard, words), the passes in which the document's block was drawn and the words taken then;
    taken: their words; row_key: `row_key` of id and text; sid, n_docs: the source's number and rows. Null or blank texts have size 0 and take no words; a null
    source is a source, last in order; rows that repeat an id are documents of their own; an empty table gives an empty
    result; extra columns are not read. A source's taken words equal floor(target) exactly. The same input gives the same rows.
    """
    spark = docs.sparkSession
    sized = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row_key(id_col, text_col).alias("row_key")), "sized")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    src = staged(source_targets(sums, weights, share, max_passes), "sources")
    h = F.xxhash64("row_key", F.lit(seed))
    near = src.select(F.col("source").alias("_source"), "sid", "n_docs", "source_size", "target")
    keyed = join_small(sized.withColumn("h", h), near, F.col("source").eqNullSafe(F.col("_source")), F.col("h"), "source", "_source").drop("_source")
    block, turn, sup = _tape(docs_per_block, seed)
    keyed = keyed.withColumn("block", block)

    blocks = keyed.groupBy("sid", "block", "source_size", "target", "n_docs").agg(F.sum("size").alias("words")).withColumn("turn", turn)
    blocks = staged(blocks.withColumn("sup", sup), "blocks")
    before = Window.partitionBy("sid").orderBy("sup").rowsBetween(Window.unboundedPreceding, -1)
    sup = blocks.groupBy("sid", "sup").agg(F.sum("words").alias("w"), F.count("*").alias("k"))
    sup = sup.select("sid", "sup", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"), F.sum("k").over(Window.partitionBy("sid")).alias("n_blocks"))
    inner = Window.partitionBy("sid", "sup").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(sup, ["sid", "sup"]).select(
        "sid", "block", "source_size", "target", "n_blocks",
        (F.col("w0") + F.coalesce(F.sum("words").over(inner), F.lit(0))).alias("start"),
        (F.col("k0") + F.coalesce(F.count("*").over(inner), F.lit(0))).alias("ordinal"),
    )
    passes = F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1))).alias("pass")
    reach = F.greatest(F.lit(0), F.least(F.floor("target") - F.col("pass") * F.col("source_size"), F.col("source_size")))
    draws = blocks.select("*", passes).withColumn("reach", reach)
    draws = draws.where((F.col("reach") > 0) & ((F.col("start") < F.col("reach")) | (F.col("reach") == F.col("source_size"))))
    draws = staged(draws.select("sid", "block", "start", "reach", "pass", (F.col("pass") * F.col("n_blocks") + F.col("ordinal")).alias("k")), "draws")

    quotas = draws.groupBy("sid").agg(F.count("*").alias("quota"))
    total = draws.count()
    shards = max(1, math.ceil(total / blocks_per_shard))
    root = quotas.agg(F.sort_array(F.collect_list(F.struct("sid", "quota"))).alias("q"))
    counts = split_quotas(root.select("q", F.transform("q", lambda x: x["quota"]).alias("counts")).select("counts"), shards, total, seed)
    sids = root.select(F.posexplode("q").alias("i", "s")).select("i", F.col("s.sid").alias("sid"), F.col("s.quota").alias("quota"))
    runs = counts.select("shard", F.posexplode("counts").alias("i", "n"))
    runs = runs.withColumn("k0", F.sum("n").over(Window.partitionBy("i").orderBy("shard")) - F.col("n")).where("n > 0")
    runs = runs.join(sids, "i").select("sid", F.col("shard").cast("int").alias("shard"), F.explode(F.sequence(F.col("k0"), F.col("k0") + F.col("n") - 1)).alias("k"))
    placed = draws.join(runs, ["sid", "k"]).groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "start", "reach"))).alias("plan"))
    placed = staged(placed, "placed").withColumnsRenamed({"sid": "psid", "block": "pblock"})

    inside = Window.partitionBy("sid", "block").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(placed, (F.col("sid") == F.col("psid")) & (F.col("block") == F.col("pblock")), "left")
    words = lambda d: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), d["reach"] - d["start"] - F.col("before")))
    drawn = F.transform(F.coalesce("plan", F.array().cast("array<struct<pass:int,shard:int,start:bigint,reach:bigint>>")), lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), words(d).alias("words")))
    out = out.select("doc_id", "row_key", "source", "size", "source_size", "target", drawn.alias("draws"), "sid", "n_docs")
    return out.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]))


def row_key(id_col: str, text_col: str) -> Column:
    """The key of a row by its id and text."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.lit(29))


def drawn_rows(docs: DataFrame, mix: DataFrame, docs_per_block: int = 64, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The columns of docs and mix_pass: the rows of `mixed_rows` without their shards, in whose making no text is shuffled.

    docs_per_block and seed are those of `mix_sources`. A pass draws a source's tape up to a place, so that one place a source
    and pass says of each row whether it is drawn. Rows of one source that repeat id and text are drawn alike, as the one
    drawn most.
    """
    if clash := {"mix_pass", "sid", "n_docs", "h", "block", "turn", "sup", "_source", "_cuts", "_cut"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are taken")
    block, turn, sup = _tape(docs_per_block, seed)

    def placed(rows: DataFrame, key: Column) -> DataFrame:
        return rows.withColumn("h", F.xxhash64(key, F.lit(seed))).withColumn("block", block).withColumn("turn", turn).withColumn("sup", sup)

    place = lambda row_id: F.struct("sup", "turn", "block", "h", F.col(row_id).alias("id"))
    whole = F.filter("draws", lambda d: (d["words"] > 0) & (d["words"] * 2 >= F.col("size")))
    drawn = placed(mix, F.col("row_key")).select("source", "sid", "n_docs", place("doc_id").alias("place"), F.explode(whole).alias("d"))
    cuts = drawn.groupBy("source", "sid", "n_docs", "d.pass").agg(F.max("place").alias("cut"))
    cuts = cuts.groupBy(F.col("source").alias("_source"), "sid", "n_docs").agg(F.collect_list(F.struct("pass", "cut")).alias("_cuts"))
    rows = docs.where(F.col(text_col).rlike(WORD))
    key = row_key(id_col, text_col)
    rows = placed(join_small(rows, staged(cuts, "cuts"), F.col(source_col).eqNullSafe(F.col("_source")), F.xxhash64(key), source_col, "_source"), key)
    rows = rows.withColumn("_cut", F.explode(F.filter("_cuts", lambda c: place(id_col) <= c["cut"])))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_cut.pass").alias("mix_pass"))


def mixed_rows(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, mix_shard and mix_pass: a row for each pass that draws at least half of a document's words.

    A source is cut inside one document of a pass at most, so its words come within half a document of its target.
    Documents without words are never drawn. Rows that repeat id and text are drawn alike, as the one drawn most.
    """
    if clash := {"mix_shard", "mix_pass", "_key"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are taken")
    whole = F.filter("draws", lambda d: (d["words"] > 0) & (d["words"] * 2 >= F.col("size")))
    drawn = mix.select(F.col("row_key").alias("_key"), whole.alias("_draws")).where(F.size("_draws") > 0)
    drawn = drawn.groupBy("_key").agg(F.max_by("_draws", F.struct(F.size("_draws"), "_draws")).alias("_draws"))
    rows = docs.withColumn("_key", row_key(id_col, text_col)).join(drawn, "_key").withColumn("_d", F.explode("_draws"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_d.shard").alias("mix_shard"), F.col("_d.pass").alias("mix_pass"))


def write_mix(docs: DataFrame, mix: DataFrame, path: str, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes `mixed_rows`, a folder per shard, rows of a shard in a shuffled order that reruns repeat."""
    rows = mixed_rows(docs, mix, id_col, text_col).withColumn("_order", F.xxhash64(row_key(id_col, text_col), "mix_pass", F.lit(seed)))
    rows.repartition("mix_shard").sortWithinPartitions("mix_shard", "_order").drop("_order").write.partitionBy("mix_shard").parquet(path)
