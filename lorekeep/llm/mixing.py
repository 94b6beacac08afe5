"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree [native].

Sizes are words. Sources, in code-point order and null last, get weights in turn; their targets share a multiple of all
sizes by weight, none above ``most`` times its source (the excess goes to the others by weight until none is above).
Within a source, documents follow each other in the order of a hash, and a block is what begins in a stretch of equally
many words of that stream: whole documents. A target is a quota of blocks: every block as often as the target holds its
source whole, then blocks in the order of a keyed permutation of their numbers, the last one cut to its words. The root
of the tree holds the quotas of all sources; a node deals its left child half of its blocks, drawn without replacement
from the urn of its quotas, and the rest to its right child. The leaves are the output shards: each draws the next
blocks of each source's permutation, as many as it was dealt, so their blocks are disjoint and exactly the quotas are
used; a document is in the mix only by a block that a leaf drew. Within a shard, blocks are shuffled by a hash, and
``mixed`` returns its documents shard by shard in that order.

Stream positions are prefix sums over hashed buckets, so a hot source is spread over its buckets and only their totals
meet; buckets and blocks grow with the corpus: a bucket has about ``BUCKET_ROWS`` rows, and the tree about ``BLOCKS``
blocks at any size. Shards become more with the corpus too, up to 2 ** ``LEVELS``. The tables that are handled in one
task have a row for each source, or each block. All draws come from hashes of a seed, so reruns agree.

Cases: null and empty texts have size 0 and are never taken; with no words at all every target is 0. Repeated rows are
rows of their own. Null is a source. Rows without an id are rows like others. A text of any length is taken whole, but
for the one document of each source in which its quota ends. Extra columns are ignored by ``draw`` and ``takes`` and
kept by ``mixed``, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import cut, free_names, work_path, words

#: Rows of a bucket, about; there are LEAST_BUCKETS of them at least.
BUCKET_ROWS = 1 << 16
LEAST_BUCKETS = 1024
BLOCKS = 1 << 18
LEAST_BLOCK = 256
#: Words of a shard, about, and the least and most levels of the tree.
SHARD_WORDS = 1 << 27
LEVELS = (6, 14)


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """_row, doc_id, source, size, and the hash that orders a source."""
    row = F.col("_row") if "_row" in docs.columns else F.monotonically_increasing_id()
    size = F.size(words(F.col("text"))).cast("long")
    return docs.select(row.alias("_row"), F.col("doc_id").cast("long"), "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "source").alias("_hash"))


def targets(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """sized documents -> a row for each source: rank (from 0), source_size, target, and the words of a block.

    Filling by weight: with sources in the order of size to weight, the level is what is left of the budget over what
    is left of the weights, and the largest such level is the one at which no source is above its limit."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_limit") / F.col("_weight"), "rank")
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    out = out.withColumn("rank", F.row_number().over(by_name) - 1)
    out = out.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    out = out.withColumn("_limit", most * F.col("source_size")).withColumn("_budget", share * F.sum("source_size").over(every))
    out = out.withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_limit").over(before), F.lit(0))) / F.sum("_weight").over(onward))
    out = out.withColumn("target", F.least(F.col("_limit").cast("double"), F.max("_level").over(every) * F.col("_weight")))
    block = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col("_budget") / BLOCKS)).cast("long")
    return out.select("source", "rank", "source_size", "target", F.round("target").cast("long").alias("quota"), block.alias("block_words"))


def _urn(count: Column, n: Column, total: Column, *salt: Column) -> Column:
    """Of n draws without replacement from total, how many are among count: one of the two is drawn one by one."""
    draws, marked = F.least(count, n), F.greatest(count, n)

    def step(hits: Column, j: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(*salt, j), 11) / float(1 << 53)
        return hits + (u * (total - j + 1) < marked - hits).cast("long")

    return F.when(draws > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), draws), F.lit(0).cast("long"), step)).otherwise(F.lit(0).cast("long"))


def _deal(counts: Column, node: Column, seed: int) -> Column:
    """The counts that the left child gets: half of the blocks, source after source."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    zero = F.struct(F.array().cast("array<bigint>").alias("got"), total.alias("total"), F.floor(total / 2).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        hit = F.struct(_urn(x["c"], acc["n"], acc["total"], F.lit(seed), node, x["i"]).alias("h"))
        return F.transform(F.array(hit), lambda h: F.struct(F.concat(acc["got"], F.array(h["h"])).alias("got"), (acc["total"] - x["c"]).alias("total"), (acc["n"] - h["h"]).alias("n")))[0]

    return F.aggregate(F.transform(counts, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), zero, step, lambda acc: acc["got"])


def shards(sources: DataFrame, levels: int, seed: int) -> DataFrame:
    """rank, block, shard: the leaf that takes each block of each source's stream."""
    blocks = F.ceil(F.col("quota") / F.col("block_words")).cast("long")
    root = sources.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", blocks.alias("n")))), lambda x: x["n"]).alias("counts"))
    tree = root.select(F.lit(0).cast("long").alias("node"), "counts")
    for level in range(levels):
        tree = tree.withColumn("left", _deal(F.col("counts"), F.col("node"), seed + level))
        right = F.zip_with("counts", "left", lambda a, b: a - b)
        both = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("counts")), F.struct((2 * F.col("node") + 1).alias("node"), right.alias("counts")))
        tree = tree.select(F.explode(both).alias("child")).select("child.*")
    dealt = tree.select(F.col("node").cast("int").alias("shard"), F.posexplode("counts").alias("rank", "n"))
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).where("n > 0")
    return dealt.select("rank", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("block"))


def _drawn(units: DataFrame, sources: DataFrame, levels: int, seed: int) -> DataFrame:
    """units: the sum of words of each block of each source, with its begin. -> rank, block, begin, pass, words (that the
    mix takes of it, from its begin), shard: the blocks that the leaves draw."""
    number = F.col("block")
    units = units.join(sources.select("rank", "quota", "most"), "rank").select("*", F.explode(F.sequence(F.lit(0), F.col("most") - 1)).alias("pass"))
    permuted = Window.partitionBy("rank").orderBy("pass", F.xxhash64(F.lit(seed), "rank", "pass", number), number)
    before = F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = units.withColumn("_before", before).where("_before < quota")
    chosen = chosen.withColumn("words", F.least("words", F.col("quota") - F.col("_before"))).drop("_before", "most", "quota")
    order = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(~seed), "rank", "pass", number), "pass", number)
    chosen = cut(chosen.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long")))
    quotas = sources.select("rank").join(chosen.groupBy("rank").agg(F.count("*").alias("quota")), "rank", "left").select("rank", F.coalesce("quota", F.lit(0)).cast("long").alias("quota"), F.lit(1).cast("long").alias("block_words"))
    leaves = shards(quotas, levels, seed).withColumnRenamed("block", "ordinal")
    return chosen.join(leaves, ["rank", "ordinal"]).drop("ordinal")


def draw(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, levels: int | None = None, seed: int = 20) -> DataFrame:
    """A row for each pass of the mix over a document: _row, doc_id, size, source_size, target, rank, pass (from 0),
    block, shard (of 2 ** levels), first (word of the document, 0) and taken (words); documents that the mix leaves out
    have one row with null pass and shard and taken 0."""
    docs = cut(sized(docs, seed))
    sources = cut(targets(docs, weights, share, most)).withColumn("most", F.lit(most))
    rows, all_words = docs.agg(F.count("*"), F.sum("size")).first()
    buckets = max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
    if levels is None:
        levels = min(max(LEVELS[0], math.ceil(math.log2(max(1, share * (all_words or 0) / SHARD_WORDS)))), LEVELS[1])
    bucket = F.pmod(F.col("_hash"), F.lit(buckets)).alias("_bucket")
    sums = docs.groupBy("source", bucket).agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    known = sums.join(sources.drop("most"), sums["_source"].eqNullSafe(sources["source"])).drop("source")

    within = Window.partitionBy("source", "_bucket").orderBy("_hash", "doc_id", "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("_bucket", bucket).withColumn("_start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(known, placed["source"].eqNullSafe(known["_source"]) & (placed["_bucket"] == known["_b"]))
    placed = placed.withColumn("_start", F.col("_start") + F.col("_before"))
    spread = -1 - F.pmod(F.xxhash64("_row"), F.lit(4096))  # documents without words are in no block
    placed = placed.withColumn("block", F.when(F.col("size") > 0, F.floor(F.col("_start") / F.col("block_words"))).otherwise(spread))
    placed = cut(placed.select("_row", "doc_id", "size", "source_size", "target", "rank", "_start", "block"))

    units = placed.where("size > 0").groupBy("rank", "block").agg(F.sum("size").alias("words"), F.min("_start").alias("begin"))
    parts = placed.join(_drawn(units, sources, levels, seed), ["rank", "block"], "left")
    taken = F.greatest(F.lit(0), F.least("size", F.col("words") - (F.col("_start") - F.col("begin"))))
    parts = parts.withColumn("taken", F.when(F.col("shard").isNotNull(), taken).otherwise(0).cast("long"))
    cols = ["_row", "doc_id", "size", "source_size", "target", "rank", "pass", "block", "shard", "first", "taken"]
    # Read twice by those that give the taken rows a position, so it is kept.
    return cut(parts.withColumn("first", F.lit(0).cast("long")).select(*cols))


def _order(seed: int) -> list[Column]:
    """Of the documents of a shard: their blocks by a hash, then as they follow each other."""
    return [F.xxhash64(F.lit(seed), "rank", "pass", "block"), F.col("rank"), F.col("pass"), F.col("block"), F.xxhash64(F.lit(~seed), "_row"), F.col("_row")]


def shuffled(parts: DataFrame, seed: int = 20) -> DataFrame:
    """parts of ``draw`` that the mix takes, with their position in their shard."""
    order = Window.partitionBy("shard").orderBy(*_order(seed))
    return parts.where("taken > 0").withColumn("position", F.row_number().over(order) - 1)


def takes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: what the mix takes of each document; and places: pass:shard:position of
    each pass over it, joined by commas."""
    parts = draw(docs, **options)
    rows = shuffled(parts).unionByName(parts.where("taken = 0").withColumn("position", F.lit(None).cast("int")))
    passes = F.array_sort(F.collect_list(F.when(F.col("taken") > 0, F.struct("pass", "shard", "position"))))  # as many as there are passes
    places = F.array_join(F.transform(passes, lambda x: F.concat_ws(":", x["pass"], x["shard"], x["position"])), ",")
    return rows.groupBy("_row", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"), places.alias("places")).drop("_row")


def mixed(docs: DataFrame, seed: int = 20, **options) -> DataFrame:
    """The mix as documents, shard by shard in shuffled order: a row for each pass over a document, whole but for the one
    of each source that its quota ends in, which keeps its first words, single-spaced."""
    row, size, taken, shard, *order = free_names(docs, "_row", "_size", "_taken", "_shard", *(f"_order{i}" for i in range(6)))
    path = work_path(docs.sparkSession, "mix")
    docs.withColumn(row, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    docs = docs.sparkSession.read.parquet(path)
    source = [F.col(f"`{c}`") for c in ("doc_id", "source", "text")]
    parts = draw(docs.select(F.col(f"`{row}`").alias("_row"), *source), seed=seed, **options).where("taken > 0")
    places = parts.select(F.col("_row").alias(row), F.col("size").alias(size), F.col("taken").alias(taken), F.col("shard").alias(shard), *(c.alias(n) for c, n in zip(_order(seed), order, strict=True)))
    out = docs.join(places, row)
    out = out.repartition(shard).sortWithinPartitions(shard, *order)
    whole = F.col(taken) == F.col(size)
    changed = {"text": F.when(whole, F.col("text")).otherwise(F.array_join(F.slice(words(F.col("text")), 1, F.col(taken).cast("int")), " "))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(changed["text"]).cast(docs.schema["n_chars"].dataType))
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns if c != row))
