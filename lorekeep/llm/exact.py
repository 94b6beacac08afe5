"""Exact deduplication by deterministic block naming [native].

Normalised texts are cut into blocks of a fixed number of bytes. The distinct blocks are sorted and numbered, so equal
blocks, and no others, have the same integer name. Adjacent names are then paired and the distinct pairs numbered in
the same way, level by level, until each document has one name: equal names at an equal number of blocks mean equal
texts, without any hash standing for a text.

Block bytes are shuffled once and only after map-side elimination of copies, so a group of copies costs each task one
block. Occurrences find their name through a pair of 64-bit keys that is first verified to be different for every two
distinct blocks of the corpus; were it not, other seeds are taken. All later levels are integers. Joins to names are
laid out so that adaptive execution can split a hot name.

Distinct blocks stay in the hash partitions that found them distinct, are sorted there, and numbered partition after
partition: sorting them all by ranges would shuffle their bytes again. Which integers they get so depends on the number
of partitions; whether two names are equal, and so every result, does not.

Cases: null counts as the empty text, and white-space runs as one space. Of equal texts the smallest doc_id stays (ids
that are null only if all are). Rows repeated with one id and equal texts count in group_size and come out as one row;
one id with different texts gives a row for each. ``dedup`` keeps one row of those with the id that stays: the one whose
columns, as strings, come first. A text of any length is as many blocks as it needs. An empty table gives no rows. Extra
columns are ignored by ``groups`` and carried by ``dedup``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import cut, free_names, one_of_each, single_spaced, unique_by

BLOCK_BYTES = 16384


def _keys(block, seed: int):
    return F.struct(F.xxhash64(F.lit(seed), block).alias("k1"), F.xxhash64(F.lit(~seed), block).alias("k2"))


def _numbered(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Sorted within their partitions and numbered across them."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def names(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text_sha256, copies (rows repeated), n_blocks, name: one row for each document and text."""
    text = single_spaced(F.col("text"))
    data = text.cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("_text") / block_bytes)).cast("int")
    cutting = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("_text"), i * block_bytes + 1, F.lit(block_bytes)))
    blocks = docs.select(F.col("doc_id").cast("long"), data.alias("_text")).withColumn("_blocks", cutting)

    seed = 42
    while True:
        distinct = blocks.select(F.explode("_blocks").alias("block")).distinct()
        named = cut(_numbered(distinct, ["block"]).select(_keys(F.col("block"), seed).alias("k"), "name").select("k.*", "name"))
        if named.groupBy("k1", "k2").count().where("count > 1").isEmpty():
            break
        seed += 1  # two blocks share both keys

    keyed = blocks.select("doc_id", F.sha2("_text", 256).alias("text_sha256"), F.posexplode(F.transform("_blocks", lambda b: _keys(b, seed))).alias("pos", "k"))
    found = keyed.select("doc_id", "text_sha256", "pos", "k.*").join(named, ["k1", "k2"])
    level = cut(_rows(found, F.sum((F.col("pos") == 0).cast("long")).alias("copies")).withColumn("n_blocks", F.size("names")))
    done = []
    while True:
        done.append(level.where("size(names) = 1").withColumn("name", F.col("names")[0]).drop("names"))
        rest = level.where("size(names) > 1")
        if rest.isEmpty():
            break
        half = F.transform(F.sequence(F.lit(0), F.ceil(F.size("names") / 2).cast("int") - 1), lambda i: F.struct(F.get("names", 2 * i).alias("a"), F.coalesce(F.get("names", 2 * i + 1), F.lit(-1)).alias("b")))
        pairs = rest.select("doc_id", "text_sha256", "copies", "n_blocks", F.posexplode(half).alias("pos", "p")).select("*", "p.a", "p.b").drop("p")
        named = _numbered(unique_by(pairs, ["a", "b"]), ["a", "b"])
        level = cut(_rows(pairs.join(named, ["a", "b"]), F.first("copies").alias("copies"), F.first("n_blocks").alias("n_blocks")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _rows(found: DataFrame, *more) -> DataFrame:
    """The names of a document in order; a text has as many as its length gives, whatever its copies are."""
    ordered = F.transform(F.array_sort(F.collect_set(F.struct("pos", "name"))), lambda x: x["name"])
    return found.groupBy("doc_id", "text_sha256").agg(ordered.alias("names"), *more)


def groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document."""
    return _grouped(names(docs, block_bytes)).drop("copies")


def _grouped(named: DataFrame) -> DataFrame:
    best = unique_by(named, ["n_blocks", "name"], F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    return named.join(best, ["n_blocks", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "copies")


def dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each text: the one with the least id."""
    found = cut(_grouped(names(docs)))
    sha, id_, text = free_names(docs, "_sha", "_id", "_text")
    keyed = docs.withColumn(sha, F.sha2(single_spaced(F.col("text")), 256))
    same = lambda marks: keyed["doc_id"].cast("long").eqNullSafe(marks[id_]) & (keyed[sha] == marks[text])
    marks = lambda condition: found.where(condition).select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(text))
    gone, repeated = marks(~F.col("kept")), marks(F.col("kept") & (F.col("copies") > 1))
    kept = keyed.join(gone, same(gone), "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if repeated.isEmpty():
        return kept.select(*columns)
    once = kept.join(repeated, same(repeated), "left_anti").select(*columns)
    return once.unionByName(one_of_each(kept.join(repeated, same(repeated), "left_semi"), ["doc_id", sha]).select(*columns))
