"""Hashes, ledgers and declared constraints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("at", "actor", "action", "target", "detail", "receipt", "undo")
SEPARATOR = "\x1f"


def row_digest(columns: list[Column], bits: int = 512) -> Column:
    """Nulls are empty strings: concat_ws would skip them."""
    return F.sha2(F.concat_ws(SEPARATOR, *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), bits)


def manifest(files: DataFrame, bits: int = 512) -> DataFrame:
    """files (name, digest) -> one row, manifest: the digest of sorted lines."""
    line = F.concat_ws("\t", "name", "digest")
    lines = F.array_sort(F.collect_list(F.concat(line, F.lit("\n"))))
    return files.agg(F.sha2(F.array_join(lines, ""), bits).alias("manifest"))


def chain(rows: DataFrame, bits: int = 512) -> DataFrame:
    """rows (seq, FIELDS) with prev and hash. A hash chain is sequential by definition: one task walks the sorted rows of
    a ledger of people's actions, a row at a time. Verifying is parallel."""
    import hashlib

    digest = {256: hashlib.sha256, 512: hashlib.sha512}[bits]
    fields = F.concat_ws(SEPARATOR, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS))

    def walk(frames):
        last = "0" * (bits // 4)
        for f in frames:
            prev, hashes = [], []
            for text in f["f"]:
                prev.append(last)
                last = digest((last + SEPARATOR + text).encode()).hexdigest()
                hashes.append(last)
            yield pd.DataFrame({"seq": f["seq"], "prev": prev, "hash": hashes})

    ordered = rows.select(F.col("seq").cast("long").alias("seq"), fields.alias("f")).repartition(1).sortWithinPartitions("seq", "f")
    return rows.join(ordered.mapInPandas(walk, "seq long, prev string, hash string"), "seq")


def verify_chain(ledger: DataFrame, bits: int = 512) -> DataFrame:
    """seq, problem of the rows that do not follow from the row before or from their own fields. The row before is found
    within ranges of seq, and at their edges from one row for each range."""
    ranged = ledger.repartitionByRange("seq").withColumn("_range", F.spark_partition_id())
    ends = ranged.groupBy("_range").agg(F.max_by("hash", "seq").alias("_end"))
    edge = ends.withColumn("_edge", F.coalesce(F.lag("_end").over(Window.orderBy("_range")), F.lit("0" * (bits // 4)))).drop("_end")  # a row a range
    inside = F.lag("hash").over(Window.partitionBy("_range").orderBy("seq"))
    rows = ranged.withColumn("_inside", inside).join(F.broadcast(edge), "_range").withColumn("_before", F.coalesce("_inside", "_edge"))
    want = F.sha2(F.concat_ws(SEPARATOR, F.coalesce("prev", F.lit("")), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS)), bits)
    problem = F.when(~F.col("prev").eqNullSafe(F.col("_before")), "broken link").when(~F.col("hash").eqNullSafe(want), "changed row")
    return rows.select("seq", problem.alias("problem")).where("problem is not null")


def table_stats(frames: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in frames.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """check, key, detail of keys that occur more than once."""
    rows = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return rows.select(F.lit(name).alias("check"), F.concat_ws("|", *keys).alias("key"), F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"))


def holds(df: DataFrame, keys: list[str], condition: Column, name: str) -> DataFrame:
    """check, key, detail of rows that break a condition."""
    return df.where(~F.coalesce(condition, F.lit(False))).select(F.lit(name).alias("check"), F.concat_ws("|", *keys).alias("key"), F.lit("condition does not hold").alias("detail"))


def not_deleted(before: DataFrame, after: DataFrame, key: str, name: str) -> DataFrame:
    """What a later snapshot no longer has, though rows are only ever deprecated."""
    gone = before.select(key).join(after.select(key), key, "left_anti")
    return gone.select(F.lit(name).alias("check"), F.col(key).cast("string").alias("key"), F.lit("deleted").alias("detail"))


def claim_constraints(claims: DataFrame) -> DataFrame:
    """A known value is either an object or a literal."""
    xor = (F.col("snak_type") != "value") | (F.col("object").isNull() != F.col("value").isNull())
    return holds(claims, ["claim_id"], xor, "claim has one value")
