"""Pieces that several corpus operators share: word splitting, work folders, joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts spell it; a word is a maximal run of anything else.
WHITE_SPACE = r"[ \t-\r]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), "")


def single_spaced(text: Column) -> Column:
    """Every run of white space becomes one space; null counts as empty. The pattern skips spaces that stand alone, so
    almost no position of ordinary prose is rewritten."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?:[\t-\r]| (?=[ \t-\r]))[ \t-\r]*", " ")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def work_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. A cluster must name it in spark.checkpoint.dir; only a local session
    gets a folder of its own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if root:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(root)
        return root
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    root = tempfile.mkdtemp(prefix="lorekeep-")
    sc.setCheckpointDir(root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in a folder of its own that goes when the driver ends."""
    folder, sc = f"{work_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/data"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage; lost executors cost nothing after it."""
    work_root(df.sparkSession)
    return df.checkpoint(eager=True)


def unique_by(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """groupBy(keys).agg(aggs), partitioned so that a following join on the keys puts its own exchange above it. With
    an exchange on both sides of that join, adaptive execution can split a hot key of the other side."""
    spread = F.xxhash64(*keys).alias("_spread")
    if not aggs:
        return df.select(*keys, spread).distinct().drop("_spread")
    return df.groupBy(*keys, spread).agg(*aggs).drop("_spread")


def one_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each combination of keys (null is a value): the one whose columns, as strings, come first. What a task
    holds of a combination is one row, so a hot one costs nothing."""
    row, order = free_names(df, "_row_of_key", "_order_of_key")
    columns = [F.col(f"`{c}`") for c in df.columns]
    plain = F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    picked = df.select(*(F.col(f"`{k}`") for k in keys), F.struct(*columns).alias(row), plain.alias(order))
    return picked.groupBy(*(f"`{k}`" for k in keys)).agg(F.min_by(row, order).alias(row)).select(f"`{row}`.*")
