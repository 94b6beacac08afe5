"""Coverage and bias audits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.stats import nearest_rank, representation, wilson


def shares(members: DataFrame) -> DataFrame:
    """members (id, grp) -> grp, weight, share: each id counts 1, split over its distinct groups."""
    rows = members.distinct()
    per = F.count("*").over(Window.partitionBy("id"))
    weights = rows.withColumn("_w", 1 / per).groupBy("grp").agg(F.sum("_w").alias("weight"))
    total = rows.agg(F.countDistinct("id").alias("n"))
    return weights.crossJoin(F.broadcast(total)).select("grp", "weight", (F.col("weight") / F.col("n")).alias("share"), "n")  # total: one row


def representations(members: DataFrame, baseline: DataFrame) -> DataFrame:
    """shares against baseline (grp, base): share, Wilson interval, ratio and its logarithm; groups of either side."""
    total = members.agg(F.countDistinct("id").alias("_n"))
    base = baseline.withColumn("base", F.col("base") / F.sum("base").over(Window.partitionBy()))
    both = shares(members).drop("n").join(base, "grp", "full").crossJoin(F.broadcast(total))  # total: one row
    share = F.coalesce("share", F.lit(0.0))
    low, high = wilson(share, F.col("_n"))
    ratio, log = representation(share, F.col("base"))
    return both.select("grp", share.alias("share"), low.alias("low"), high.alias("high"), "base", ratio.alias("ratio"), log.alias("log2_ratio"))


def parity(values: DataFrame) -> DataFrame:
    """values (parent, child, v): for parents of two or more children n, mean, population deviation, variation, ratio
    of extremes where all are positive."""
    v = F.col("v").cast("double")
    out = values.groupBy("parent").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("_a"), F.max(v).alias("_b")).where("n >= 2")
    return out.select("parent", "n", "mean", "sd", F.when(F.col("mean") != 0, F.col("sd") / F.col("mean")).alias("cv"), F.when(F.col("_a") > 0, F.col("_b") / F.col("_a")).alias("ratio"))


def outsized(values: DataFrame) -> DataFrame:
    """Children with at least four, and three times the median of their siblings (at least 1)."""
    middle = values.groupBy("parent").agg(F.median("v").alias("_m"))
    return values.join(middle, "parent").where((F.col("v") >= 4) & (F.col("v") >= 3 * F.greatest(F.col("_m"), F.lit(1.0)))).select("parent", "child", "v")


def thinnest(df: DataFrame, value: str, id_: str, n: int = 25) -> DataFrame:
    return df.orderBy(value, id_).limit(n)


def coverage(members: DataFrame) -> DataFrame:
    """members (root, id, value): per root the size, how many have a value, their median, and the least with its id."""
    has = F.col("value").isNotNull()
    return members.groupBy("root").agg(
        F.count("*").alias("n"), F.sum(has.cast("long")).alias("n_with"), F.median("value").alias("median"), F.min(F.when(has, F.struct("value", "id")))["id"].alias("least")
    )


def null_model(members: DataFrame, baseline: DataFrame, reps: int = 2000, seed: int = 1) -> DataFrame:
    """grp, low, high: the shares that chance alone gives at the baseline, as nearest-rank bounds. Only the number of
    ids and the baseline go into the draw; replicates are rows, so they are dealt over tasks."""
    n = members.agg(F.countDistinct("id").alias("n"))
    groups = baseline.agg(F.sort_array(F.collect_list(F.struct("grp", "base"))).alias("g"))
    draws = baseline.sparkSession.range(reps).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(groups))  # one row each

    def draw(frames):
        import numpy as np

        for f in frames:
            out = []
            for rep, count, g in zip(f["id"], f["n"], f["g"], strict=True):
                p = np.array([x["base"] for x in g], float)
                k = np.random.default_rng([seed, int(rep)]).multinomial(int(count), p / p.sum())
                out += [(x["grp"], float(c) / max(int(count), 1)) for x, c in zip(g, k, strict=True)]
            yield pd.DataFrame(out, columns=["grp", "share"])

    sampled = draws.mapInPandas(draw, "grp string, share double")
    return sampled.groupBy("grp").agg(nearest_rank(F.col("share"), 0.025).alias("low"), nearest_rank(F.col("share"), 0.975).alias("high"))


def long_rows(metrics: dict[str, DataFrame]) -> DataFrame:
    """metric, key, measure, value: an audit's frames (key first, then numbers) as rows that can be stored and compared."""
    out = None
    for name, df in metrics.items():
        key, *measures = df.columns
        cells = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))
        part = df.select(F.lit(name).alias("metric"), F.col(key).cast("string").alias("key"), F.explode(cells).alias("x")).select("metric", "key", "x.measure", "x.value")
        out = part if out is None else out.unionByName(part)
    return out
