"""Retrieval evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.stored import written

DEPTH, K = 100, 60


def metrics(ranks: DataFrame) -> DataFrame:
    """ranks (query, lang, rank; null: not found) with mrr, recall and ndcg at 10."""
    hit = F.coalesce(F.col("rank") <= 10, F.lit(False))
    return ranks.withColumns({"mrr": F.when(hit, 1 / F.col("rank")).otherwise(0.0), "recall": hit.cast("double"), "ndcg": F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)})


def by_language(ranks: DataFrame) -> DataFrame:
    return metrics(ranks).groupBy("lang").agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in ("mrr", "recall", "ndcg")))


def macro(ranks: DataFrame) -> DataFrame:
    """One row: unweighted means over languages, and the worst language by MRR."""
    return by_language(ranks).agg(*(F.avg(m).alias(m) for m in ("mrr", "recall", "ndcg")), F.min(F.struct("mrr", "lang"))["lang"].alias("worst"))


def unique_ranks(lists: DataFrame) -> DataFrame:
    """lists (query, id, pos): the first place of each id, renumbered, to DEPTH."""
    first = lists.groupBy("query", "id").agg(F.min("pos").alias("pos"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("pos", "id"))).where(F.col("rank") <= DEPTH).select("query", "id", "rank")


def fuse(lists: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of lists (query, system, id, rank from 1): query, id, score, rank."""
    scores = lists.groupBy("query", "id").agg(F.sum(1 / (K + F.col("rank"))).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= DEPTH)


def bootstrap(ranks: DataFrame, reps: int = 1000, seed: int = 1) -> DataFrame:
    """lang, mean, low, high of MRR: resampled within a language by its counts of values, so a task gets the few
    distinct values of a language and not its queries."""
    values = metrics(ranks).groupBy("lang", "mrr").agg(F.count("*").alias("c"))

    def resample(f: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        f = f.sort_values("mrr")
        v, c = f["mrr"].to_numpy(), f["c"].to_numpy()
        rng = np.random.default_rng([seed, sum(str(f["lang"].iloc[0]).encode())])
        means = rng.multinomial(c.sum(), c / c.sum(), size=reps) @ v / c.sum()
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame([(f["lang"].iloc[0], float(v @ c / c.sum()), low, high)], columns=["lang", "mean", "low", "high"])

    return values.groupBy("lang").applyInPandas(resample, "lang string, mean double, low double, high double")


def paired_test(a: DataFrame, b: DataFrame, perms: int = 1000, seed: int = 1) -> DataFrame:
    """One row: the macro difference of MRR and the p-value of random sign flips. Each permutation's sums are formed
    where the queries are; signs come from a hash of permutation and query."""
    left = metrics(a).select("query", "lang", F.col("mrr").alias("x"))
    both = written(left.join(metrics(b).select("query", F.col("mrr").alias("y")), "query"))  # read three times
    per = both.groupBy("lang").agg(F.count("*").alias("n"))
    langs = per.count()
    rows = both.join(F.broadcast(per), "lang").select("query", ((F.col("x") - F.col("y")) / (F.lit(langs) * F.col("n"))).alias("d")).where("d <> 0")

    def flips(batches):
        import numpy as np
        import xxhash

        total, observed = np.zeros(perms), 0.0
        for f in batches:
            for q, d in zip(f["query"], f["d"], strict=True):
                rng = np.random.default_rng([seed, xxhash.xxh64_intdigest(str(q).encode())])
                total += d * (2 * rng.integers(0, 2, perms) - 1)
                observed += d
        yield pd.DataFrame({"k": range(-1, perms), "s": [observed, *total]})

    sums = rows.mapInPandas(flips, "k int, s double").groupBy("k").agg(F.sum("s").alias("s"))
    seen = F.max(F.when(F.col("k") == -1, F.col("s")))
    folded = sums.agg(seen.alias("difference"), F.collect_list(F.when(F.col("k") >= 0, F.abs("s"))).alias("a"))  # perms numbers
    return folded.select("difference", ((F.size(F.filter("a", lambda x: x >= F.abs("difference") - 1e-12)) + 1) / (perms + 1)).alias("p"))
