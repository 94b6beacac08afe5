"""Resolving links and crossing between schemes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.pairing import dealt_join

#: What shares an item of the hub is joined in so many lists, which are only then taken apart.
LISTS = 32


def resolve_prefix(links: DataFrame, prefixes: list[tuple[str, str]]) -> DataFrame:
    """links (link) with scope, code and id by the longest of the prefixes, a registry that is a list on the driver; no
    join. Codes must look like codes, else the link stays unresolved."""
    out = F.lit(None).cast("struct<scope:string,code:string>")
    for prefix, scope in sorted(prefixes, key=lambda p: len(p[0])):
        hit = F.struct(F.lit(scope).alias("scope"), F.substring(F.col("link"), F.lit(len(prefix) + 1), F.length("link")).alias("code"))
        out = F.when(F.startswith(F.col("link"), F.lit(prefix)), hit).otherwise(out)
    rows = links.withColumn("_r", out)
    good = F.col("_r.code").rlike(r"^[A-Za-z0-9][A-Za-z0-9._\-]*$")
    return rows.select(*links.columns, F.when(good, F.concat_ws("/", "_r.scope", "_r.code")).alias("id"))


def hub(claims: DataFrame, prop: str, known: DataFrame, subjects: DataFrame, pattern: str | None = None) -> DataFrame:
    """subject, code of the claims of one property, for codes that the source has and subjects that are known."""
    rows = claims.where(F.col("predicate") == prop).select("subject", F.col("value").alias("code"))
    if pattern:
        rows = rows.where(F.col("code").rlike(pattern))
    return rows.join(known, "code", "left_semi").join(subjects, "subject", "left_semi").distinct()


def with_inverse(mappings: DataFrame) -> DataFrame:
    """Both directions of mappings (from_id, to_id, relation)."""
    turn = F.when(F.col("relation") == "broadMatch", "narrowMatch").when(F.col("relation") == "narrowMatch", "broadMatch").otherwise(F.col("relation"))
    return mappings.select("from_id", "to_id", "relation", F.lit(False).alias("inverse")).unionByName(mappings.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), turn.alias("relation"), F.lit(True).alias("inverse")))


def two_hops(mappings: DataFrame, hub_scope: str) -> DataFrame:
    """(id, via, to_id): what shares an accepted item of the hub with a concept, in either direction; direct mappings
    first, else the least item. Pairs can only meet twice if both ends have several items, or be direct if both have a
    mapping to one that has items itself; all others, as many as they are, need no comparison with each other."""
    both = with_inverse(mappings.where("status = 'accepted'")).select("from_id", "to_id").distinct()
    direct = both.select(F.col("from_id").alias("id"), F.lit(None).cast("string").alias("via"), "to_id")
    items = both.where(F.startswith("to_id", F.lit(hub_scope + "/"))).select(F.col("from_id").alias("id"), F.col("to_id").alias("via"))
    ends = items.groupBy("id").agg((F.count("*") > 1).alias("_several"))
    inner = both.join(ends.select("id"), F.col("from_id") == F.col("id"), "left_semi").join(ends.select("id"), F.col("to_id") == F.col("id"), "left_semi")
    marks = ends.where("_several").select("id").unionByName(inner.select(F.col("from_id").alias("id"))).distinct().withColumn("_mark", F.lit(True))
    x = items.join(marks, "id", "left").select("id", "via", F.coalesce("_mark", F.lit(False)).alias("_x"))
    y = x.select(F.col("id").alias("to_id"), "via", F.col("_x").alias("_y"))
    lists = y.groupBy("via", "_y", F.pmod(F.xxhash64("to_id"), F.lit(LISTS)).alias("_b")).agg(F.collect_list("to_id").alias("_ids")).drop("_b")
    once = dealt_join(x, lists, ["via"], 64).where(~(F.col("_x") & F.col("_y"))).select("id", "via", F.explode("_ids").alias("to_id")).where("to_id <> id")
    again = dealt_join(x.where("_x"), y.where("_y"), ["via"], 64).where("to_id <> id").groupBy("id", "to_id").agg(F.min("via").alias("via"))
    again = again.join(inner.select(F.col("from_id").alias("id"), "to_id"), ["id", "to_id"], "left_anti").select("id", "via", "to_id")
    return direct.unionByName(once).unionByName(again)


def triangle(edges: DataFrame, matches: DataFrame, stated: DataFrame) -> DataFrame:
    """edges (child, parent) with stated: a claim links the items that match both ends."""
    up = edges.join(matches.select(F.col("id").alias("child"), F.col("item").alias("a")), "child").join(matches.select(F.col("id").alias("parent"), F.col("item").alias("b")), "parent")
    hit = up.join(stated.select(F.col("subject").alias("a"), F.col("object").alias("b")), ["a", "b"], "left_semi").select("child", "parent").distinct().withColumn("stated", F.lit(True))
    both = up.select("child", "parent").distinct()
    return both.join(hit, ["child", "parent"], "left").select("child", "parent", F.coalesce("stated", F.lit(False)).alias("stated"))


def vanished(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("id").distinct().join(after.select("id"), "id", "left_anti")


def display_label(labels: DataFrame) -> DataFrame:
    """id, label: English, else multilingual, else without a language, else the least language tag."""
    order = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "mul", 1).when(F.col("lang").isin("", "und"), 2).otherwise(3)
    return labels.groupBy("id").agg(F.min(F.struct(order.alias("o"), "lang", "text"))["text"].alias("label"))
