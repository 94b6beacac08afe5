"""Attributed claims in two times: ranks, evidence, supersession, decisions and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Reference properties that only say where an import came from.
IMPORTED = ("P143", "P4656", "P813")


def current(df: DataFrame) -> DataFrame:
    return df.where("superseded_at is null")


def truthy(claims: DataFrame) -> DataFrame:
    """Claims that count: not deprecated, and preferred ones alone where a subject and predicate has any."""
    rank = F.coalesce("rank", F.lit("normal"))
    best = F.max((rank == "preferred").cast("int")).over(Window.partitionBy("subject", "predicate"))
    return claims.withColumn("_best", best).where((rank != "deprecated") & ((F.col("_best") == 0) | (rank == "preferred"))).drop("_best")


def evidence(claims: DataFrame, references: DataFrame) -> DataFrame:
    """claim_id, n_references (distinct), sourced: a property besides those of imports."""
    refs = references.groupBy("claim_id").agg(F.countDistinct("ref_id").alias("n"), F.max((~F.col("property").isin(*IMPORTED)).cast("int")).alias("s"))
    return claims.join(refs, "claim_id", "left").select("claim_id", F.coalesce("n", F.lit(0)).alias("n_references"), (F.coalesce("s", F.lit(0)) == 1).alias("sourced"))


def supersede(claims: DataFrame, readings: DataFrame) -> DataFrame:
    """claims (claim_id, subject, recorded_at) with superseded_at: the first reading (subject, at) of the subject that
    is not before. A forward as-of join: readings and claims of a subject in one ordered window, no pairs."""
    rows = claims.select("claim_id", "subject", F.col("recorded_at").alias("at"), F.lit(0).alias("_side")).unionByName(
        readings.select(F.lit(None).cast(claims.schema["claim_id"].dataType).alias("claim_id"), "subject", "at", F.lit(1).alias("_side"))
    )
    ahead = Window.partitionBy("subject").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    out = rows.withColumn("superseded_at", F.min(F.when(F.col("_side") == 1, F.col("at"))).over(ahead))
    return out.where("_side = 0").select("claim_id", "subject", F.col("at").alias("recorded_at"), "superseded_at")


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key; order must be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def overlay(proposals: DataFrame, reviews: DataFrame) -> DataFrame:
    """proposals (target, relation, status, method, note) under the latest human review (target, decision, relation,
    reviewer, reviewer_kind, decided_at, rationale, seq): approve and revise accept, object rejects, agents never
    decide."""
    human = latest(reviews.where("reviewer_kind = 'human'"), ["target"], [F.desc("decided_at"), F.desc("seq")])
    human = human.select("target", "decision", F.col("relation").alias("_relation"), "reviewer", "rationale")
    d = F.col("decision")
    status = F.when(d.isin("approve", "revise"), "accepted").when(d == "object", "rejected").otherwise(F.col("status"))
    relation = F.when((d == "revise") & F.col("_relation").isNotNull(), F.col("_relation")).otherwise(F.col("relation"))
    note = F.when(d.isNull(), F.col("note")).otherwise(F.concat_ws("; ", F.nullif(F.col("note"), F.lit("")), F.concat(F.col("reviewer"), F.lit(": "), d), F.nullif(F.col("rationale"), F.lit(""))))
    method = F.when(d.isNull(), F.col("method")).otherwise(F.concat(F.col("method"), F.lit("+review")))
    return proposals.join(human, "target", "left").select("target", relation.alias("relation"), status.alias("status"), method.alias("method"), note.alias("note"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], last_wins: bool = True) -> DataFrame:
    """A new snapshot: of rows with one key the last (or the first) stays. Both have a column seq of load order."""
    rows = old.withColumn("_at", F.lit(0)).unionByName(new.withColumn("_at", F.lit(1)))
    order = [F.desc("_at"), F.desc("seq")] if last_wins else [F.asc("_at"), F.asc("seq")]
    return latest(rows, key, order).drop("_at")


def deprecate(old: DataFrame, present: DataFrame) -> DataFrame:
    """Nothing is deleted: active rows that are no longer present become deprecated."""
    here = present.select("id").distinct().withColumn("_here", F.lit(True))
    status = F.when(F.col("_here").isNull() & (F.col("status") == "active"), "deprecated").otherwise(F.col("status"))
    return old.join(here, "id", "left").withColumn("status", status).drop("_here")


def prefer_labels(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """labels (term, lang, kind, text; kind 0 preferred, 1 alternative, 2 and up hidden) -> label rows with one pref for
    each term and language, later ones demoted to alt, others equal to the pref dropped; and the dropped rows."""
    order = Window.partitionBy("term", "lang", "kind").orderBy("text")
    rows = labels.distinct().withColumn("_n", F.row_number().over(order))
    name = F.when((F.col("kind") == 0) & (F.col("_n") == 1), "pref").when(F.col("kind") <= 1, "alt").otherwise("hidden")
    rows = rows.withColumn("label_kind", name)
    pref = F.max(F.when(F.col("label_kind") == "pref", F.col("text"))).over(Window.partitionBy("term", "lang"))
    rows = rows.withColumn("_pref", pref).select("term", "lang", "label_kind", "text", ((F.col("label_kind") != "pref") & F.col("_pref").eqNullSafe(F.col("text"))).alias("_same")).distinct()
    return rows.where("not _same").drop("_same"), rows.where("_same").drop("_same")


def validity(qualifiers: DataFrame) -> DataFrame:
    """source, statement_id, valid_from, valid_to (texts), time_precision (the coarsest), valid_from_day, valid_to_day from
    the start (P580), end (P582) and point in time (P585) of statements, as ``worldtime.read_times`` gives them: each
    counts only if it is the only one of its property and known, and the point only without start and end."""
    def only(prop: str):
        mine = F.col("property") == prop
        value = F.struct("shown", "shown_precision", "first_day", "last_day")
        return F.when(F.count_if(mine) == 1, F.max(F.when(mine & F.col("shown").isNotNull(), value))).alias(prop)

    out = qualifiers.groupBy("source", "statement_id").agg(*map(only, ("P580", "P582", "P585")))
    point = F.when(F.col("P580").isNull() & F.col("P582").isNull(), F.col("P585"))
    out = out.select("source", "statement_id", F.coalesce("P580", point).alias("a"), F.coalesce("P582", point).alias("b"))
    return out.select(
        "source", "statement_id", F.col("a.shown").alias("valid_from"), F.col("b.shown").alias("valid_to"), F.least("a.shown_precision", "b.shown_precision").alias("time_precision"),
        F.col("a.first_day").alias("valid_from_day"), F.col("b.last_day").alias("valid_to_day"),
    )


def stabbing(claims: DataFrame, day: int) -> DataFrame:
    """Claims (valid_from, valid_to) that hold on a day; open ends always do."""
    return claims.where((F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day)))
