"""Writing a catalogue as snapshots: what an import adds, supersedes, retires and refuses. Nothing is deleted."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.claims import latest

#: Fixed values of review and mapping rows.
DECISIONS = ("approve", "revise", "object")
RELATIONS = ("exactMatch", "closeMatch", "broadMatch", "narrowMatch", "relatedMatch")
STATUSES = ("proposed", "accepted", "rejected")
KINDS = ("human", "agent")
#: Version of the snapshot's columns.
SCHEMA_VERSION = 3


def problems(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """key, problem: every rule (a message, and the condition under which it is a problem) that a row breaks."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(message)) for message, bad in rules.items())))
    return df.select(key.alias("key"), F.explode(found).alias("problem"))


def _missing(column: str) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) == ""


def review_problems(reviews: DataFrame) -> DataFrame:
    """Of review rows (target, decision, relation, reviewer, reviewer_kind, decided_at, rationale)."""
    d, r = F.col("decision"), F.col("relation")
    return problems(
        reviews, F.col("target"),
        {
            "no target": _missing("target"),
            "unknown decision": ~F.coalesce(d.isin(*DECISIONS), F.lit(False)),
            "a revision names a relation": (d == "revise") & ~F.coalesce(r.isin(*RELATIONS), F.lit(False)),
            "only a revision names a relation": (d != "revise") & ~_missing("relation"),
            "no reviewer": _missing("reviewer"),
            "unknown kind of reviewer": ~F.coalesce(F.col("reviewer_kind").isin(*KINDS), F.lit(False)),
            "no date": ~F.coalesce(F.col("decided_at").rlike(r"^\d{4}-\d\d-\d\d(T\d\d:\d\d(:\d\d)?Z?)?$"), F.lit(False)),
            "an objection gives its reason": (d == "object") & _missing("rationale"),
        },
    )


def append_reviews(old: DataFrame, new: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reviews with new ones after them, and the problems (key, problem) of those that are refused: invalid ones and
    ones of mappings that there are not."""
    bad = review_problems(new)
    known = mappings.select(F.concat(F.lit("mapping:"), F.col("from_id"), F.lit("|"), F.col("to_id")).alias("target"))
    dangling = new.where(F.startswith("target", F.lit("mapping:"))).join(known, "target", "left_anti").select(F.col("target").alias("key"), F.lit("no such mapping").alias("problem"))
    bad = bad.unionByName(dangling)
    last = old.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_last"))
    fine = new.join(bad.select(F.col("key").alias("target")).distinct(), "target", "left_anti").crossJoin(F.broadcast(last))  # one row
    return old.unionByName(fine.withColumn("seq", F.col("_last") + F.col("seq")).drop("_last")), bad


def decisions_to_mappings(decisions: DataFrame, concepts: DataFrame) -> DataFrame:
    """decisions (from_id, to_id, relation, status, method, reviewer, note, seq) -> mappings: rows that found nothing and
    rows of unknown concepts make none, of several for one pair the last counts."""
    rows = decisions.where(~_missing("to_id") & F.col("status").isin(*STATUSES))
    rows = rows.join(concepts.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    rows = latest(rows, ["from_id", "to_id"], [F.desc("seq")])
    return rows.select("from_id", "to_id", "relation", "status", "method", F.nullif("reviewer", F.lit("")).alias("reviewer"), F.nullif("note", F.lit("")).alias("note"))


def second_pass(links: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links (from_id, to_id, ...) of authored facets or crosswalks: those with both ends, and the dangling ones."""
    known = concepts.select("id")
    ok = links.join(known, links["from_id"] == known["id"], "left_semi").join(known, links["to_id"] == known["id"], "left_semi")
    return ok, links.join(ok.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_anti")


def supersede_sources(claims: DataFrame, sources: DataFrame, at: Column, keep: DataFrame | None = None) -> DataFrame:
    """Current claims of the sources (sha) are superseded at a time; those that a file states again (keep: claim_id) are
    current again."""
    gone = claims.join(sources.select(F.col("sha").alias("source_sha")).distinct(), "source_sha", "left_semi").select("claim_id").withColumn("_gone", F.lit(True))
    out = claims.join(gone, "claim_id", "left")
    again = F.lit(False)
    if keep is not None:
        out = out.join(keep.select("claim_id").distinct().withColumn("_again", F.lit(True)), "claim_id", "left")
        again = F.coalesce("_again", F.lit(False))
    when = F.when(again, None).when(F.coalesce("_gone", F.lit(False)) & F.col("superseded_at").isNull(), at).otherwise(F.col("superseded_at"))
    return out.withColumn("superseded_at", when).select(*claims.columns)


def without_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows that an import writes anew, without those of the sources (sha) it reads again."""
    return rows.join(sources.select(F.col("sha").alias("source_sha")).distinct(), "source_sha", "left_anti")


def supersede_documents(documents: DataFrame) -> DataFrame:
    """documents (doc_id, family, name, corpus) with superseded_by: of one name in a family, the document of the newest
    corpus; null for that one."""
    newest = documents.groupBy("family", "name").agg(F.max_by("doc_id", F.struct("corpus", "doc_id")).alias("_newest"))
    out = documents.join(newest, ["family", "name"])
    return out.withColumn("superseded_by", F.when(F.col("_newest") != F.col("doc_id"), F.col("_newest"))).drop("_newest")


def new_sources(known: DataFrame, found: DataFrame) -> DataFrame:
    """Sources (sha, name, seq) of either, each content once, under the first name it had."""
    rows = known.withColumn("_o", F.lit(0)).unionByName(found.withColumn("_o", F.lit(1)))
    return latest(rows, ["sha"], [F.asc("_o"), F.asc("seq"), F.asc("name")]).drop("_o")


def to_integrate(found: DataFrame, done: DataFrame) -> DataFrame:
    """found (scheme, lean_sha, mode) that were not integrated as they are: the last integration of a scheme counts."""
    last = latest(done, ["scheme"], [F.desc("id")]).select("scheme", "lean_sha", "mode")
    return found.join(last, ["scheme", "lean_sha", "mode"], "left_anti")


def retired(concepts: DataFrame, deselected: DataFrame) -> DataFrame:
    """Active concepts of deselected schemes (scheme) become deprecated."""
    gone = deselected.select("scheme").distinct().withColumn("_gone", F.lit(True))
    status = F.when(F.col("_gone").isNotNull() & (F.col("status") == "active"), "deprecated").otherwise(F.col("status"))
    return concepts.join(gone, "scheme", "left").withColumn("status", status).drop("_gone")


def migrated(df: DataFrame, version: int, steps: dict[int, list[tuple[str, Column]]]) -> tuple[DataFrame, DataFrame]:
    """A snapshot brought from a version to SCHEMA_VERSION by the columns each step adds, and a receipt (version, rows,
    digest of the columns that were there): the rows must be the same before and after."""
    if version > SCHEMA_VERSION:
        raise ValueError(f"version {version} is newer than {SCHEMA_VERSION}")
    old = df.columns
    for v in range(version, SCHEMA_VERSION):
        for name, value in steps.get(v, []):
            df = df.withColumn(name, value)
    return df, row_set(df, old).select(F.lit(SCHEMA_VERSION).alias("version"), "n", "digest")


def row_set(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, digest: of the rows as a multiset, the same in any order and layout: each row is hashed where it is, and the
    hashes are added in four lanes."""
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    lane = lambda i: F.sum(F.conv(F.substring(row, i * 12 + 1, 12), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("-", *(F.coalesce(lane(i).cast("string"), F.lit("0")) for i in range(4))), 256).alias("digest"))


def parsed_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (seq, id, label, mass) and edges (s, t: seq of nodes; k, w) of a file -> what can be drawn: nodes with an id,
    one each, the first; edges between such nodes, none to itself, weights from 0.01 to 1; and the counts of what was
    dropped."""
    fine = nodes.where(F.col("id").isNotNull() & (F.col("id") != ""))
    kept = fine.groupBy("id").agg(F.min(F.struct("seq", "label", "mass")).alias("x")).select("id", "x.label", F.coalesce("x.mass", F.lit(1.0)).alias("mass"))
    at = fine.select("seq", "id")
    joined = edges.join(at.select(F.col("seq").alias("s"), F.col("id").alias("a")), "s").join(at.select(F.col("seq").alias("t"), F.col("id").alias("b")), "t").where("a <> b")
    weight = F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.coalesce("w", F.lit(0.5))))
    lines = joined.groupBy(F.col("a").alias("s"), F.col("b").alias("t"), "k").agg(F.max(weight).alias("w"))
    counts = nodes.agg(F.count("*").alias("nodes")).crossJoin(kept.agg(F.count("*").alias("nodes_kept"))).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(lines.agg(F.count("*").alias("edges_kept")))  # one row each
    return kept, lines, counts


# Constraints of a snapshot


def constraints(frames: dict[str, DataFrame]) -> DataFrame:
    """check, key, detail of all rows that a catalogue's declarations forbid; frames that are missing are not checked."""
    checks: list[DataFrame] = []

    def breaks(name: str, check: str, keys: list[str], bad: Column) -> None:
        if name in frames:
            df = frames[name].where(F.coalesce(bad, F.lit(False)))
            checks.append(df.select(F.lit(check).alias("check"), F.concat_ws("|", *keys).alias("key"), F.lit("not allowed").alias("detail")))

    def unique(name: str, check: str, keys: list[str]) -> None:
        if name in frames:
            df = frames[name].groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
            checks.append(df.select(F.lit(check).alias("check"), F.concat_ws("|", *keys).alias("key"), F.concat("n", F.lit(" rows")).alias("detail")))

    unique("concept", "one concept an id", ["id"])
    breaks("concept", "status of concepts", ["id"], ~F.col("status").isin("active", "deprecated"))
    unique("label", "labels once", ["concept_id", "lang", "kind", "text"])
    breaks("label", "kind of labels", ["concept_id", "text"], ~F.col("kind").isin("pref", "alt", "hidden", "desc"))
    breaks("broader", "no concept is above itself", ["child"], F.col("child") == F.col("parent"))
    breaks("related", "related pairs are ordered", ["a", "b"], F.col("a") >= F.col("b"))
    breaks("mapping", "relation and status of mappings", ["from_id", "to_id"], ~F.col("relation").isin(*RELATIONS) | ~F.col("status").isin(*STATUSES))
    breaks("claim", "a known value is an object or a literal", ["claim_id"], (F.col("snak_type") == "value") & (F.col("object").isNull() == F.col("value").isNull()))
    breaks("claim", "an unknown value is neither", ["claim_id"], (F.col("snak_type") != "value") & (F.col("object").isNotNull() | F.col("value").isNotNull()))
    breaks("source", "hashes of sources", ["sha"], ~F.col("sha").rlike("^[0-9a-f]{128}$"))
    if "broader" in frames and "concept" in frames:
        ids = frames["concept"].select("id")
        for end in ("child", "parent"):
            gone = frames["broader"].join(ids, frames["broader"][end] == ids["id"], "left_anti")
            checks.append(gone.select(F.lit(f"{end} is a concept").alias("check"), F.concat_ws("|", "child", "parent").alias("key"), F.lit("unknown").alias("detail")))
    return reduce(DataFrame.unionByName, checks)


def verified(parts: dict[str, DataFrame]) -> DataFrame:
    """part, key, detail: everything that is wrong, over the parts of a catalogue (frames whose first column is a key and
    whose last says what is wrong). An empty result is a sound catalogue."""
    rows = [df.select(F.lit(name).alias("part"), F.col(df.columns[0]).cast("string").alias("key"), F.col(df.columns[-1]).cast("string").alias("detail")) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


#: Named views of a catalogue over temp views of its frames; fixed names.
VIEWS = {
    "v_claim_current": "SELECT * FROM claim WHERE superseded_at IS NULL",
    "v_claim_truthy": """SELECT * EXCEPT (best) FROM (SELECT *, max(CASE WHEN rank = 'preferred' THEN 1 ELSE 0 END) OVER (PARTITION BY subject, predicate) AS best FROM claim
        WHERE superseded_at IS NULL) WHERE coalesce(rank, 'normal') <> 'deprecated' AND (best = 0 OR rank = 'preferred')""",
    "v_claim_evidence": """SELECT c.claim_id, count(DISTINCT r.ref_hash) AS n_references, coalesce(bool_or(r.property NOT IN ('wd/P143', 'wd/P4656', 'wd/P813')), false) AS sourced
        FROM claim c LEFT JOIN claim_reference r ON r.claim_id = c.claim_id GROUP BY c.claim_id""",
    "v_lean_source": "SELECT max_by(struct(*), id).* FROM integration GROUP BY scheme",
    "v_concept": "SELECT c.*, s.depth, s.root, s.descendants FROM concept c LEFT JOIN concept_stat s ON s.id = c.id",
}


def create_views(spark: SparkSession, frames: dict[str, DataFrame]) -> list[str]:
    """Temp views of the frames, and of those named views whose frames are there."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    needs = {"v_claim_current": {"claim"}, "v_claim_truthy": {"claim"}, "v_claim_evidence": {"claim", "claim_reference"}, "v_lean_source": {"integration"}, "v_concept": {"concept", "concept_stat"}}
    made = [v for v in VIEWS if needs[v] <= frames.keys()]
    for v in made:
        spark.sql(VIEWS[v]).createOrReplaceTempView(v)
    return made


def read_only(spark: SparkSession, query: str, limit: int = 1000) -> DataFrame:
    """The first rows of a query; anything but a query is refused."""
    import re

    if not re.match(r"\s*(?:--[^\n]*\n\s*)*(select|with|values|table|from|show|describe|explain)\b", query, re.I):
        raise ValueError("only queries are run")
    return spark.sql(query).limit(limit)


def register(spark: SparkSession) -> None:
    """The SQL functions contains_any_case(text, needle), case_key(text) and matches(text, pattern); null matches nothing."""
    import unicodedata

    from lorekeep.functions.text import compiled, fold

    @F.pandas_udf("boolean")
    def contains_any_case(text: pd.Series, needle: pd.Series) -> pd.Series:
        return pd.Series([t is not None and n is not None and fold(n) in fold(t) for t, n in zip(text, needle, strict=True)])

    @F.pandas_udf("string")
    def case_key(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else fold(t))

    @F.pandas_udf("boolean")
    def matches(text: pd.Series, pattern: pd.Series) -> pd.Series:
        one = lambda t, p: t is not None and p is not None and compiled(p).search(unicodedata.normalize("NFC", t)) is not None
        return pd.Series([one(t, p) for t, p in zip(text, pattern, strict=True)])

    for f in (contains_any_case, case_key, matches):
        spark.udf.register(f.__name__, f)


# Exports


def graph_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """line: a JSON object for each node and edge, nodes first, in an order that does not change."""
    n = nodes.select(F.lit(0).alias("_o"), F.col("id").alias("_k"), F.to_json(F.struct(F.lit("node").alias("type"), *nodes.columns)).alias("line"))
    e = edges.select(F.lit(1).alias("_o"), F.concat_ws("|", "s", "t", "k").alias("_k"), F.to_json(F.struct(F.lit("edge").alias("type"), *edges.columns)).alias("line"))
    return n.unionByName(e).orderBy("_o", "_k").select("line")


def graph_digest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n, digest of what is drawn, so that a layout of other nodes or edges is known to be stale."""
    rows = nodes.select(F.concat_ws("|", F.lit("n"), "id").alias("x")).unionByName(edges.select(F.concat_ws("|", F.lit("e"), "s", "t", "k", F.format_string("%.6f", F.col("w").cast("double"))).alias("x")))
    return row_set(rows, ["x"])


def outline(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """line: a Markdown list of a tree (id, level, path: array) with labels (id, label), depth first."""
    named = paths.join(labels, "id", "left").select("path", F.concat(F.repeat(F.lit("  "), F.col("level")), F.lit("- "), F.coalesce("label", "id")).alias("line"))
    return named.orderBy("path").select("line")
