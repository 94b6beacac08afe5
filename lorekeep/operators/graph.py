"""Poly-hierarchies: closures, levels, statistics, checks. Edges are (child, parent). Each round extends only what was
new, is written out, and stops when nothing is; cycles and many paths to one node do no harm."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.stored import written


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor) for every two nodes with a path, not the node itself unless it is on a cycle."""
    edges = edges.where("parent is not null").select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct()
    steps = edges.select(F.col("node").alias("mid"), F.col("ancestor").alias("up"))
    new = written(edges)
    seen = [new]
    while not new.isEmpty():
        grown = new.join(steps, new["ancestor"] == steps["mid"]).select("node", F.col("up").alias("ancestor")).distinct()
        new = written(_without(grown, seen, ["node", "ancestor"]))
        seen.append(new)
    return reduce(DataFrame.unionByName, seen)


def _without(df: DataFrame, parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows that none of the parts has, each of which was written once."""
    for p in parts:
        df = df.join(p.select(*keys), keys, "left_anti")
    return df


def subtree(edges: DataFrame, root: str) -> DataFrame:
    """id of the root, known or not, and of everything below it."""
    steps = edges.select("child", "parent").distinct()
    new = edges.sparkSession.createDataFrame([(root,)], "id string")
    seen = [new]
    while not new.isEmpty():
        below = new.join(steps, new["id"] == steps["parent"]).select(F.col("child").alias("id")).distinct()
        new = written(_without(below, seen, ["id"]))
        seen.append(new)
    return reduce(DataFrame.unionByName, seen)


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, depth, root: breadth first from the nodes without a parent; the least root among the nearest. Nodes that no
    root reaches have neither."""
    steps = edges.select("child", "parent").distinct()
    new = nodes.join(steps, nodes["id"] == steps["child"], "left_anti").select("id", F.lit(0).alias("depth"), F.col("id").alias("root"))
    new = written(new)
    seen, depth = [new], 0
    while not new.isEmpty():
        depth += 1
        grown = new.join(steps, new["id"] == steps["parent"]).groupBy(F.col("child").alias("id")).agg(F.lit(depth).alias("depth"), F.min("root").alias("root"))
        new = written(_without(grown, seen, ["id"]))
        seen.append(new)
    return nodes.select("id").join(reduce(DataFrame.unionByName, seen), "id", "left")


def descendants(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """id, descendants of ``levels``: the distinct nodes below. Where no node has two parents and a root reaches all, they
    are summed level by level from the deepest; else they are counted in the closure."""
    steps = edges.where("parent is not null").select("child", "parent").distinct()
    parents = steps.groupBy("child").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    deepest, unplaced = placed.agg(F.max("depth"), F.count_if(F.col("depth").isNull())).first()
    lost = steps.join(placed.select(F.col("id").alias("child")), "child", "left_anti")
    if parents > 1 or unplaced or deepest is None or not lost.isEmpty():
        return closure(edges).groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("descendants"))
    rows = placed.select("id", "depth").join(steps, F.col("id") == F.col("child"), "left").select("id", "depth", "parent")
    below, every = None, None
    for depth in range(deepest, 0, -1):
        here = rows.where(F.col("depth") == depth)
        here = here.withColumn("descendants", F.lit(0)) if below is None else here.join(below, "id", "left").withColumn("descendants", F.coalesce("descendants", F.lit(0)))
        below = written(here.groupBy(F.col("parent").alias("id")).agg(F.sum(F.col("descendants") + 1).alias("descendants")))
        every = below if every is None else every.unionByName(below)
    return edges.sparkSession.createDataFrame([], "id string, descendants bigint") if every is None else every


def stats(nodes: DataFrame, edges: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """id, depth, root, descendants (distinct), docs."""
    placed = written(levels(nodes, edges))
    out = placed.join(descendants(placed, edges), "id", "left")
    n = F.lit(0)
    if docs is not None:
        out = out.join(docs.groupBy("id").agg(F.count("*").alias("_docs")), "id", "left")
        n = F.coalesce("_docs", F.lit(0))
    return out.select("id", "depth", "root", F.coalesce("descendants", F.lit(0)).alias("descendants"), n.cast("long").alias("docs"))


def masses(stats_: DataFrame) -> DataFrame:
    return stats_.withColumn("mass", F.bround(1 + F.log1p("descendants") + 0.5 * F.log1p("docs"), 3))


#: Weights of edges by kind.
WEIGHTS = {"broader": 1.0, "related": 0.5, "mapping": 0.4, "facet": 0.3}


def graph_edges(frames: dict[str, DataFrame], semantic: DataFrame | None = None) -> DataFrame:
    """s, t, k, w of the edges by kind (frames of s, t); semantic (s, t, w) is clamped, unordered and deduplicated."""
    out = None
    for kind, df in frames.items():
        part = df.select("s", "t", F.lit("mapping" if kind == "facet" else kind).alias("k"), F.lit(WEIGHTS[kind]).alias("w"))
        out = part if out is None else out.unionByName(part)
    if semantic is not None:
        pairs = semantic.select(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"), "w").groupBy("s", "t").agg(F.max("w").alias("w"))
        out = out.unionByName(pairs.select("s", "t", F.lit("semantic").alias("k"), F.greatest(F.lit(0.01), F.least(F.lit(1.0), "w")).alias("w")))
    return out


def symmetric(pairs: DataFrame) -> DataFrame:
    """(a, b) stored once, a < b, without loops."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle."""
    return closure(edges).where("node = ancestor").select(F.col("node").alias("id"))


def tree(edges: DataFrame, root: str, depth: int = 3) -> DataFrame:
    """id, level, path: depth first is the order of path; a node that is its own ancestor is not entered again."""
    steps = edges.select("child", "parent").distinct()
    level = edges.sparkSession.createDataFrame([(root, 0, [root])], "id string, level int, path array<string>")
    out = level
    for k in range(1, depth + 1):
        level = level.join(steps, level["id"] == steps["parent"]).where(~F.array_contains("path", F.col("child")))
        level = level.select(F.col("child").alias("id"), F.lit(k).alias("level"), F.concat("path", F.array("child")).alias("path"))
        out = out.unionByName(level)
    return out


class _Checks(dict):
    """Frames that are made when they are read."""

    def __getitem__(self, name: str) -> DataFrame:
        return super().__getitem__(name)()

    def items(self):
        return [(k, self[k]) for k in self]

    def values(self):
        return [self[k] for k in self]


def skos_checks(labels: DataFrame, edges: DataFrame, related: DataFrame, mappings: DataFrame) -> dict[str, DataFrame]:
    """Violations by check: label kinds that overlap, two preferred labels in a language, related above or below, exact
    matches that are also hierarchical. Each is a plan of its own; the closure under S27 runs when it is asked for."""
    a, b = labels.alias("a"), labels.alias("b")
    same = (F.col("a.concept") == F.col("b.concept")) & (F.col("a.lang") == F.col("b.lang")) & (F.col("a.text") == F.col("b.text")) & (F.col("a.kind") < F.col("b.kind"))
    s13 = a.join(b, same).select("a.concept", "a.lang", "a.text").distinct()
    s14 = labels.where("kind = 'pref'").groupBy("concept", "lang").agg(F.count("*").alias("n")).where("n > 1")
    both = related.select("a", "b").unionByName(related.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def s27() -> DataFrame:
        above = closure(edges)
        return both.join(above, (both["a"] == above["node"]) & (both["b"] == above["ancestor"]), "left_semi")

    exact = mappings.where("relation = 'exactMatch'").select("from_id", "to_id")
    other = mappings.where("relation in ('broadMatch', 'narrowMatch', 'relatedMatch')").select("from_id", "to_id")
    return _Checks({"S13": lambda: s13, "S14": lambda: s14, "S27": s27, "S46": lambda: exact.join(other, ["from_id", "to_id"], "left_semi")})


def seed_problems(seeds: DataFrame) -> DataFrame:
    """code, problem of seed rows (code, broader: array, related: array)."""
    up = seeds.select("code", F.explode("broader").alias("to"))
    side = seeds.select("code", F.explode("related").alias("to"))
    known = seeds.select(F.col("code").alias("to")).distinct()
    problem = lambda df, what: df.select("code", F.lit(what).alias("problem")).distinct()
    parts = [
        problem(seeds.groupBy("code").count().where("count > 1"), "duplicate code"),
        problem(up.join(known, "to", "left_anti"), "unknown broader"),
        problem(up.where("code = to"), "broader is itself"),
        problem(side.join(known, "to", "left_anti"), "unknown related"),
        problem(up.join(side, ["code", "to"], "left_semi"), "both broader and related"),
        problem(cycles(up.select(F.col("code").alias("child"), F.col("to").alias("parent"))).withColumnRenamed("id", "code"), "cycle"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def primary_parents(edges: DataFrame, depth: DataFrame) -> DataFrame:
    """child, parent: the shallowest parent, the least id among those."""
    d = depth.select(F.col("id").alias("parent"), "depth")
    order = Window.partitionBy("child").orderBy(F.col("depth").asc_nulls_last(), "parent")
    return edges.join(d, "parent", "left").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("child", "parent")


def areas(edges: DataFrame, root: str) -> DataFrame:
    """level, area, id: what lies in the areas below a root (1) and in their parts (2), the areas themselves included. An
    area without parts is its own part."""
    steps = edges.select("child", "parent").distinct()
    first = steps.where(F.col("parent") == root).select(F.col("child").alias("area"))
    second = first.join(steps.select("child", F.col("parent").alias("area")), "area", "left").select(F.coalesce("child", "area").alias("area"))
    named = first.withColumn("level", F.lit(1)).unionByName(second.withColumn("level", F.lit(2)))
    below = closure(edges).select(F.col("ancestor").alias("area"), F.col("node").alias("id"))
    return named.join(below, "area").select("level", "area", "id").unionByName(named.select("level", "area", F.col("area").alias("id"))).distinct()
