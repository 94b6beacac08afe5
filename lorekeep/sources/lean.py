"""Declarative conversion of tables and vocabularies into one normalised layout of frames: terms, labels, relations,
attributes, links. Rows are sorted and distinct only where they are written."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of labels by number.
LABEL_KINDS = ("pref", "alt", "hidden", "broad", "narrow", "related")
LITERALS = {"int": "bigint", "float": "double"}


@dataclass
class Mapping:
    """How the columns of a table become terms."""

    id: str
    labels: list[dict] = field(default_factory=list)  # column, kind, lang, split
    broader: list[dict] = field(default_factory=list)  # column, split
    relations: list[dict] = field(default_factory=list)  # column, pred, split
    attrs: list[dict] = field(default_factory=list)  # column, pred, cast
    links: list[dict] = field(default_factory=list)  # column, pred, map, split
    where: dict[str, list] = field(default_factory=dict)
    status: tuple[str, list] | None = None  # column and the values of what is no longer valid


@dataclass
class Lean:
    term: DataFrame  # code, status
    label: DataFrame  # code, kind, lang, text
    rel: DataFrame  # s, pred, o
    attr: DataFrame  # code, pred, value_int, value_real, value_text
    link: DataFrame  # code, pred, map, target


def _cells(df: DataFrame, mapping: Mapping, spec: dict) -> DataFrame:
    """code, v: empty cells are absent; split cells give several."""
    value = F.col(spec["column"]).cast("string")
    parts = F.split(value, F.lit(_quoted(spec["split"]))) if spec.get("split") else F.array(value)
    return df.select(F.col(mapping.id).cast("string").alias("code"), F.explode(parts).alias("v")).withColumn("v", F.trim("v")).where("v <> ''")


def _quoted(separator: str) -> str:
    return r"\Q" + separator + r"\E"


def _union(frames: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for f in frames:
        out = out.unionByName(f)
    return out


def typed(value: Column, cast: str | None) -> tuple[Column, Column, Column]:
    """A value as whole number, real number or text; text where the cast fails."""
    whole = value.try_cast("bigint") if cast == "int" else F.lit(None).cast("bigint")
    real = value.try_cast("double") if cast == "float" else F.lit(None).cast("double")
    return whole, real, F.when(whole.isNull() & real.isNull(), value)


def convert_table(df: DataFrame, mapping: Mapping) -> Lean:
    spark = df.sparkSession
    for spec in (*mapping.labels, *mapping.broader, *mapping.relations, *mapping.attrs, *mapping.links, {"column": mapping.id}):
        if spec["column"] not in df.columns:
            raise KeyError(spec["column"])
    for column, values in mapping.where.items():
        df = df.where(F.col(column).isin(values))
    df = df.where(F.col(mapping.id).isNotNull())
    gone = F.col(mapping.status[0]).isin(mapping.status[1]) if mapping.status else F.lit(False)
    term = df.groupBy(F.col(mapping.id).cast("string").alias("code")).agg(F.max(F.coalesce(gone, F.lit(False)).cast("int")).alias("status"))
    label = _union([_cells(df, mapping, s).select("code", F.lit(LABEL_KINDS.index(s.get("kind", "pref"))).alias("kind"), F.lit(s.get("lang", "")).alias("lang"), F.col("v").alias("text")) for s in mapping.labels], spark, "code string, kind int, lang string, text string").distinct()
    pairs = [_cells(df, mapping, s).select(F.col("code").alias("s"), F.lit(s.get("pred", "broader")).alias("pred"), F.col("v").alias("o")) for s in (*mapping.broader, *mapping.relations)]
    rel = _union(pairs, spark, "s string, pred string, o string").where("s <> o").distinct()
    attrs = []
    for s in mapping.attrs:
        a, b, c = typed(F.col("v"), s.get("cast"))
        attrs.append(_cells(df, mapping, s).select("code", F.lit(s["pred"]).alias("pred"), a.alias("value_int"), b.alias("value_real"), c.alias("value_text")))
    attr = _union(attrs, spark, "code string, pred string, value_int bigint, value_real double, value_text string").distinct()
    link = _union([_cells(df, mapping, s).select("code", F.lit(s["pred"]).alias("pred"), F.lit(s.get("map")).cast("string").alias("map"), F.col("v").alias("target")) for s in mapping.links], spark, "code string, pred string, map string, target string").distinct()
    return resolved(Lean(term, label, rel, attr, link))


def resolved(lean: Lean) -> Lean:
    """Relations stay where both ends are terms; one whose object is not becomes a link, one without a subject goes."""
    known = lean.term.select("code")
    mine = lean.rel.join(known.withColumnRenamed("code", "s"), "s", "left_semi")
    ends = known.withColumnRenamed("code", "o")
    dangling = mine.join(ends, "o", "left_anti").select(F.col("s").alias("code"), "pred", F.lit(None).cast("string").alias("map"), F.col("o").alias("target"))
    return Lean(lean.term, lean.label.join(known, "code", "left_semi"), mine.join(ends, "o", "left_semi").select("s", "pred", "o"), lean.attr.join(known, "code", "left_semi"), lean.link.unionByName(dangling).distinct())


def write(lean: Lean, path: str) -> None:
    for name, frame in vars(lean).items():
        frame.sortWithinPartitions(*frame.columns).write.mode("overwrite").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> Lean:
    return Lean(*(spark.read.parquet(f"{path}/{name}") for name in ("term", "label", "rel", "attr", "link")))


def integrate(lean: Lean, scheme: str) -> dict[str, DataFrame]:
    """Catalogue frames of one scheme: concept, label, broader, related, claim, mapping."""
    from lorekeep.operators.claims import prefer_labels

    scoped = lambda c: F.concat(F.lit(scheme + "/"), F.col(c))
    labels, _ = prefer_labels(lean.label.select(F.col("code").alias("term"), "lang", "kind", "text"))
    text = F.coalesce(F.col("value_int").cast("string"), F.col("value_real").cast("string"), F.col("value_text"))
    kind = F.when(F.col("value_int").isNotNull(), "int").when(F.col("value_real").isNotNull(), "real").otherwise("string")
    notation = Window.partitionBy("code").orderBy("value_text")
    marked = lean.attr.withColumn("_n", F.when(F.col("pred") == "notation", F.row_number().over(Window.partitionBy("code", "pred").orderBy("value_text", "value_int"))))
    first = marked.where("_n = 1").select("code", text.alias("notation"))
    concept = lean.term.join(first, "code", "left").select(scoped("code").alias("id"), F.when(F.col("status") == 1, "deprecated").otherwise("active").alias("status"), "notation")
    claims = marked.where("_n is null or _n > 1").select(scoped("code").alias("subject"), "pred", text.alias("value"), kind.alias("datatype"))
    others = lean.rel.where("pred not in ('broader', 'related')").select(scoped("s").alias("subject"), "pred", scoped("o").alias("value"), F.lit("object").alias("datatype"))
    related = lean.rel.where("pred = 'related'").select(F.least(scoped("s"), scoped("o")).alias("a"), F.greatest(scoped("s"), scoped("o")).alias("b")).where("a <> b").distinct()
    mapping = lean.link.where("map is not null").select(scoped("code").alias("from_id"), F.col("target").alias("to_id"), F.col("map").alias("relation"), F.lit("proposed").alias("status")).where("from_id <> to_id")
    urls = lean.link.where("map is null").select(scoped("code").alias("subject"), "pred", F.col("target").alias("value"), F.lit("link").alias("datatype"))
    del notation
    return {
        "concept": concept,
        "label": labels.select(scoped("term").alias("id"), "lang", F.col("label_kind").alias("kind"), "text"),
        "broader": lean.rel.where("pred = 'broader'").select(scoped("s").alias("child"), scoped("o").alias("parent")),
        "related": related,
        "claim": claims.unionByName(others).unionByName(urls),
        "mapping": mapping,
    }
