"""Taking a converted source into a catalogue: a frame for every destination, and counts of what was not taken.

The source is ``Lean`` frames with richer columns where it has them: term (code, status, kind), attr (code, pred, lang,
value_int, value_real, value_text). preds (pred, role, map, datatype) says what predicates mean; a predicate that is not
listed has no role. Order is by the source's canonical order, so integrating twice gives the same frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.claims import prefer_labels
from lorekeep.operators.links import display_label, resolve_prefix
from lorekeep.sources.lean import Lean

#: Mappings that roles imply where a predicate declares none.
IMPLIED = {"broader": "broadMatch", "related": "relatedMatch"}
_CODE = r"^[A-Za-z0-9][A-Za-z0-9._\-]*$"


@dataclass(frozen=True)
class Resolver:
    """What links become ids: IRIs by the longest of prefixes (iri, scheme), CURIEs by names (prefix, scheme), and values of
    a property (P1:value) by templates (property, scheme)."""

    iris: tuple[tuple[str, str], ...] = ()
    curies: tuple[tuple[str, str], ...] = ()
    properties: tuple[tuple[str, str], ...] = ()

    def __call__(self, links: DataFrame, column: str = "target") -> DataFrame:
        """links with id, null where nothing fits. A registry is a list on the driver: no join."""
        own = links.withColumnRenamed(column, "link")
        out = resolve_prefix(own, list(self.iris))
        head, rest = F.split_part("link", F.lit(":"), F.lit(1)), F.regexp_extract("link", r"^[^:]*:(.*)$", 1)
        schemes = dict(self.curies)
        found: Column = F.lit(None).cast("string")
        for name, scheme in {**schemes, **dict(self.properties)}.items():
            # Codes of ontologies keep their prefix inside: GO:1 below a property is GO_1.
            code = F.replace(rest, F.lit(":"), F.lit("_")) if name in dict(self.properties) else rest
            found = F.when((head == name) & code.rlike(_CODE), F.concat(F.lit(scheme + "/"), code)).otherwise(found)
        return out.withColumn("id", F.coalesce("id", found)).withColumnRenamed("link", column)


def literal(value_int: Column, value_real: Column, value_text: Column, lang: Column, datatype: Column) -> tuple[Column, Column]:
    """A claim's value and datatype: whole and real numbers as such, text of a language with it, else as declared."""
    tagged = F.coalesce(lang, F.lit("")) != ""
    value = F.coalesce(value_int.cast("string"), value_real.cast("string"), F.when(tagged, F.to_json(F.struct(lang.alias("language"), value_text.alias("text")))).otherwise(value_text))
    kind = F.when(value_int.isNotNull(), "int").when(value_real.isNotNull(), "real").when(tagged, "monolingualtext").otherwise(F.coalesce(datatype, F.lit("string")))
    return value, kind


def integrate(lean: Lean, scheme: str, preds: DataFrame, resolver: Resolver, facets: DataFrame | None = None) -> dict[str, DataFrame]:
    """concept, label, facet, broader, related, mapping, claim, and counts (one row). facets (kind, facet_id): concepts
    that exist, for the kinds of terms."""
    own = lambda c: F.concat(F.lit(scheme + "/"), F.col(c))
    term = lean.term if "kind" in lean.term.columns else lean.term.withColumn("kind", F.lit(None).cast("string"))
    attr = lean.attr if "lang" in lean.attr.columns else lean.attr.withColumn("lang", F.lit(""))
    known = preds.select("pred", "role", "map", "datatype")
    own_map = lean.link.withColumnRenamed("map", "own_map")
    attr, rel, link = (df.join(F.broadcast(known), "pred", "left") for df in (attr, lean.rel, own_map))  # a registry of predicates

    labels, dropped = prefer_labels(lean.label.select(F.col("code").alias("term"), "lang", "kind", "text"))
    name = F.element_at(F.split("pred", "[:/#]"), -1)
    note = F.coalesce(F.col("role") == "note", F.lit(False))
    text = F.coalesce("value_text", F.col("value_int").cast("string"), F.col("value_real").cast("string"))
    attr = attr.withColumns({"is_def": note & (name == "definition"), "is_scope": note & (name == "scopeNote"), "text": text})
    described = attr.where("is_def").select(own("code").alias("id"), "lang", F.lit("desc").alias("kind"), "text")
    rank = F.when(F.col("is_def"), F.when(F.col("lang") == "en", 0).otherwise(2)).otherwise(F.when(F.col("lang") == "en", 1).otherwise(3))
    scope = attr.where("is_def or is_scope").groupBy("code").agg(F.min_by("text", F.struct(rank.alias("r"), "pred", "lang", "text")).alias("scope_note"))

    numbered = attr.withColumn("_n", F.when(F.col("role") == "notation", F.row_number().over(Window.partitionBy("code", "role").orderBy("pred", "lang", "text"))))
    notation = numbered.where("_n = 1").select("code", F.col("text").alias("notation"))
    replaced = attr.where("role = 'replacedBy'").withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("pred"), F.desc("lang"), F.desc("text")))).where("_n = 1").select("code", F.col("text").alias("target"))
    inside = term.select(F.col("code").alias("target"), F.lit(True).alias("_mine")).distinct()
    replaced = resolver(replaced).join(inside, "target", "left").select("code", F.when(F.col("_mine"), own("target")).otherwise(F.coalesce("id", "target")).alias("replaced_by"))

    shown = display_label(labels.where("label_kind = 'pref'").select(F.col("term").alias("id"), "lang", "text")).select(F.col("id").alias("code"), "label")
    concept = term
    for part in (shown, scope, notation, replaced):
        concept = concept.join(part, "code", "left")
    status = F.when(F.col("status") == 1, "deprecated").otherwise("active")
    concept = concept.select(own("code").alias("id"), "code", F.coalesce("label", "code").alias("label"), "scope_note", "notation", status.alias("status"), "replaced_by", "kind")
    facet = None
    if facets is not None:
        facet = concept.where("kind is not null").join(facets.select("kind", "facet_id"), "kind").select("id", "facet_id").distinct()

    value, kind = literal(F.col("value_int"), F.col("value_real"), F.col("value_text"), F.col("lang"), F.col("datatype"))
    said = numbered.where("not is_def and coalesce(role, '') <> 'replacedBy' and coalesce(_n, 2) > 1")
    predicate = F.concat(F.lit(f"{scheme}/@"), F.col("pred"))
    none = F.lit(None).cast("string")
    claim = said.select(own("code").alias("subject"), predicate.alias("predicate"), none.alias("object"), value.alias("value"), kind.alias("datatype"))
    other = rel.where("coalesce(role, pred) not in ('broader', 'related')").select(own("s").alias("subject"), predicate.alias("predicate"), own("o").alias("object"), none.alias("value"), F.lit("wikibase-item").alias("datatype"))

    implied = F.when(F.coalesce("role", "pred") == "broader", IMPLIED["broader"]).when(F.coalesce("role", "pred") == "related", IMPLIED["related"])
    out = resolver(link.select("code", "pred", "target", F.coalesce("own_map", "map", implied).alias("relation")))
    mapped = out.where("relation is not null")
    good = F.col("id").isNotNull() & (F.col("id") != own("code"))
    mapping = mapped.where(good).select(own("code").alias("from_id"), F.col("id").alias("to_id"), "relation", F.concat(F.lit(f"declared:{scheme} ("), "pred", F.lit(")")).alias("method"), F.lit("proposed").alias("status")).dropDuplicates(["from_id", "to_id"])
    web = F.when(F.col("target").rlike("^https?:"), "url").otherwise("external-id")
    linked = out.where("relation is null").select(own("code").alias("subject"), predicate.alias("predicate"), F.col("id").alias("object"), F.when(F.col("id").isNull(), F.col("target")).alias("value"), F.when(F.col("id").isNull(), web).otherwise("wikibase-item").alias("datatype"))

    frames = {
        "concept": concept.drop("kind"),
        "label": labels.select(own("term").alias("id"), "lang", F.col("label_kind").alias("kind"), "text").unionByName(described).distinct(),
        "broader": rel.where("coalesce(role, pred) = 'broader'").select(own("s").alias("child"), own("o").alias("parent")).distinct(),
        "related": rel.where("coalesce(role, pred) = 'related'").select(F.least(own("s"), own("o")).alias("a"), F.greatest(own("s"), own("o")).alias("b")).distinct(),
        "mapping": mapping,
        "claim": claim.unionByName(other).unionByName(linked).distinct(),
        "counts": dropped.agg(F.count("*").alias("labels_dropped")).crossJoin(mapped.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("links_unresolved"))),  # one row each
    }
    return frames if facet is None else frames | {"facet": facet}


def snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    """Concepts (id, status, ...) of a scheme after an integration: new rows in place of old ones, vanished ones deprecated."""
    gone = old.join(new.select("id"), "id", "left_anti").withColumn("status", F.when(F.col("status") == "active", "deprecated").otherwise(F.col("status")))
    return new.unionByName(gone, allowMissingColumns=True)


def attached(term: DataFrame, label: DataFrame, scheme: str) -> DataFrame:
    """id, label of a source that is searched but not taken in."""
    shown = display_label(label.where("kind = 0").select(F.col("code").alias("id"), "lang", "text"))
    return term.join(shown, term["code"] == shown["id"], "left").select(F.concat(F.lit(scheme + "/"), "code").alias("id"), F.coalesce("label", "code").alias("label"))


def term_iri(template: str, code: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{code}"), code)
