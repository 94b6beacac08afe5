"""Wikidata payloads: entities with their names, statements with qualifiers and references, query-service summaries.

A payload is a row (name, retrieved_at, content): one response of the entity interface or of the query service, as it was
stored. Everything is nested ``explode`` over one declared schema; Python runs on structured values alone, which are kept
as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import worldtime
from lorekeep.functions.text import canonical_json, nfc, pointer
from lorekeep.operators import claims as claim_ops

SNAK = "struct<snaktype:string,property:string,datatype:string,datavalue:struct<type:string,value:string>>"
_NAME = "struct<language:string,value:string>"
STATEMENT = f"struct<id:string,rank:string,mainsnak:{SNAK},qualifiers:map<string,array<{SNAK}>>,`qualifiers-order`:array<string>,references:array<struct<hash:string,snaks:map<string,array<{SNAK}>>,`snaks-order`:array<string>>>>"
ENTITY = f"struct<lastrevid:bigint,missing:string,labels:map<string,{_NAME}>,aliases:map<string,array<{_NAME}>>,descriptions:map<string,{_NAME}>,sitelinks:map<string,struct<site:string,title:string>>,claims:map<string,array<{STATEMENT}>>>"
_CELL = "struct<value:string,`xml:lang`:string>"
#: The calendar that a time value names when it is Julian; a fixed value of the source.
JULIAN = "http://www.wikidata.org/entity/Q1985786"


def entities(payloads: DataFrame) -> DataFrame:
    """name, retrieved_at, id, entity of every entity that is there; content that is no payload is an error."""
    parsed = payloads.select("name", "retrieved_at", F.from_json("content", f"struct<entities:map<string,{ENTITY}>>")["entities"].alias("e"))
    bad = F.raise_error(F.concat(F.lit("no entities in "), F.col("name"))).cast("boolean")
    rows = parsed.where(F.when(F.col("e").isNotNull(), True).otherwise(bad)).select("name", "retrieved_at", F.explode("e").alias("id", "entity"))
    return rows.where("entity.missing is null")


def snak_columns(snak: Column) -> dict[str, Column]:
    """snak_type, object (a scoped id), value (strings as they are, others canonical), datatype."""
    kind, raw = snak["datavalue"]["type"], snak["datavalue"]["value"]
    known = snak["snaktype"] == "value"
    is_entity = known & (kind == "wikibase-entityid")
    letter = F.when(F.get_json_object(raw, "$.entity-type") == "property", "P").otherwise("Q")
    entity = F.coalesce(F.get_json_object(raw, "$.id"), F.concat(letter, F.get_json_object(raw, "$.numeric-id")))
    structured = F.when(known & ~kind.isin("wikibase-entityid", "string"), raw)
    return {
        "snak_type": snak["snaktype"],
        "object": F.when(is_entity, F.concat(F.lit("wd/"), entity)),
        "value": F.coalesce(F.when(known & (kind == "string"), raw), canonical_json(structured)),
        "datatype": snak["datatype"],
    }


def _scoped(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.concat(F.lit("wd/"), F.col("snak.property")).alias("property"), *(c.alias(n) for n, c in snak_columns(F.col("snak")).items()))


def _in_order(order: Column, snaks: Column) -> Column:
    """The snaks of a map, property after property as the order names them."""
    return F.flatten(F.transform(F.coalesce(order, F.map_keys(snaks)), lambda p: F.coalesce(F.get(F.array(snaks[p]), 0), F.array().cast(f"array<{SNAK}>"))))


def statements(payloads: DataFrame) -> dict[str, DataFrame]:
    """claims: one for each statement, with the JSON Pointer to it and the world time that its qualifiers state;
    qualifiers and references: their snaks in the order of the source."""
    rows = entities(payloads).select("name", "retrieved_at", "id", F.col("entity.lastrevid").alias("source_revision"), F.explode("entity.claims").alias("pid", "list"))
    rows = rows.select("*", F.posexplode("list").alias("i", "st")).drop("list")
    at = F.concat(F.lit("/entities/"), pointer(F.col("id")), F.lit("/claims/"), pointer(F.col("pid")), F.lit("/"), F.col("i"))
    main = rows.select(
        F.col("st.id").alias("statement_id"), F.concat(F.lit("wd/"), F.col("id")).alias("subject"), F.concat(F.lit("wd/"), F.col("pid")).alias("predicate"),
        F.col("st.rank").alias("rank"), "source_revision", at.alias("source_pointer"), F.col("name").alias("source"), F.col("retrieved_at").alias("recorded_at"),
        *(c.alias(n) for n, c in snak_columns(F.col("st.mainsnak")).items()),
    )
    listed = _in_order(F.col("st.qualifiers-order"), F.col("st.qualifiers"))
    snaks = rows.where("st.qualifiers is not null").select(F.col("name").alias("source"), F.col("st.id").alias("statement_id"), F.posexplode(listed).alias("ord", "snak"))
    qualifiers = _scoped(snaks, "source", "statement_id", "ord")
    refs = rows.select(F.col("name").alias("source"), F.col("st.id").alias("statement_id"), F.explode("st.references").alias("ref"))
    refs = refs.select("source", "statement_id", F.col("ref.hash").alias("ref_hash"), F.posexplode(_in_order(F.col("ref.snaks-order"), F.col("ref.snaks"))).alias("ord", "snak"))
    spans = claim_ops.validity(timed(snaks))
    return {"claims": main.join(spans, ["source", "statement_id"], "left"), "qualifiers": qualifiers, "references": _scoped(refs, "source", "statement_id", "ref_hash", "ord")}


def timed(snaks: DataFrame) -> DataFrame:
    """The start, end and point-in-time qualifiers (source, statement_id, snak), read as world time."""
    raw = F.col("snak.datavalue.value")
    known = (F.col("snak.snaktype") == "value") & (F.col("snak.datavalue.type") == "time")
    field = lambda name: F.when(known, F.get_json_object(raw, f"$.{name}"))
    rows = snaks.where(F.col("snak.property").isin("P580", "P582", "P585")).select(
        "source", "statement_id", F.col("snak.property").alias("property"),
        field("time").alias("time"), field("precision").cast("int").alias("precision"), (field("calendarmodel") == JULIAN).alias("julian"),
    )
    return worldtime.read_times(rows, "time", "precision", "julian")


def names(payloads: DataFrame) -> DataFrame:
    """id, lang, kind (pref, alt, desc), text (NFC) of the entities."""
    rows = entities(payloads).select("id", "entity")
    one = lambda column, kind: rows.select("id", F.explode(f"entity.{column}").alias("lang", "v")).select("id", "lang", F.lit(kind).alias("kind"), F.col("v.value").alias("text"))
    many = rows.select("id", F.explode("entity.aliases").alias("lang", "list")).select("id", "lang", F.explode("list").alias("v"))
    every = one("labels", "pref").unionByName(many.select("id", "lang", F.lit("alt").alias("kind"), F.col("v.value").alias("text"))).unionByName(one("descriptions", "desc"))
    return every.withColumn("text", nfc("text"))


def display_names(payloads: DataFrame) -> DataFrame:
    """id, label: the English name, else the one for all languages, else the id."""
    label = lambda lang: F.get(F.array(F.col("entity.labels")[lang]["value"]), 0)
    return entities(payloads).select("id", F.coalesce(F.nullif(label("en"), F.lit("")), F.nullif(label("mul"), F.lit("")), F.col("id")).alias("label"))


def donated(names_: DataFrame, matches: DataFrame, own: DataFrame) -> DataFrame:
    """Names of items for the concepts that accepted exact or close matches (concept_id, id) tie them to: concept_id, lang,
    kind, text. The English name becomes an alternative; an alternative equal to the preferred name of its language, the
    concept's own (own: concept_id, lang, text) before the item's, is dropped."""
    rows = names_.join(matches.select("concept_id", "id"), "id").select("concept_id", "lang", "kind", "text")
    pref = rows.where("kind = 'pref'").select("concept_id", "lang", F.col("text").alias("theirs")).dropDuplicates(["concept_id", "lang"])
    ours = own.select("concept_id", "lang", F.col("text").alias("ours")).dropDuplicates(["concept_id", "lang"])
    rows = rows.withColumn("kind", F.when((F.col("lang") == "en") & (F.col("kind") == "pref"), "alt").otherwise(F.col("kind")))
    rows = rows.join(pref, ["concept_id", "lang"], "left").join(ours, ["concept_id", "lang"], "left")
    same = (F.col("kind") == "alt") & F.coalesce("ours", "theirs").eqNullSafe(F.col("text"))
    return rows.where(~same).select("concept_id", "lang", "kind", "text").distinct()


#: Sites that are no language edition, and editions that robots wrote for the most part: fixed values of the source.
PROJECTS = ("commonswiki", "specieswiki", "metawiki", "mediawikiwiki", "wikidatawiki", "sourceswiki")
ROBOTS = ("cebwiki", "warwiki")


def editions(sites: Column, with_robots: bool = False, projects: tuple[str, ...] = PROJECTS, robots: tuple[str, ...] = ROBOTS) -> Column:
    """Of an array of sites, the language editions."""
    out = projects if with_robots else projects + robots
    return F.filter(sites, lambda s: F.endswith(s, F.lit("wiki")) & ~s.isin(*out))


def sitelink_counts(payloads: DataFrame) -> DataFrame:
    """id, sitelinks, sitelinks_all (robots' editions too), enwiki (the title there)."""
    sites = F.coalesce(F.map_keys("entity.sitelinks"), F.array().cast("array<string>"))
    title = F.get(F.array(F.col("entity.sitelinks")["enwiki"]["title"]), 0)
    return entities(payloads).select("id", F.size(editions(sites)).alias("sitelinks"), F.size(editions(sites, True)).alias("sitelinks_all"), title.alias("enwiki"))


def referenced(payloads: DataFrame) -> DataFrame:
    """id: every item and property that statements, qualifiers and references name."""
    rows = entities(payloads).select(F.explode("entity.claims").alias("pid", "list")).select(F.explode("list").alias("st"))
    none = F.array().cast(f"array<{SNAK}>")
    flat = lambda snaks: F.coalesce(F.flatten(F.map_values(snaks)), none)
    refs = F.coalesce(F.flatten(F.transform("st.references", lambda r: flat(r["snaks"]))), none)
    snak = rows.select(F.explode(F.concat(F.array("st.mainsnak"), flat(F.col("st.qualifiers")), refs)).alias("s"))
    item = F.when((F.col("s.snaktype") == "value") & (F.col("s.datavalue.type") == "wikibase-entityid"), F.get_json_object("s.datavalue.value", "$.id"))
    return snak.select(F.explode(F.array("s.property", item)).alias("id")).where(F.col("id").rlike(r"^[QP]\d+$")).distinct()


def summaries(payloads: DataFrame) -> DataFrame:
    """subject, predicate, object, rank, object_label, source, recorded_at of result tables of the query service; values
    that are no items are left out."""
    row = f"struct<item:{_CELL},pid:{_CELL},value:{_CELL},valueLabel:{_CELL},rank:{_CELL}>"
    parsed = payloads.select("name", "retrieved_at", F.explode(F.from_json("content", f"struct<results:struct<bindings:array<{row}>>>")["results"]["bindings"]).alias("b"))
    last = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    item = last(F.col("b.value.value"))
    rank = F.lower(F.replace(F.regexp_extract(F.col("b.rank.value"), r"([^#]*)$", 1), F.lit("Rank"), F.lit("")))
    scoped = lambda c: F.concat(F.lit("wd/"), c)
    rows = parsed.where(item.rlike(r"^Q\d+$"))
    return rows.select(scoped(last(F.col("b.item.value"))).alias("subject"), scoped(F.col("b.pid.value")).alias("predicate"), scoped(item).alias("object"), rank.alias("rank"), F.coalesce("b.valueLabel.value", item).alias("object_label"), F.col("name").alias("source"), F.col("retrieved_at").alias("recorded_at"))


def covered(payloads: DataFrame) -> DataFrame:
    """subject, at: when which entity was read, for ``claims.supersede``."""
    return entities(payloads).select(F.concat(F.lit("wd/"), F.col("id")).alias("subject"), F.col("retrieved_at").alias("at")).distinct()
