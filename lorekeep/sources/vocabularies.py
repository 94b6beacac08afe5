"""Published vocabularies as lean frames. Most are declared mappings over tables or JSON; each function takes paths and
returns a Lean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.sources.lean import Lean, resolved
from lorekeep.sources.readers import record_jar, taxonomy_dump, tree_parents

TERM, LABEL, REL = "code string, status int", "code string, kind int, lang string, text string", "s string, pred string, o string"
ATTR, LINK = "code string, pred string, value_int bigint, value_real double, value_text string", "code string, pred string, map string, target string"


def _tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated without quoting; # lines are comments, empty cells null."""
    cells = F.split("value", "\t", -1)
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.col("value") != ""))
    return rows.select(*(F.nullif(F.get(cells, i), F.lit("")).alias(c) for i, c in enumerate(columns)))


def _labels(df: DataFrame, code: str | Column, kind: int | Column, lang: str | Column, text: str | Column) -> DataFrame:
    column = lambda x: x if isinstance(x, Column) else F.col(x)
    lang = lang if isinstance(lang, Column) else F.lit(lang)
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return df.select(column(code).cast("string").alias("code"), kind.cast("int").alias("kind"), lang.alias("lang"), column(text).alias("text")).where("text is not null and text <> ''")


def _rels(df: DataFrame, s: str, o: str, pred: str | Column = "broader") -> DataFrame:
    pred = pred if isinstance(pred, Column) else F.lit(pred)
    return df.select(F.col(s).cast("string").alias("s"), pred.alias("pred"), F.col(o).cast("string").alias("o")).where("s is not null and o is not null and s <> o and o <> ''")


def _attrs(df: DataFrame, code: str, values: dict[str, str]) -> DataFrame:
    """values: column to int, float or text."""
    none = {"int": F.lit(None).cast("bigint"), "float": F.lit(None).cast("double"), "text": F.lit(None).cast("string")}
    out = None
    for c, kind in values.items():
        v = F.col(c)
        cast = {**none, kind: v.try_cast({"int": "bigint", "float": "double", "text": "string"}[kind])}
        part = df.where(v.isNotNull()).select(F.col(code).cast("string").alias("code"), F.lit(c).alias("pred"), cast["int"].alias("value_int"), cast["float"].alias("value_real"), cast["text"].alias("value_text"))
        out = part if out is None else out.unionByName(part)
    return out


def _links(df: DataFrame, code: str, pred: str | Column, target: str | Column, match: str | None = None) -> DataFrame:
    pred = pred if isinstance(pred, Column) else F.lit(pred)
    target = target if isinstance(target, Column) else F.col(target)
    return df.select(F.col(code).cast("string").alias("code"), pred.alias("pred"), F.lit(match).cast("string").alias("map"), target.cast("string").alias("target")).where("target is not null and target <> ''")


def _terms(df: DataFrame, code: str, gone: Column | None = None) -> DataFrame:
    status = F.lit(0) if gone is None else F.coalesce(gone, F.lit(False)).cast("int")
    return df.where(F.col(code).isNotNull()).groupBy(F.col(code).cast("string").alias("code")).agg(F.max(status).alias("status"))


def _lean(spark: SparkSession, term: DataFrame, label=(), rel=(), attr=(), link=()) -> Lean:
    def union(frames, schema):
        out = spark.createDataFrame([], schema)
        for f in frames:
            out = out.unionByName(f)
        return out.distinct()

    return resolved(Lean(term, union(label, LABEL), union(rel, REL), union(attr, ATTR), union(link, LINK)))


def geonames(spark: SparkSession, countries: str, admin1: str, places: str, names: str | None = None, hierarchy: str | None = None) -> Lean:
    """Countries above first-level areas above places. Alternate names count if their language is one, links apart."""
    country = _tsv(spark, countries, ["iso", "iso3", "num", "fips", "name", "capital", "area", "population", "continent", "tld", "currency", "currency_name", "phone", "post", "post_re", "languages", "code", "neighbours"])
    area = _tsv(spark, admin1, ["key", "name", "ascii", "code"])
    place = _tsv(spark, places, ["code", "name", "ascii", "alternates", "lat", "lon", "class", "feature", "iso", "cc2", "a1", "a2", "a3", "a4", "population", "elevation", "dem", "zone", "changed"])
    by_iso = country.select("iso", F.col("code").alias("country"))
    by_key = area.select("key", F.col("code").alias("area"))
    up_area = area.withColumn("iso", F.split_part("key", F.lit("."), F.lit(1))).join(by_iso, "iso")
    own = place.join(country.select("code").unionByName(area.select("code")), "code", "left_anti")
    up_place = own.withColumn("key", F.concat_ws(".", "iso", "a1")).join(by_key, "key", "left").join(by_iso, "iso", "left").withColumn("up", F.coalesce("area", "country"))
    term = _terms(country.select("code").unionByName(area.select("code")).unionByName(place.select("code")), "code")
    label = [_labels(x, "code", 0, "", "name") for x in (country, area, own)]
    link = []
    if names:
        alt = _tsv(spark, names, ["id", "code", "lang", "name", "preferred", "short", "colloquial", "historic"]).join(term.select("code"), "code", "left_semi")
        tongue = F.col("lang").rlike("^[a-z]{2,3}(-[A-Za-z]+)*$")
        label.append(_labels(alt.where(tongue), "code", F.when(F.col("preferred") == "1", 0).when((F.col("historic") == "1") | (F.col("colloquial") == "1"), 2).otherwise(1), F.lower("lang"), "name"))
        link.append(_links(alt.where("lang in ('link', 'wkdt')"), "code", F.col("lang"), "name"))
    rel = [_rels(up_area, "code", "country"), _rels(up_place, "code", "up")]
    if hierarchy:
        rel.append(_rels(_tsv(spark, hierarchy, ["up", "code", "kind"]), "code", "up"))
    return _lean(spark, term, label, rel, [_attrs(own, "code", {"lat": "float", "lon": "float", "population": "int", "feature": "text"})], link)


def iso_639_3(spark: SparkSession, codes: str, names: str | None = None, macros: str | None = None, retired: str | None = None) -> Lean:
    """Languages under their macrolanguages; retired codes are deprecated. The files have a header."""
    read = lambda p, cols: _tsv(spark, p, cols).where(f"{cols[0]} not in ('Id', 'M_Id')")
    main = read(codes, ["code", "part2b", "part2t", "part1", "scope", "type", "name", "comment"])
    term, label = _terms(main, "code"), [_labels(main, "code", 0, "en", "name")]
    rel, attr = [], [_attrs(main, "code", {"scope": "text", "type": "text", "part1": "text"})]
    if names:
        label.append(_labels(read(names, ["code", "name", "inverted"]), "code", 1, "en", "name"))
    if macros:
        rel.append(_rels(read(macros, ["up", "code", "status"]), "code", "up"))
    if retired:
        gone = read(retired, ["code", "name", "reason", "change_to", "remedy", "day"]).join(term, "code", "left_anti")
        term = term.unionByName(_terms(gone, "code", F.lit(True)))
        label.append(_labels(gone, "code", 0, "en", "name"))
        attr.append(_attrs(gone.withColumnRenamed("change_to", "replacedBy"), "code", {"replacedBy": "text"}))
    return _lean(spark, term, label, rel, attr)


#: Name classes of the taxonomy dump: language and label kind.
NAME_CLASSES = {"scientific name": ("la", 0), "genbank common name": ("en", 0), "common name": ("en", 1), "synonym": ("la", 1), "equivalent name": ("la", 1), "blast name": ("en", 1), "acronym": ("", 1), "authority": ("la", 2), "includes": ("la", 2)}


def ncbi_taxonomy(spark: SparkSession, nodes: str, names: str) -> Lean:
    """The root is its own parent in the dump and has none here."""
    node = taxonomy_dump(spark.read.text(nodes), ["code", "up", "rank"])
    name = taxonomy_dump(spark.read.text(names), ["code", "text", "unique", "class"])
    kind, lang = F.lit(2), F.lit("")
    for c, (tongue, k) in NAME_CLASSES.items():
        kind, lang = F.when(F.col("class") == c, k).otherwise(kind), F.when(F.col("class") == c, tongue).otherwise(lang)
    return _lean(spark, _terms(node, "code"), [_labels(name, "code", kind, lang, "text")], [_rels(node, "code", "up")], [_attrs(node, "code", {"rank": "text"})])


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON file: its path and content."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("j"))


def cldr_names(spark: SparkSession, path: str, kind: str = "languages") -> Lean:
    """Display names of languages or territories in every locale; variants after -alt- are alternatives."""
    schema = f"main map<string, struct<localeDisplayNames: struct<{kind}: map<string, string>>>>"
    rows = _documents(spark, path, schema).select(F.explode("j.main").alias("locale", "x")).select("locale", F.explode(f"x.localeDisplayNames.{kind}").alias("key", "text"))
    rows = rows.withColumn("code", F.regexp_replace("key", "-alt-.*$", ""))
    return _lean(spark, _terms(rows, "code"), [_labels(rows, "code", F.contains(F.col("key"), F.lit("-alt-")).cast("int"), F.lower("locale"), "text")])


def cldr_containment(spark: SparkSession, path: str) -> DataFrame:
    """child, parent of territories; grouping and deprecated entries are left out."""
    schema = "supplemental struct<territoryContainment: map<string, struct<_contains: array<string>>>>"
    rows = _documents(spark, path, schema).select(F.explode("j.supplemental.territoryContainment").alias("parent", "x")).where(~F.contains("parent", F.lit("-status-")))
    return rows.select(F.explode("x._contains").alias("child"), "parent").where("child <> parent").distinct()


def periodo(spark: SparkSession, path: str) -> Lean:
    """Periods of authorities, each under its authority, with the years they span."""
    years = "struct<in: struct<year: string, earliestYear: string, latestYear: string>>"
    period = f"struct<id: string, label: string, localizedLabels: map<string, array<string>>, broader: string, start: {years}, stop: {years}, spatialCoverageDescription: string>"
    rows = _documents(spark, path, f"authorities map<string, struct<id: string, periods: map<string, {period}>>>").select(F.explode("j.authorities").alias("authority", "a"))
    p = rows.select("authority", F.explode("a.periods").alias("code", "p")).select("authority", "code", "p.*")
    first = F.coalesce("start.in.year", "start.in.earliestYear")
    last = F.coalesce("stop.in.year", "stop.in.latestYear")
    p = p.withColumns({"first_year": first, "last_year": last})
    local = p.select("code", F.explode("localizedLabels").alias("lang", "texts")).select("code", "lang", F.posexplode("texts").alias("i", "text"))
    term = _terms(p.select("code").unionByName(rows.select(F.col("authority").alias("code"))), "code")
    return _lean(
        spark, term, [_labels(p, "code", 1, "", "label"), _labels(local, "code", (F.col("i") > 0).cast("int"), F.lower("lang"), "text")],
        [_rels(p, "code", "broader"), _rels(p, "code", "authority", "related")], [_attrs(p, "code", {"first_year": "int", "last_year": "int"})],
    )


MESH = (
    "DescriptorUI string, DescriptorName struct<String: string>, TreeNumberList struct<TreeNumber: array<string>>, "
    "ConceptList struct<Concept: array<struct<ScopeNote: string, TermList: struct<Term: array<struct<String: string>>>>>>"
)


def mesh(spark: SparkSession, path: str) -> Lean:
    """Descriptors; the hierarchy is in their tree numbers."""
    rows = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(MESH).load(path).withColumnRenamed("DescriptorUI", "code")
    concepts = rows.select("code", F.col("DescriptorName.String").alias("name"), F.explode("ConceptList.Concept").alias("c"))
    other = concepts.select("code", "name", F.explode("c.TermList.Term.String").alias("text")).where("text <> name")
    trees = rows.select("code", F.explode("TreeNumberList.TreeNumber").alias("tree"))
    notes = concepts.select("code", F.trim("c.ScopeNote").alias("scopeNote"))
    return _lean(
        spark, _terms(rows, "code"), [_labels(rows, "code", 0, "en", F.col("DescriptorName.String")), _labels(other, "code", 1, "en", "text")],
        [_rels(tree_parents(trees), "child", "parent")], [_attrs(notes, "code", {"scopeNote": "text"})],
    )


def wikidata_dump(spark: SparkSession, path: str, classes: list[str] = (), ids: list[str] = (), least_sitelinks: int | None = None) -> Lean:
    """Items of a dump, one object a line: those listed, instances of the classes, or with enough sitelinks."""
    named = "map<string, struct<language: string, value: string>>"
    lists = "map<string, array<struct<language: string, value: string>>>"
    claim = "struct<rank: string, mainsnak: struct<snaktype: string, datatype: string, datavalue: struct<value: string>>>"
    schema = f"id string, labels {named}, aliases {lists}, descriptions {named}, claims map<string, array<{claim}>>, sitelinks map<string, struct<site: string, title: string>>"
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), ",$", "").alias("v")).where("v like '{%'")
    rows = lines.select(F.from_json("v", schema).alias("j")).select("j.*").where("id is not null")
    entity = lambda c: F.get_json_object(c["mainsnak"]["datavalue"]["value"], "$.id")
    kinds = F.coalesce(F.transform(F.col("claims")["P31"], entity), F.array().cast("array<string>"))
    keep = F.col("id").isin(list(ids)) | F.arrays_overlap(kinds, F.array(*map(F.lit, classes)) if classes else F.array().cast("array<string>"))
    if least_sitelinks is not None:
        keep = keep | (F.coalesce(F.cardinality("sitelinks"), F.lit(0)) >= least_sitelinks)
    rows = rows.where(keep)
    flat = rows.select(F.col("id").alias("s"), F.explode("claims").alias("prop", "list")).select("s", "prop", F.explode("list").alias("c")).where("c.rank <> 'deprecated' and c.mainsnak.snaktype = 'value'")
    flat = flat.withColumn("o", F.when(F.startswith("c.mainsnak.datavalue.value", F.lit("{")), entity(F.col("c"))))
    up = flat.where("prop in ('P31', 'P279', 'P361') and o is not null")
    outside = flat.where("c.mainsnak.datatype = 'external-id'")
    named_rows = lambda c: rows.select("id", F.explode(c).alias("lang", "x"))
    return _lean(
        spark, _terms(rows, "id"),
        [_labels(named_rows("labels"), "id", 0, F.lower("lang"), F.col("x.value")), _labels(named_rows("aliases").select("id", "lang", F.explode("x.value").alias("text")), "id", 1, F.lower("lang"), "text")],
        [_rels(up, "s", "o")], [_attrs(rows.withColumn("sitelinks", F.cardinality("sitelinks")), "id", {"sitelinks": "int"})], [_links(outside, "s", F.col("prop"), F.col("c.mainsnak.datavalue.value"))],
    )


#: WordNet relations that point down or back, and what they are the inverse of.
WN_INVERSE = {"hyponym": "hypernym", "instance_hyponym": "instance_hypernym", "mero_part": "holo_part", "mero_member": "holo_member", "mero_substance": "holo_substance", "is_caused_by": "causes", "is_entailed_by": "entails"}


def wordnet(spark: SparkSession, path: str) -> Lean:
    """A lexicon in LMF: synsets keyed by their interlingual index, else their id."""
    entries = spark.read.format("xml").option("rowTag", "LexicalEntry").option("attributePrefix", "_").schema("Lemma struct<_writtenForm: string>, Sense array<struct<_synset: string>>").load(path)
    sets = spark.read.format("xml").option("rowTag", "Synset").option("attributePrefix", "_").schema("_id string, _ili string, Definition array<string>, SynsetRelation array<struct<_relType: string, _target: string>>").load(path)
    key = sets.select(F.col("_id").alias("synset"), F.coalesce(F.nullif("_ili", F.lit("")), F.col("_id")).alias("code"))
    named = entries.select(F.col("Lemma._writtenForm").alias("text"), F.explode("Sense._synset").alias("synset")).join(key, "synset")
    rel = sets.select(F.col("_id").alias("synset"), F.explode("SynsetRelation").alias("r")).join(key, "synset").select(F.col("code").alias("a"), F.col("r._relType").alias("kind"), F.col("r._target").alias("synset"))
    rel = rel.join(key, "synset").select("a", "kind", F.col("code").alias("b"))
    turned, kind = F.col("kind").isin(*WN_INVERSE), F.col("kind")
    for k, v in WN_INVERSE.items():
        kind = F.when(F.col("kind") == k, v).otherwise(kind)
    rel = rel.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("s"), kind.alias("k"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("o"))
    pred = F.when(F.col("k").isin("hypernym", "instance_hypernym"), "broader").otherwise(F.col("k"))
    notes = sets.join(key, F.col("_id") == F.col("synset")).select("code", F.explode("Definition").alias("definition"))
    return _lean(spark, _terms(key, "code"), [_labels(named, "code", 1, "en", "text")], [_rels(rel, "s", "o", pred)], [_attrs(notes, "code", {"definition": "text"})])


def iana_subtags(spark: SparkSession, path: str) -> Lean:
    """The language subtag registry."""
    rows = record_jar(spark, path)
    flat = rows.groupBy("record").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f.replace("-", "_")) for f in ("Type", "Subtag", "Tag", "Deprecated", "Preferred-Value", "Macrolanguage")), F.collect_list(F.when(F.col("field") == "Description", F.col("value"))).alias("names"))
    flat = flat.where("Type is not null").withColumn("code", F.concat_ws("-", "Type", F.lower(F.coalesce("Subtag", "Tag"))))
    named = flat.select("code", F.posexplode("names").alias("i", "text"))
    up = flat.where("Macrolanguage is not null").withColumn("up", F.concat(F.lit("language-"), F.lower("Macrolanguage")))
    attr = flat.withColumn("replacedBy", F.when(F.col("Preferred_Value").isNotNull(), F.concat_ws("-", "Type", F.lower("Preferred_Value"))))
    return _lean(spark, _terms(flat, "code", F.col("Deprecated").isNotNull()), [_labels(named, "code", (F.col("i") > 0).cast("int"), "en", "text")], [_rels(up, "code", "up")], [_attrs(attr, "code", {"replacedBy": "text"})])


def openalex(spark: SparkSession, path: str) -> Lean:
    """Topics below subfields below fields below domains; one object a line, of any of these levels."""
    part = "struct<id: string, display_name: string>"
    schema = f"id string, display_name string, description string, keywords array<string>, subfield {part}, field {part}, domain {part}, ids map<string, string>"
    tail = lambda c: F.element_at(F.split(c, "openalex.org/"), -1)
    rows = spark.read.schema(schema).json(path).withColumn("code", tail("id"))
    rows = rows.withColumn("up", tail(F.coalesce("subfield.id", "field.id", "domain.id")))
    words = rows.select("code", F.explode("keywords").alias("text"))
    outside = rows.select("code", F.explode("ids").alias("k", "v")).where("k <> 'openalex'")
    return _lean(spark, _terms(rows, "code"), [_labels(rows, "code", 0, "en", "display_name"), _labels(words, "code", 2, "en", "text")], [_rels(rows, "code", "up")], [_attrs(rows, "code", {"description": "text"})], [_links(outside, "code", F.col("k"), "v")])


def ror(spark: SparkSession, path: str) -> Lean:
    """Organisations: one display name for each language, other names as alternatives."""
    name = "struct<value: string, lang: string, types: array<string>>"
    schema = f"id string, status string, names array<{name}>, relationships array<struct<type: string, id: string>>, external_ids array<struct<type: string, all: array<string>>>"
    tail = lambda c: F.element_at(F.split(c, "ror.org/"), -1)
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("code", tail("id"))
    named = rows.select("code", F.explode("names").alias("n"))
    kind = F.when(F.array_contains("n.types", "ror_display"), 0).when(F.array_contains("n.types", "label"), 0).otherwise(1)
    up = rows.select("code", F.explode("relationships").alias("r")).withColumn("o", tail("r.id"))
    pred = F.when(F.col("r.type") == "parent", "broader").otherwise(F.col("r.type"))
    outside = rows.select("code", F.explode("external_ids").alias("e")).select("code", "e.type", F.explode("e.all").alias("v"))
    return _lean(spark, _terms(rows, "code", F.col("status") != "active"), [_labels(named, "code", kind, F.coalesce("n.lang", F.lit("")), F.col("n.value"))], [_rels(up.where("r.type <> 'child'"), "code", "o", pred)], (), [_links(outside, "code", F.col("type"), "v")])


#: Converters by name.
CONVERTERS = {f.__name__: f for f in (geonames, iso_639_3, ncbi_taxonomy, cldr_names, periodo, mesh, wikidata_dump, wordnet, iana_subtags, openalex, ror)}
