"""Tables of the web: statistical regions, indicators, encyclopedia pages, captions, candidates for matches, and the
registry of sources. Content is read as it was stored; nothing is fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import flat_html, spelling
from lorekeep.operators.imports import problems
from lorekeep.operators.search import passages


def regions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (lang, seq, global_code, global_name, region_code, region_name, sub_code, sub_name, mid_code, mid_name, code,
    name) of one table for each language -> names (code, lang, text) and parents (child, parent): each place below the
    narrowest group it has; of several parents of a code the first stays."""
    chain = [("global_code", "global_name"), ("region_code", "region_name"), ("sub_code", "sub_name"), ("mid_code", "mid_name"), ("code", "name")]
    steps = F.filter(F.array(*(F.struct(F.col(c).alias("code"), F.col(n).alias("text")) for c, n in chain)), lambda x: F.coalesce(x["code"], F.lit("")) != "")
    levels = rows.select("lang", "seq", steps.alias("s"))
    names = levels.select("lang", F.explode("s").alias("x")).select("x.code", "lang", "x.text").where("coalesce(text, '') <> ''").distinct()
    pairs = F.transform(F.slice("s", 2, F.size("s")), lambda x, i: F.struct(x["code"].alias("child"), F.get("s", i)["code"].alias("parent")))
    ups = levels.where("size(s) > 1").select("seq", F.explode(pairs).alias("p")).select("seq", "p.child", "p.parent").where("child <> parent")
    return names, ups.groupBy("child").agg(F.min_by("parent", F.struct("seq", "parent")).alias("parent"))


def indicators(content: DataFrame, countries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """content (content: JSON [page, [{countryiso3code, date, value}]]) and countries (iso3, id) -> id, year, value: the
    latest known value of each country; and codes without a country. Aggregates have no code and are dropped."""
    point = "array<struct<countryiso3code:string,date:string,value:double>>"
    rows = content.select(F.explode(F.from_json(F.get_json_object("content", "$[1]"), point)).alias("x"))
    rows = rows.select(F.col("x.countryiso3code").alias("iso3"), F.col("x.date").try_cast("int").alias("year"), F.col("x.value").alias("value")).where("iso3 rlike '^[A-Z]{3}$' and value is not null and year is not null")
    last = rows.groupBy("iso3").agg(F.max(F.struct("year", "value")).alias("x")).select("iso3", "x.year", "x.value")
    return last.join(countries, "iso3").select("id", "year", "value"), last.join(countries, "iso3", "left_anti").select("iso3")


def unverified(captions: DataFrame, pages: DataFrame) -> DataFrame:
    """id, problem of captions (id, url, quote) that the stored page (url, html) of their address does not say."""
    both = captions.join(pages.select("url", flat_html("html").alias("_page")), "url", "left")
    return both.select("id", F.when(F.col("_page").isNull(), "no page").when(~F.contains("_page", flat_html("quote")), "not on the page").alias("problem")).where("problem is not null")


def introductions(content: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """content (corpus, name, content: JSON of a query for extracts) -> documents (doc_id, corpus, title, text), passages
    (doc_id, ord, start, end, text) and redirects (alias, title)."""
    page = "array<struct<title:string,extract:string,missing:boolean>>"
    turn = "array<struct<from:string,to:string>>"
    q = content.select("corpus", F.from_json(F.get_json_object("content", "$.query.pages"), page).alias("pages"), *(F.from_json(F.get_json_object("content", f"$.query.{k}"), turn).alias(k) for k in ("normalized", "redirects")))
    found = q.select("corpus", F.explode("pages").alias("p")).where("not coalesce(p.missing, false) and coalesce(p.extract, '') <> ''")
    documents = found.select(F.concat_ws("/", F.lit("doc"), "corpus", "p.title").alias("doc_id"), "corpus", F.col("p.title").alias("title"), F.col("p.extract").alias("text")).distinct()
    aliases = None
    for k in ("normalized", "redirects"):
        part = q.select(F.explode(k).alias("r")).select(F.col("r.from").alias("alias"), F.col("r.to").alias("title"))
        aliases = part if aliases is None else aliases.unionByName(part)
    return documents, passages(documents, "doc_id", "text").withColumnRenamed("id", "doc_id"), aliases.distinct()


#: Descriptions of pages, works and people's names, which are no concepts: fixed patterns.
JUNK_ANYWHERE = r"(?i)Wikimedia (disambiguation|category|template|list|project)|scholarly article|scientific article|\bfamily name\b|\bgiven name\b|\bsurname\b"
JUNK_AT_START = r"(?i)^(?:\d{3,4}s? )?(?:\w+ )?(?:film|album|song|single|novel|book|painting|episode|video game|band|journal|thesis|village|asteroid)\b"


def junk(description: Column) -> Column:
    return F.coalesce(description.rlike(JUNK_ANYWHERE) | description.rlike(JUNK_AT_START), F.lit(False))


def reconciled(concepts: DataFrame, candidates: DataFrame, keep: int = 5) -> DataFrame:
    """concepts (id, text: a spelling each) and candidates (qid, text, description, rank, sitelinks) -> id, qid, exact,
    junk, place from 1: the best of equal spelling, those that are no concepts last, then by the search's rank, sitelinks
    and number. Only equal spellings meet."""
    left = concepts.select("id", "text", spelling("text").alias("_s")).where("_s <> ''")
    right = candidates.withColumn("_s", spelling("text")).withColumnRenamed("text", "_name")
    both = left.join(right, "_s").groupBy("id", "qid").agg(F.max((F.col("text") == F.col("_name")).cast("int")).alias("e"), F.min(junk(F.col("description")).cast("int")).alias("j"), F.min("rank").alias("rank"), F.max("sitelinks").alias("sitelinks"))
    number = F.regexp_extract("qid", r"(\d+)", 1).cast("long")
    best = F.slice(F.array_sort(F.collect_list(F.struct("j", "rank", (-F.col("sitelinks")).alias("s"), number.alias("n"), "qid", "e"))), 1, keep)  # candidates of one concept
    return both.groupBy("id").agg(best.alias("b")).select("id", F.posexplode("b").alias("place", "x")).select("id", "x.qid", (F.col("x.e") == 1).alias("exact"), (F.col("x.j") == 1).alias("junk"), (F.col("place") + 1).alias("place"))


# The registry


def registry_problems(sources: DataFrame, files: DataFrame, converters: list[str]) -> DataFrame:
    """key, problem of sources (id, title, scheme, converter, license) and their files (source, name, url, sha512)."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    own = problems(
        sources, F.col("id"),
        {
            "bad id": ~F.coalesce(F.col("id").rlike("^[a-z][a-z0-9-]*$"), F.lit(False)), "no title": empty("title"), "no license": empty("license"),
            "unknown converter": ~F.coalesce(F.col("converter").isin(*converters), F.lit(False)), "bad scheme": ~F.coalesce(F.col("scheme").rlike("^[a-z][a-z0-9]*$"), F.lit(False)),
        },
    )
    theirs = problems(
        files, F.concat_ws("/", "source", "name"),
        {
            "bad address": ~F.coalesce(F.col("url").rlike("^(https?|file)://"), F.lit(False)), "no name": empty("name"), "name leaves its folder": F.col("name").rlike(r"(^|/)\.\.(/|$)|^/"),
            "bad hash": ~empty("sha512") & ~F.col("sha512").rlike("^[0-9a-f]{128}$"),
        },
    )
    lost = files.join(sources.select(F.col("id").alias("source")), "source", "left_anti").select(F.concat_ws("/", "source", "name").alias("key"), F.lit("no such source").alias("problem"))
    twice = sources.groupBy("id").count().where("count > 1").select(F.col("id").alias("key"), F.lit("listed twice").alias("problem"))
    return own.unionByName(theirs).unionByName(lost).unionByName(twice)


def expanded(chosen: DataFrame, presets: DataFrame) -> DataFrame:
    """id: chosen names with presets (preset, id) replaced by their sources."""
    named = chosen.join(presets.select(F.col("preset").alias("name"), "id"), "name", "left")
    return named.select(F.coalesce("id", "name").alias("id")).distinct()


def conflicts(sources: DataFrame, chosen: DataFrame) -> DataFrame:
    """scheme, ids of schemes that more than one chosen source would fill."""
    rows = sources.join(chosen.select("id").distinct(), "id", "left_semi").groupBy("scheme").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return rows.where("size(ids) > 1").select("scheme", F.array_join("ids", ",").alias("ids"))
