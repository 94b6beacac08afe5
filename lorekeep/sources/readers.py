"""Readers of vocabularies: N-Triples, OBO, subtag registries, JSON lines, seed tables, HTML."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.sources.escapes import unescape
from lorekeep.sources.lean import Lean, resolved

#: One statement: subject, predicate, object (IRI, blank node or literal with language or type), an optional graph.
TRIPLE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*(?:<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'
SKOS = "http://www.w3.org/2004/02/skos/core#"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def ntriples(lines: DataFrame, doc: str = "") -> DataFrame:
    """lines (value) -> s, p, o, is_literal, lang, datatype. A line that is no statement is an error, whatever columns
    are read: the check is a filter."""
    part = lambda i: F.regexp_extract("value", TRIPLE, i)
    blank = lambda c: F.when(F.startswith(c, F.lit("_:")), F.concat(F.lit(f"_:{doc}:"), F.substring(c, F.lit(3), F.length(c)))).otherwise(c)
    bad = F.raise_error(F.concat(F.lit("not a statement: "), F.col("value"))).cast("boolean")
    rows = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$")).where(F.when(F.col("value").rlike(TRIPLE), True).otherwise(bad))
    literal = F.col("value").rlike(r'^\s*(?:<[^>]*>|_:\S+)\s+<[^>]*>\s+"')
    return rows.select(
        unescape(blank(F.regexp_replace(part(1), "^<|>$", ""))).alias("s"),
        unescape(part(2)).alias("p"),
        unescape(F.when(literal, part(5)).when(part(4) != "", blank(part(4))).otherwise(part(3))).alias("o"),
        literal.alias("is_literal"),
        F.nullif(F.lower(part(6)), F.lit("")).alias("lang"),
        F.nullif(unescape(part(7)), F.lit("")).alias("datatype"),
    )


def skos(triples: DataFrame, keep: str) -> Lean:
    """Concepts whose IRI begins with keep; codes are what follows it."""
    code = lambda c: F.when(F.startswith(c, F.lit(keep)), F.substring(c, F.lit(len(keep) + 1), F.length(c)))
    rows = triples.withColumn("code", code(F.col("s"))).withColumn("to", code(F.col("o")))
    term = rows.where((F.col("p") == TYPE) & (F.col("o") == SKOS + "Concept") & F.col("code").isNotNull()).select("code").distinct()
    dead = rows.where((F.col("p") == "http://www.w3.org/2002/07/owl#deprecated") & (F.col("o") == "true")).select("code").distinct().withColumn("status", F.lit(1))
    term = term.join(dead, "code", "left").select("code", F.coalesce("status", F.lit(0)).alias("status"))
    kinds = {SKOS + "prefLabel": 0, SKOS + "altLabel": 1, SKOS + "hiddenLabel": 2}
    label = rows.where(F.col("p").isin(*kinds) & F.col("is_literal") & F.col("code").isNotNull())
    kind = F.when(F.col("p") == SKOS + "prefLabel", 0).when(F.col("p") == SKOS + "altLabel", 1).otherwise(2)
    label = label.select("code", kind.alias("kind"), F.coalesce("lang", F.lit("")).alias("lang"), F.col("o").alias("text")).distinct()
    up = rows.where((F.col("p") == SKOS + "broader") & F.col("code").isNotNull()).select(F.col("code").alias("s"), F.lit("broader").alias("pred"), F.coalesce("to", "o").alias("o"))
    down = rows.where((F.col("p") == SKOS + "narrower") & F.col("to").isNotNull()).select(F.col("to").alias("s"), F.lit("broader").alias("pred"), F.coalesce("code", "s").alias("o"))
    side = rows.where((F.col("p") == SKOS + "related") & F.col("code").isNotNull()).select(F.col("code").alias("s"), F.lit("related").alias("pred"), F.coalesce("to", "o").alias("o"))
    rel = up.unionByName(down).unionByName(side).where("s <> o").distinct()
    none = F.lit(None)
    notes = rows.where(F.col("p").isin(SKOS + "definition", SKOS + "scopeNote", SKOS + "notation") & F.col("is_literal") & F.col("code").isNotNull())
    attr = notes.select("code", F.regexp_extract("p", "#(.*)$", 1).alias("pred"), none.cast("bigint").alias("value_int"), none.cast("double").alias("value_real"), F.col("o").alias("value_text")).distinct()
    match = rows.where(F.col("p").rlike("#(exact|close|broad|narrow|related)Match$") & F.col("code").isNotNull())
    link = match.select("code", F.regexp_extract("p", "#(.*)$", 1).alias("pred"), F.regexp_extract("p", "#(.*)$", 1).alias("map"), F.col("o").alias("target")).distinct()
    return resolved(Lean(term, label, rel, attr, link))


def obo(spark: SparkSession, path: str) -> Lean:
    """Terms of an OBO file, split into stanzas by the reader."""
    stanzas = spark.read.option("lineSep", "\n[").text(path).where(F.startswith("value", F.lit("Term]")))
    code = F.regexp_extract("value", r"(?m)^id:\s*(\S+)", 1)
    rows = stanzas.select(F.replace(code, F.lit(":"), F.lit("_")).alias("code"), F.split("value", "\n").alias("lines"))
    line = rows.select("code", F.explode("lines").alias("l")).select("code", F.regexp_extract("l", r"^(\w+):\s*", 1).alias("tag"), F.regexp_extract("l", r"^\w+:\s*(.*?)\s*$", 1).alias("v"))
    bare = F.trim(F.regexp_replace(F.regexp_replace("v", r"(?<!\\)!.*$", ""), r"\{.*\}\s*$", ""))
    quoted = F.regexp_replace(F.regexp_extract("v", r'^"((?:[^"\\]|\\.)*)"', 1), r'\\(.)', "$1")
    dead = line.where("tag = 'is_obsolete' and v like 'true%'").select("code").distinct().withColumn("status", F.lit(1))
    term = rows.select("code").distinct().join(dead, "code", "left").select("code", F.coalesce("status", F.lit(0)).alias("status"))
    scope = F.regexp_extract("v", r'"\s+(EXACT|BROAD|NARROW|RELATED)', 1)
    kind = F.when(scope == "BROAD", 3).when(scope == "NARROW", 4).when(scope == "RELATED", 5).otherwise(1)
    names = line.where("tag = 'name'").select("code", F.lit(0).alias("kind"), F.lit("en").alias("lang"), bare.alias("text"))
    label = names.unionByName(line.where("tag = 'synonym'").select("code", kind.alias("kind"), F.lit("en").alias("lang"), quoted.alias("text"))).distinct()
    to = lambda c: F.replace(F.split(c, r"\s+")[0], F.lit(":"), F.lit("_"))
    isa = line.where("tag = 'is_a'").select(F.col("code").alias("s"), F.lit("broader").alias("pred"), to(bare).alias("o"))
    ship = line.where("tag = 'relationship'")
    verb = F.split(bare, r"\s+")
    other = ship.select(F.col("code").alias("s"), F.when(verb[0] == "part_of", "broader").otherwise(verb[0]).alias("pred"), F.replace(verb[1], F.lit(":"), F.lit("_")).alias("o"))
    none = F.lit(None)
    attr = line.where("tag = 'def'").select("code", F.lit("definition").alias("pred"), none.cast("bigint").alias("value_int"), none.cast("double").alias("value_real"), quoted.alias("value_text")).distinct()
    link = line.where("tag = 'xref'").select("code", F.lit("xref").alias("pred"), none.cast("string").alias("map"), bare.alias("target")).distinct()
    return resolved(Lean(term, label, isa.unionByName(other).where("s <> o").distinct(), attr, link))


def record_jar(spark: SparkSession, path: str) -> DataFrame:
    """record, field, value of %%-separated records with folded lines, in their order."""
    rows = spark.read.option("lineSep", "%%\n").text(path).select(F.monotonically_increasing_id().alias("record"), F.regexp_replace("value", r"\n[ \t]+", " ").alias("v"))
    lines = rows.select("record", F.explode(F.split("v", "\n")).alias("l")).where(F.col("l").rlike(r"^[A-Za-z-]+:"))
    return lines.select("record", F.regexp_extract("l", r"^([A-Za-z-]+):\s*(.*)$", 1).alias("field"), F.regexp_extract("l", r"^([A-Za-z-]+):\s*(.*)$", 2).alias("value"))


def strict_tsv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """A table with exactly this header; # lines are comments, cells missing at the end are empty, more are an error."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.col("value") != ""))
    first = lines.first()
    if first is None or first["value"].split("\t") != header:
        raise ValueError(f"the header of {path} is not {header}")
    cells = F.split("value", "\t", -1)
    rows = lines.where(F.col("value") != "\t".join(header))
    cell = lambda i: F.when(F.size(cells) > len(header), F.raise_error(F.concat(F.lit("too many cells: "), F.col("value"))).cast("string")).otherwise(F.coalesce(F.get(cells, i), F.lit("")))
    return rows.select(*(cell(i).alias(c) for i, c in enumerate(header)))


def when_span(text):
    """from/to with open ends -> two nullable years."""
    end = lambda c: F.when(c.isin("", ".."), None).otherwise(c).try_cast("int")
    a, b = F.split_part(text, F.lit("/"), F.lit(1)), F.split_part(text, F.lit("/"), F.lit(2))
    return end(a), F.when(F.contains(text, F.lit("/")), end(b)).otherwise(end(a))


def taxonomy_dump(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of tab-bar-tab tables."""
    cells = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
    return lines.select(*(F.trim(F.get(cells, i)).alias(c) for i, c in enumerate(columns)))


def tree_parents(numbers: DataFrame) -> DataFrame:
    """numbers (code, tree) -> child, parent by dotted prefixes."""
    up = numbers.withColumn("_up", F.regexp_replace("tree", r"\.[^.]+$", "")).where("_up <> tree")
    return up.join(numbers.select(F.col("tree").alias("_up"), F.col("code").alias("parent")), "_up").select(F.col("code").alias("child"), "parent").where("child <> parent").distinct()


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
        elif self.open and tag == "tr":
            self.open[-1].append([])
        elif self.open and tag in ("td", "th"):
            if not self.open[-1]:
                self.open[-1].append([])
            self.open[-1][-1].append("")

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.done.append([[" ".join(c.split()) for c in row] for row in self.open.pop()])

    def handle_data(self, data):
        if self.open and self.open[-1] and self.open[-1][-1]:
            self.open[-1][-1][-1] += data


@F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))
def html_tables(s: pd.Series) -> pd.Series:
    def one(x):
        p = _Tables()
        p.feed(x or "")
        return p.done

    return s.map(one)


def titles_and_links(pages: DataFrame) -> DataFrame:
    """page_id, title, n_links of HTML pages, natively."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return pages.select("page_id", title.alias("title"), F.size(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))).cast("long").alias("n_links"))


def newest(frames: DataFrame) -> DataFrame:
    """(family, day, path, sealed) -> the newest sealed snapshot of each family."""
    order = Window.partitionBy("family").orderBy(F.desc("day"), F.desc("path"))
    return frames.where("sealed").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
