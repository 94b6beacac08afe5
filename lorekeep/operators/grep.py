"""The search call over a catalogue: three modes, three scopes, limits, a subtree and a language; an index of words; and
an account of how each answer was found."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import KEY_VERSION, cjk_pairs, cjk_runs, fold, fold_key, has_cjk, regexp, tokens
from lorekeep.operators import graph, search
from lorekeep.operators.stored import written
from lorekeep.plans import queryplan, regexplan

MODES, SCOPES = ("words", "substring", "regex"), ("concepts", "passages", "labels")
#: Column weights of concepts.
CONCEPT_WEIGHTS = {"label": 10.0, "alts": 5.0, "scope_note": 1.0}
#: Items of this scheme lend their names and are not searched themselves.
LENDER = "wd"


class GrepError(ValueError):
    pass


@dataclass
class Catalogue:
    """concepts: id, scheme, status, label, scope_note; labels: concept_id, lang, kind, text; documents: doc_id, title,
    superseded_by; passages: doc_id, ord, text; document_concepts: doc_id, concept_id; broader: child, parent."""

    concepts: DataFrame
    labels: DataFrame
    documents: DataFrame
    passages: DataFrame
    document_concepts: DataFrame
    broader: DataFrame


@dataclass
class Answer:
    """hits: one row each, best first within its scope; notes and plan say how they were found."""

    hits: DataFrame
    notes: list[str] = field(default_factory=list)
    plan: list[str] = field(default_factory=list)


def concept_texts(c: Catalogue) -> DataFrame:
    """id, label, alts (alternative names joined), scope_note of active concepts but the lender's."""
    alts = c.labels.where("kind = 'alt'").groupBy("concept_id").agg(F.array_join(F.array_sort(F.collect_list("text")), " | ").alias("alts"))
    rows = c.concepts.where((F.col("status") == "active") & (F.col("scheme") != LENDER)).select("id", "label", "scope_note")
    return rows.join(alts, rows["id"] == alts["concept_id"], "left").drop("concept_id")


def grep(c: Catalogue, pattern: str, mode: str = "words", scope: str = "all", limit: int = 50, under: str | None = None, lang: str | None = None, context: int = search.CONTEXT, key_version: str = KEY_VERSION) -> Answer:
    """hits: type, target, title, parts, score, concepts, lang. Scope ``all`` is the three one after the other, each
    with its own limit; lang limits labels alone. key_version is that of stored keys, if any: keys made under another
    are not trusted, and every row is tried."""
    if mode not in MODES:
        raise GrepError(f"mode must be one of {MODES}")
    if scope not in (*SCOPES, "all"):
        raise GrepError(f"scope must be one of {(*SCOPES, 'all')}")
    if not pattern.strip():
        raise GrepError("empty pattern")
    if mode == "regex":
        try:
            re.compile(pattern)
        except re.error as e:
            raise GrepError(f"invalid regular expression: {e}") from e
    answer = Answer(None)
    below = graph.subtree(c.broader, under) if under else None
    every = [_scope(c, answer, s, pattern, mode, search.clamped(limit), below, lang, context, key_version == KEY_VERSION) for s in (SCOPES if scope == "all" else (scope,))]
    answer.hits = reduce(DataFrame.unionByName, every)
    return answer


def _note(answer: Answer, text: str) -> None:
    if text not in answer.notes:
        answer.notes.append(text)


def _rows(c: Catalogue, scope: str, lang: str | None, below: DataFrame | None) -> tuple[DataFrame, dict[str, float], list[str]]:
    """What a scope searches: rows with key, target, title, text, concepts, lang and searched columns; the weights of
    those; and the order of hits that have no rank."""
    if scope == "concepts":
        rows = concept_texts(c)
        text = F.concat_ws("\n", "label", "alts", "scope_note")
        rows = rows.select(F.col("id").alias("key"), F.col("id").alias("target"), F.col("label").alias("title"), text.alias("text"), F.array("id").alias("concepts"), F.lit(None).cast("string").alias("lang"), "label", "alts", "scope_note")
        rows = rows if below is None else rows.join(below, rows["key"] == below["id"], "left_semi")
        return rows, CONCEPT_WEIGHTS, ["_size", "target"]
    if scope == "passages":
        about = c.document_concepts.groupBy("doc_id").agg(F.array_sort(F.collect_set("concept_id")).alias("concepts"))
        rows = c.passages.join(c.documents.where("superseded_by is null").select("doc_id", "title"), "doc_id").join(about, "doc_id", "left")
        if below is not None:
            inside = c.document_concepts.join(below, c.document_concepts["concept_id"] == below["id"], "left_semi").select("doc_id").distinct()
            rows = rows.join(inside, "doc_id", "left_semi")
        name = F.concat("doc_id", F.lit("#p"), F.col("ord"))
        rows = rows.select(name.alias("key"), name.alias("target"), "title", "text", F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"), F.lit(None).cast("string").alias("lang"), F.col("doc_id").alias("_doc"), F.col("ord").alias("_ord"))
        return rows, {"text": 1.0}, ["_doc", "_ord"]
    named = c.concepts.where(F.col("scheme") != LENDER).select(F.col("id").alias("concept_id"), F.col("label").alias("title"))
    labels = c.labels if lang is None else c.labels.where(F.col("lang") == lang)
    labels = labels if below is None else labels.join(below, labels["concept_id"] == below["id"], "left_semi")
    rows = labels.join(named, "concept_id")
    key = F.to_json(F.struct("concept_id", "lang", "kind", "text"))
    return rows.select(key.alias("key"), F.col("concept_id").alias("target"), "title", "text", F.array("concept_id").alias("concepts"), "lang"), {"text": 1.0}, ["_size", "target", "key"]


def _scope(c, answer, scope, pattern, mode, limit, below, lang, context, current) -> DataFrame:
    rows, weights, order = _rows(c, scope, lang, below)
    answer.plan.append(f"{scope}: rows" + (" below the root" if below is not None else "") + (f" in {lang}" if lang and scope == "labels" else ""))
    if mode == "words":
        found = _words(answer, scope, rows, weights, pattern)
        hits, spans = found.orderBy(F.desc("score"), "target", "key").limit(limit), lambda x: search.word_spans(x, pattern)
    else:
        if mode == "substring":
            _explain_substring(answer, pattern, scope, current)
            found, spans = search.substring(rows, "text", pattern, []), lambda x: search.literal_spans(x, pattern)
        else:
            need = regexplan.needs(pattern) if current else None
            _note(answer, f"keys must hold {need}; the pattern decides" if need else "the pattern names no letters that a key must hold: it is tried on every row")
            answer.plan.append(f"{scope}: " + ("key contains " + str(need) + " and then " if need else "") + "re.search")
            found = search.regex(rows, "text", pattern, []) if current else rows.where(regexp(F.col("text"), pattern))
            spans = lambda x: search.pattern_spans(x, pattern)
        size = F.length("title") if scope == "concepts" else F.length("text")
        hits = found.withColumn("score", F.lit(1.0)).withColumn("_size", size).orderBy(*order).limit(limit)
    return search.with_parts(hits.select(F.lit(scope[:-1]).alias("type"), "target", "title", "text", F.round("score", 4).alias("score"), "concepts", "lang"), "text", spans, context).drop("text")


def _explain_substring(answer: Answer, pattern: str, scope: str, current: bool) -> None:
    key = fold(pattern)
    if not current:
        _note(answer, f"stored keys are not of version {KEY_VERSION}: every row is folded")
    elif len(key) >= 3:
        _note(answer, f"key contains {key!r}: exact, in generated code")
    else:
        _note(answer, "the needle is too short for an index: every key is searched")
    answer.plan.append(f"{scope}: key contains {key!r}")


def _words(answer: Answer, scope: str, rows: DataFrame, weights: dict[str, float], pattern: str) -> DataFrame:
    if scope == "labels" and has_cjk(pattern):
        _note(answer, "labels are searched by pairs of characters")
        answer.plan.append("labels: every pair of " + str(cjk_runs(pattern)))
        return _cjk(rows, pattern)
    scored, note = search.words(rows, "key", weights, pattern)
    if note:
        _note(answer, note)
    answer.plan.append(f"{scope}: {queryplan.parse(pattern, tuple(weights))[0]}, BM25 {weights}")
    return rows.join(scored.withColumnRenamed("id", "key"), "key")


def _cjk(rows: DataFrame, pattern: str) -> DataFrame:
    """Labels with every run of the query as neighbouring pairs, ranked by BM25 over phrases of pairs."""
    runs = cjk_runs(pattern)
    if not runs:  # one character: what contains it
        key = fold(pattern)
        return rows.where(F.contains(fold_key(F.col("text")), F.lit(key))).withColumn("score", F.lit(1.0))
    phrases = [queryplan.Node("phrase", tuple(r)) for r in runs]
    positions = search.in_tokens({"text": "pairs"})
    tfs = [search.weight(p, {"text": 1.0}, positions).alias(f"tf{k}") for k, p in enumerate(phrases)]
    pairs = rows.select(F.col("key").alias("id"), cjk_pairs(F.col("text")).alias("pairs"))
    docs = written(pairs.where(F.size("pairs") > 0).select("id", F.size("pairs").alias("len"), *tfs))
    hit = reduce(Column.__and__, [F.col(f"tf{k}") > 0 for k in range(len(phrases))])
    scored = search.ranked(docs.where(hit), len(phrases), search.totals_of(docs, len(phrases)))
    return rows.join(scored.withColumnRenamed("id", "key"), "key")


# A stored index of words

#: Folders of terms; a search reads those of its words alone.
FOLDERS = 64


def build_index(df: DataFrame, id_: str, columns: list[str], path: str) -> None:
    """Write the words of df's columns: ``terms`` (term, id, column, positions; in folders by a hash of the term, sorted),
    ``lengths`` (id, len) and ``about`` (key_version, columns)."""
    none = F.array().cast("array<string>")
    arrays = df.select(F.col(id_).cast("string").alias("id"), *(F.coalesce(tokens(F.col(c)), none).alias(f"w{i}") for i, c in enumerate(columns)))
    arrays.select("id", sum((F.size(f"w{i}") for i in range(len(columns))), F.lit(0)).alias("len")).write.parquet(f"{path}/lengths")
    each = F.concat(*(F.transform(f"w{i}", _entry(c)) for i, c in enumerate(columns)))
    rows = arrays.select("id", F.explode(each).alias("x")).groupBy("x.term", "id", "x.column").agg(F.array_sort(F.collect_list("x.at")).alias("positions"))
    folder = F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int")
    stored = rows.withColumn("folder", folder).repartition("folder", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("folder", "term", "id")
    stored.write.partitionBy("folder").parquet(f"{path}/terms")
    df.sparkSession.createDataFrame([(KEY_VERSION, list(columns))], "key_version string, columns array<string>").write.parquet(f"{path}/about")


def _entry(column: str):
    return lambda t, p: F.struct(F.lit(column).alias("column"), t.alias("term"), p.alias("at"))


def search_index(spark: SparkSession, path: str, query: str, weights: dict[str, float] | None = None) -> tuple[DataFrame, list[str]]:
    """id, score from a stored index, and notes. Only the folders and row groups of the query's words are read; a prefix
    reads every folder, with the prefix pushed down. Words of a row meet in one group of a bounded size: the query's."""
    about = spark.read.parquet(f"{path}/about").first()
    columns = tuple(about["columns"])
    node, note = queryplan.parse(query, columns)
    notes = [note] if note else []
    if about["key_version"] != KEY_VERSION:
        notes.append(f"the index was built under {about['key_version']}, words are read under {KEY_VERSION}")
    every = queryplan.phrases(node)
    wanted = _words_in(node)
    terms = spark.read.parquet(f"{path}/terms")
    exact = sorted({w for w, prefix in wanted if not prefix})
    tests = [F.startswith("term", F.lit(w)) for w, prefix in wanted if prefix]
    if exact:
        buckets = [r[0] for r in spark.createDataFrame([(w,) for w in exact], "term string").select(F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int")).distinct().collect()]  # of the query's words
        tests.append(F.col("folder").isin(buckets) & F.col("term").isin(exact))
    entries = terms.where(reduce(Column.__or__, tests)).groupBy("id").agg(F.collect_list(F.struct("column", "term", "positions")).alias("e"))

    def positions(column: str, word: str, prefix: bool) -> Column:
        test = (lambda t: F.startswith(t, F.lit(word))) if prefix else (lambda t: t == word)
        return F.flatten(F.transform(F.filter("e", lambda x: (x["column"] == column) & test(x["term"])), lambda x: x["positions"]))

    weights = weights or dict.fromkeys(columns, 1.0)
    lengths = spark.read.parquet(f"{path}/lengths")
    tfs = [search.weight(p, weights, positions).alias(f"tf{k}") for k, p in enumerate(every)]
    docs = entries.select("id", *tfs, search.holds(node, columns, positions).alias("held"))
    sizes = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    counts = docs.agg(*(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(every))))
    totals = sizes.crossJoin(counts)  # one row each
    return search.ranked(docs.where("held").join(lengths, "id"), len(every), totals), notes


def _words_in(node: queryplan.Node) -> set[tuple[str, bool]]:
    own = {(w, node.prefix and i == len(node.words) - 1) for i, w in enumerate(node.words)}
    return own.union(*(_words_in(p) for p in node.parts))
