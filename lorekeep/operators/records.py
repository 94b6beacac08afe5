"""Reading a catalogue: one id with all about it, queues, neighbours, choices and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import fold_key, hidden, like_ascii, scheme_of, tokens, words_of
from lorekeep.operators import search
from lorekeep.operators.pairing import dealt_join
from lorekeep.operators.stored import written

#: Order of relations in a queue, and of kinds of labels in a record: fixed values.
RELATIONS = ("exactMatch", "closeMatch")
KINDS = ("pref", "alt", "hidden", "desc")
#: Concepts of a title are joined in so many lists, which are only then taken apart.
BLOCKS = 32


def _position(value: Column, order: tuple[str, ...]) -> Column:
    out = F.lit(len(order))
    for i, x in reversed(list(enumerate(order))):
        out = F.when(value == x, i).otherwise(out)
    return out


def resolve(ids: DataFrame, frames: dict[str, DataFrame]) -> DataFrame:
    """ids (id) with kind: the first of the frames, each with a column id, that has it; null for an unknown one."""
    found = None
    for i, (kind, df) in enumerate(frames.items()):
        part = df.select("id", F.lit(i).alias("_i"), F.lit(kind).alias("kind")).distinct()
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("id").agg(F.min_by("kind", "_i").alias("kind"))
    return ids.join(best, "id", "left")


def node(id_: str, concepts: DataFrame, labels: DataFrame, broader: DataFrame, related: DataFrame, mappings: DataFrame, documents: DataFrame, claims: DataFrame) -> DataFrame:
    """All about one concept as one row of nested arrays, none for an unknown id: parents and children with their labels,
    related concepts of either side, mappings in both directions, labels by kind, documents, current claims."""
    me = concepts.where(F.col("id") == id_)
    name = concepts.select(F.col("id").alias("other"), F.col("label").alias("other_label"))

    def gathered(df: DataFrame, column: str, *fields: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(column))  # of one concept

    def named(df: DataFrame, column: str) -> DataFrame:
        return gathered(df.join(name, "other", "left"), column, "other", "other_label")

    up = broader.where(F.col("child") == id_).select(F.col("parent").alias("other"))
    down = broader.where(F.col("parent") == id_).select(F.col("child").alias("other"))
    side = related.where((F.col("a") == id_) | (F.col("b") == id_)).select(F.when(F.col("a") == id_, F.col("b")).otherwise(F.col("a")).alias("other"))
    out_maps = mappings.where(F.col("from_id") == id_).select(F.col("to_id").alias("other"), "relation", "status", F.lit(False).alias("inverse"))
    in_maps = mappings.where(F.col("to_id") == id_).select(F.col("from_id").alias("other"), "relation", "status", F.lit(True).alias("inverse"))
    own = labels.where(F.col("concept_id") == id_).select(_position(F.col("kind"), KINDS).alias("o"), "kind", "lang", "text")
    said = claims.where((F.col("subject") == id_) & F.col("superseded_at").isNull()).select("predicate", "value")
    texts = documents.where(F.col("concept_id") == id_).select("doc_id", "title")
    out = me
    parts = [named(up, "broader"), named(down, "narrower"), named(side, "related"), gathered(out_maps.unionByName(in_maps), "mappings", "other", "relation", "status", "inverse"), gathered(own, "labels", "o", "kind", "lang", "text"), gathered(texts, "documents", "doc_id", "title"), gathered(said, "claims", "predicate", "value")]
    for part in parts:  # one row each
        out = out.crossJoin(F.broadcast(part))
    return out


def reviews_about(reviews: DataFrame, id_: str) -> DataFrame:
    """Reviews of a concept or of a mapping of it; the id is no pattern."""
    return reviews.where((F.col("target") == id_) | F.startswith("target", F.lit(f"mapping:{id_}|")))


def review_queue(mappings: DataFrame, reviews: DataFrame, below: DataFrame | None = None, relation: str | None = None) -> DataFrame:
    """Accepted mappings that only a machine has judged and no human reviewed, exact matches first, then close ones; below
    (id) and a relation narrow it."""
    rows = mappings.where((F.col("status") == "accepted") & F.startswith("method", F.lit("ai")))
    rows = rows if relation is None else rows.where(F.col("relation") == relation)
    rows = rows if below is None else rows.join(below.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    target = F.concat(F.lit("mapping:"), F.col("from_id"), F.lit("|"), F.col("to_id"))
    human = reviews.where("reviewer_kind = 'human'").select(F.col("target").alias("_target"))
    rows = rows.withColumn("_target", target).join(human, "_target", "left_anti").drop("_target")
    return rows.orderBy(_position(F.col("relation"), RELATIONS), "from_id", "to_id")


def reviewer_kind(reviewer: Column) -> Column:
    """Who decided, by the name: nobody, a model, a rule, or a person."""
    low = F.lower(F.coalesce(reviewer, F.lit("")))
    return F.when(low == "", "none").when(low.rlike(r"^(ai|agent|model)\b|\b(llm|gpt|bot)\b"), "model").when(low.rlike(r"^(rule|auto)"), "rule").otherwise("human")


def review_coverage(mappings: DataFrame) -> DataFrame:
    """decider, relation, n, n_accepted."""
    return mappings.groupBy(reviewer_kind(F.col("reviewer")).alias("decider"), "relation").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "accepted").alias("n_accepted"))


def evidence_share(evidence: DataFrame) -> DataFrame:
    """evidence (predicate, n_references, sourced) -> predicate, n, n_referenced, n_sourced, share."""
    out = evidence.groupBy("predicate").agg(F.count("*").alias("n"), F.count_if(F.col("n_references") > 0).alias("n_referenced"), F.count_if("sourced").alias("n_sourced"))
    return out.withColumn("share", F.col("n_sourced") / F.col("n"))


def attention(links: DataFrame, n: int | None = None) -> DataFrame:
    """links (concept_id, sitelinks, sitelinks_all: of each accepted match) -> concept_id, the most of each, and what robots'
    editions add; the n largest differences if asked for."""
    out = links.groupBy("concept_id").agg(F.max("sitelinks").alias("sitelinks"), F.max("sitelinks_all").alias("sitelinks_all")).withColumn("difference", F.col("sitelinks_all") - F.col("sitelinks"))
    return out if n is None else out.orderBy(F.desc("difference"), "concept_id").limit(n)


def newest_model(models: DataFrame, neighbours: DataFrame) -> DataFrame:
    """The newest of models (model, created_at) that has neighbours (model)."""
    return models.join(neighbours.select("model").distinct(), "model", "left_semi").orderBy(F.desc("created_at"), F.desc("model")).limit(1)


def neighbourhood(edges: DataFrame, id_: str) -> DataFrame:
    """other, kind, weight of the edges (s, t, k, w) at a node: the strongest of each kind."""
    at = edges.where((F.col("s") == id_) | (F.col("t") == id_)).select(F.when(F.col("s") == id_, F.col("t")).otherwise(F.col("s")).alias("other"), F.col("k").alias("kind"), "w")
    return at.groupBy("other", "kind").agg(F.max("w").alias("weight"))


def expected(files: DataFrame) -> DataFrame:
    """files (source, size, downloaded) -> source, n, n_downloaded, bytes: their sum only if every size is known."""
    total = F.when(F.count("size") == F.count("*"), F.sum("size"))
    return files.groupBy("source").agg(F.count("*").alias("n"), F.count_if("downloaded").alias("n_downloaded"), total.alias("bytes"))


def rendered(claims: DataFrame) -> DataFrame:
    """claims (snak_type, object_label, object, value, datatype) with shown: what a reader sees. Times are shown by
    ``worldtime.read_times`` before, as shown_time."""
    raw = F.col("value")
    amount = F.regexp_replace(F.get_json_object(raw, "$.amount"), r"^\+", "")
    unit = F.regexp_extract(F.coalesce(F.get_json_object(raw, "$.unit"), F.lit("")), r"([^/]*)$", 1)
    quantity = F.when(unit.isin("", "1"), amount).otherwise(F.concat_ws(" ", amount, unit))
    text = F.concat(F.get_json_object(raw, "$.text"), F.lit(" ("), F.get_json_object(raw, "$.language"), F.lit(")"))
    degrees = lambda name: F.format_string("%.4f", F.get_json_object(raw, f"$.{name}").cast("double"))
    place = F.concat(degrees("latitude"), F.lit(", "), degrees("longitude"))
    shown = (
        F.when(F.col("snak_type") == "novalue", "no value").when(F.col("snak_type") == "somevalue", "unknown value")
        .when(F.col("object").isNotNull(), F.coalesce("object_label", "object"))
        .when(F.col("datatype") == "time", F.col("shown_time")).when(F.col("datatype") == "quantity", quantity)
        .when(F.col("datatype") == "monolingualtext", text).when(F.col("datatype") == "globe-coordinate", place).otherwise(raw)
    )
    return claims.withColumn("shown", shown)


def joined_names(rows: DataFrame, key: str, text: str, separator: str = " | ") -> DataFrame:
    """key, joined: its texts in order, a bounded list of names of one thing."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(text)), separator).alias("joined"))


def best_names(hits: DataFrame) -> DataFrame:
    """hits (term, lang, kind, text, score) -> one row a term: the name with the best score, ties by kind, language, text."""
    order = F.struct((-F.col("score")).alias("a"), "kind", "lang", "text")
    return hits.groupBy("term").agg(F.min_by(F.struct("lang", "kind", "text", "score"), order).alias("x")).select("term", "x.*")


def most_common(rows: DataFrame, value: str, seq: str) -> DataFrame:
    """The most frequent value, of equally frequent ones the one seen first."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(1).select(value, "n")


def record_time(items: DataFrame, prefix: str = "") -> DataFrame:
    """corpus, at: when the last of its items (corpus, name, retrieved_at) whose name has the prefix was retrieved."""
    return items.where(F.startswith("name", F.lit(prefix))).groupBy("corpus").agg(F.max("retrieved_at").alias("at"))


def first_mentions(rows: DataFrame, code: str, seq: str) -> DataFrame:
    """code, place: codes numbered from 0 by their first mention. Numbers come from the sorted partitions' sizes, not
    from one task."""
    first = rows.groupBy(code).agg(F.min(seq).alias("first"))
    ranged = first.repartitionByRange("first").sortWithinPartitions("first", code).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("c"), F.min("_i").alias("_base"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    return ranged.join(F.broadcast(before), "_p").select(code, (F.col("_before") + F.col("_i") - F.col("_base")).alias("place"))


def rank_labels(labels: DataFrame, needle: str, limit: int | None = None) -> DataFrame:
    """labels (id, label, mass) that contain the needle: equal ones, then those that begin with it, then by the place of
    the match, mass and label."""
    key = fold_key(F.col("label"))
    want = fold_key(F.lit(needle))
    rank = F.when(key == want, 0).when(F.startswith(key, want), 1).otherwise(2)
    rows = labels.withColumns({"rank": rank, "at": F.position(want, key)})
    rows = rows.where("at > 0").orderBy("rank", "at", F.desc("mass"), "label", "id")
    return rows if limit is None else rows.limit(search.clamped(limit))


def first_violations(violations: DataFrame, n: int = 50) -> DataFrame:
    """The first n of each check, by key."""
    order = Window.partitionBy("check").orderBy("key", "detail")
    return violations.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def documents_of_titles(concepts: DataFrame, documents: DataFrame, aliases: DataFrame) -> DataFrame:
    """doc_id, concept_id: documents (doc_id, title) of every concept (id, page) with that title, redirects (alias, title)
    followed once; a title may belong to many concepts. Only ids with several titles can meet twice, so the other pairs,
    as many as they are, aren't made distinct."""
    pages = concepts.where("page is not null").join(aliases.withColumnRenamed("title", "_to"), F.col("page") == F.col("alias"), "left").select("id", F.coalesce("_to", "page").alias("title")).distinct()
    c = pages.select(F.col("id").alias("concept_id"), "title", (F.count("*").over(Window.partitionBy("id")) > 1).alias("_c"))
    d = documents.select("doc_id", "title").distinct().withColumn("_d", F.count("*").over(Window.partitionBy("doc_id")) > 1)
    blocks = c.groupBy("title", "_c", F.pmod(F.xxhash64("concept_id"), F.lit(BLOCKS)).alias("_b")).agg(F.collect_list("concept_id").alias("_ids")).drop("_b")
    once = dealt_join(d, blocks, ["title"], 16).where(~(F.col("_c") & F.col("_d"))).select("doc_id", F.explode("_ids").alias("concept_id"))
    again = dealt_join(d.where("_d"), c.where("_c"), ["title"], 16).select("doc_id", "concept_id").distinct()
    return once.unionByName(again)


def vectors_of_texts(labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """labels (id, text) with the vector of their text's SHA-256 (key, v); missing ones are reported by ``without``."""
    return labels.withColumn("key", F.sha2("text", 256)).join(vectors, "key").select("id", "text", "v")


def without(labels: DataFrame, vectors: DataFrame) -> DataFrame:
    return labels.withColumn("key", F.sha2("text", 256)).join(vectors, "key", "left_anti").select("id", "text")


def batched(ids: DataFrame, key: str, facts: DataFrame, value: str) -> DataFrame:
    """Each asked id with its sorted values, an empty list for none."""
    found = facts.join(ids.select(key), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("found"))
    return ids.join(found, key, "left").select(key, F.coalesce("found", F.array().cast("array<string>")).alias("found"))


def _is(word: str):
    return lambda t: t == word


def lean_search(labels: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """labels (scheme, term, lang, kind, text) of converted sources: names with every word of the query (16 at most), BM25
    in each scheme by itself, the best name of each term, the best terms over all schemes."""
    words = list(dict.fromkeys(words_of(query)))[:16]
    if not words:
        raise ValueError("the query has no words")
    rows = labels.select("scheme", "term", "lang", "kind", "text", tokens(F.col("text")).alias("w"))
    tfs = [F.size(F.filter("w", _is(x))).alias(f"tf{k}") for k, x in enumerate(words)]
    rows = written(rows.select("scheme", "term", "lang", "kind", "text", F.size("w").alias("len"), *tfs))
    totals = rows.groupBy("scheme").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(words))))
    hits = rows.where(search._all([F.col(f"tf{k}") > 0 for k in range(len(words))])).join(totals, "scheme")
    score = F.lit(0.0)
    for k in range(len(words)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)), F.lit(search.LEAST_IDF))
        score = score + idf * F.col(f"tf{k}") * (search.K1 + 1) / (F.col(f"tf{k}") + search.K1 * (1 - search.B + search.B * F.col("len") / F.col("avgdl")))
    scored = hits.select(F.concat_ws("/", "scheme", "term").alias("term"), "lang", "kind", "text", score.alias("score"))
    return best_names(scored).orderBy(F.desc("score"), "term").limit(search.clamped(limit))


def lean_record(scheme: str, code: str, term: DataFrame, label: DataFrame, rel: DataFrame, attr: DataFrame, link: DataFrame, most: int = 500) -> DataFrame:
    """One term of a converted source as one row: labels, relations out and in (``most`` at most), attributes, links. In
    relations of broader are its narrower terms."""
    mine = term.where(F.col("code") == code).select(F.lit(scheme).alias("scheme"), "code", "status")
    gather = lambda df, name, *fields: df.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    inward = rel.where(F.col("o") == code).select("pred", F.col("s").alias("code")).orderBy("pred", "code").limit(most)
    parts = [
        gather(label.where(F.col("code") == code), "labels", "kind", "lang", "text"), gather(rel.where(F.col("s") == code), "out", "pred", "o"), gather(inward, "in", "pred", "code"),
        gather(attr.where(F.col("code") == code), "attrs", "pred", "value_int", "value_real", "value_text"), gather(link.where(F.col("code") == code), "links", "pred", "map", "target"),
    ]
    out = mine
    for p in parts:  # one row each
        out = out.crossJoin(F.broadcast(p))
    return out


def leave_out(labels: DataFrame, lang: str) -> DataFrame:
    """labels without a language and its variants, so that no statistic of an index knows of them."""
    return labels.where(~hidden(F.col("lang"), F.lit(lang)))


def in_schemes(df: DataFrame, column: str, schemes: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose id is (not) of the schemes (scheme)."""
    keyed = df.withColumn("scheme", scheme_of(F.col(column)))
    return keyed.join(schemes.select("scheme").distinct(), "scheme", "left_semi" if inside else "left_anti").drop("scheme")


def with_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(like_ascii(F.col(column), prefix))


def cells(points: DataFrame, size: float) -> DataFrame:
    """points (id, x, y) with the cell of a uniform grid."""
    return points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})


def nearby(points: DataFrame, radius: float) -> DataFrame:
    """Pairs of points (id, x, y) at most a radius apart, a < b, by cells of that size: each point meets its own cell and
    four of the eight about it, which meet it in turn from the other four."""
    a = cells(points, radius)
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)))))
    left = a.select("id", "x", "y", "cx", "cy", around.alias("d")).select("id", "x", "y", (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"), ((F.col("d.dx") == 0) & (F.col("d.dy") == 0)).alias("own"))
    right = a.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy")
    once = (F.col("id") < F.col("b")) | (~F.col("own") & (F.col("id") != F.col("b")))
    pairs = dealt_join(left, right, ["cx", "cy"], 4).where(once & (F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2) <= radius * radius))
    return pairs.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))


def offline_audit(nodes: DataFrame) -> DataFrame:
    """nodes (id, root, value, docs) -> root, n, median, least, docs."""
    return nodes.groupBy("root").agg(F.count("*").alias("n"), F.median("value").alias("median"), F.min(F.struct("value", "id"))["id"].alias("least"), F.sum("docs").alias("docs"))
