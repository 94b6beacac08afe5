"""The engine's operators as queries over the test tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import stats, text, vectors, worldtime
from lorekeep.operators import audit, claims, evaluate, graph, integrity, links, search, semantic
from lorekeep.operators.stored import written
from lorekeep.sources import lean, readers
from lorekeep.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one directory, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _id(scope: str, column: str):
    return F.concat(F.lit(scope + "/"), F.col(column).cast("string"))


def hierarchy(t: Tables) -> DataFrame:
    """child, parent: orders below customers below nations below regions."""
    parts = [
        t.nation.select(_id("n", "n_nationkey").alias("child"), _id("r", "n_regionkey").alias("parent")),
        t.customer.select(_id("c", "c_custkey").alias("child"), _id("n", "c_nationkey").alias("parent")),
        t.orders.select(_id("o", "o_orderkey").alias("child"), _id("c", "o_custkey").alias("parent")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def concepts(t: Tables) -> DataFrame:
    return t.region.select(_id("r", "r_regionkey").alias("id")).unionByName(hierarchy(t).select(F.col("child").alias("id")))


EDGES_SQL = """edges AS (
  SELECT 'n/' || n_nationkey AS child, 'r/' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 'c/' || c_custkey, 'n/' || c_nationkey FROM customer
  UNION ALL SELECT 'o/' || o_orderkey, 'c/' || o_custkey FROM orders)"""
CLOSURE_SQL = f"WITH RECURSIVE {EDGES_SQL}, up AS (SELECT child AS node, parent AS ancestor FROM edges UNION SELECT up.node, e.parent FROM up JOIN edges e ON e.child = up.ancestor)"
TOKENS_SQL = r"list_filter(string_split_regex(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}\p{{Co}}\p{{M}}]+'), lambda x: x <> '')"


def bm25_sql(table: str, id_: str, columns: dict[str, float], terms: list[str], keep: str = "") -> str:
    lists = [TOKENS_SQL.format(c) for c in columns]
    lens = " + ".join(f"len({x})" for x in lists)
    tf = lambda w: " + ".join(f"{weight}::DOUBLE * len(list_filter({x}, lambda y: y = '{w}'))" for x, weight in zip(lists, columns.values(), strict=True))
    cols = ", ".join(f"{tf(w)} AS tf{k}" for k, w in enumerate(terms))
    dfs = ", ".join(f"sum((tf{k} > 0)::INT) AS df{k}" for k in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - df{k} + 0.5) / (df{k} + 0.5)), 1e-6) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * len / avgdl))" for k in range(len(terms)))
    hit = " AND ".join(f"tf{k} > 0" for k in range(len(terms)))
    return f"WITH d AS (SELECT {id_} AS id, ({lens})::DOUBLE AS len, {cols} FROM {table}), s AS (SELECT count(*) AS n, avg(len) AS avgdl, {dfs} FROM d) SELECT id, round({score}, 6) AS score FROM d, s WHERE {hit}{keep}"


# Search


@query("SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(text), 'tion') ORDER BY length(text), doc_id LIMIT 50")
def grep_substring_documents(t):
    return search.substring(t.documents, "text", "tion", ["doc_id"], 50).select("doc_id", "lang", "n_chars")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'wid')")
def grep_substring_part(t):
    return search.substring(t.part, "p_name", "WID", ["p_partkey"]).select("p_partkey", "p_name")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'th(?:ou|er)[a-z]*nd and')")
def grep_regex_documents(t):
    return search.regex(t.documents, "text", "th(?:ou|er)[a-z]*nd and", ["doc_id"]).select("doc_id")


@query(bm25_sql("documents", "doc_id", {"text": 1}, ["thnd", "ating"]))
def grep_words_bm25_documents(t):
    return search.bm25(t.documents, "doc_id", {"text": 1}, ["thnd", "ating"]).withColumn("score", F.round("score", 6))


@query(bm25_sql("part", "p_partkey", {"p_name": 10, "p_type": 5, "p_brand": 1}, ["small", "economy"]))
def grep_words_weighted(t):
    return search.bm25(t.part, "p_partkey", {"p_name": 10, "p_type": 5, "p_brand": 1}, ["small", "economy"]).withColumn("score", F.round("score", 6))


@query(bm25_sql("documents", "doc_id", {"text": 1}, ["que", "tion"], " AND id IN (SELECT doc_id FROM documents WHERE lang = 'fr')"))
def grep_words_lang_filter(t):
    french = t.documents.where("lang = 'fr'").select(F.col("doc_id").alias("id"))
    return search.bm25(t.documents, "doc_id", {"text": 1}, ["que", "tion"]).join(french, "id", "left_semi").withColumn("score", F.round("score", 6))


@query("SELECT p_partkey AS id FROM part WHERE (regexp_matches(lower(p_name), '(^| )(small|red)( |$)')) AND NOT regexp_matches(lower(p_name), '(^| )ring')")
def grep_words_query(t):
    return search.words(t.part, "p_partkey", {"p_name": 1}, "(small OR red) NOT ring*")[0].select("id")


@query(
    " UNION ALL ".join(
        f"""SELECT '{a}' AS "table", '{c}' AS "column", {k}::VARCHAR AS key, {c} AS value FROM {a} WHERE contains(lower({c}), 'ion')"""
        for a, k, cs in (("region", "r_regionkey", ["r_name"]), ("nation", "n_nationkey", ["n_name"]), ("customer", "c_custkey", ["c_name", "c_mktsegment"]), ("part", "p_partkey", ["p_name", "p_brand", "p_type"]), ("orders", "o_orderkey", ["o_orderstatus", "o_orderpriority"]))
        for c in cs
    )
)
def grep_any_text_columns(t):
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey"}
    return search.any_text({k: getattr(t, k) for k in keys}, keys, "ion")


@query("""WITH n AS (SELECT DISTINCT p_name AS id FROM part), g AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(id) - 1), lambda i: substr(id, i::INT, 3))) AS gram FROM n),
c AS (SELECT id, count(*) AS k FROM g GROUP BY id)
SELECT a.id AS left_id, b.id AS right_id, round(count(*) / (any_value(x.k) + any_value(y.k) - count(*))::DOUBLE, 6) AS score
FROM g a JOIN g b USING (gram) JOIN c x ON x.id = a.id JOIN c y ON y.id = b.id GROUP BY a.id, b.id""")
def trigram_jaccard(t):
    names = t.part.select(F.col("p_name").alias("id"), F.col("p_name").alias("text")).distinct()
    return search.jaccard(names, names).withColumn("score", F.round("score", 6))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
p AS (SELECT doc_id, i, raw, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
SELECT doc_id AS id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS ord, start::BIGINT AS start, (start + length(raw))::BIGINT AS "end", text FROM p WHERE text <> ''""")
def passages_offsets(t):
    return search.passages(t.documents, "doc_id", "text")


@query()
def snippets(t):
    return search.snippets(search.substring(t.documents, "text", "stupid", ["doc_id"]), "text", "stupid").select("doc_id", "parts")


# Hierarchies


@query(f"WITH RECURSIVE {EDGES_SQL}, s AS (SELECT 'r/1' AS id UNION SELECT e.child FROM s JOIN edges e ON e.parent = s.id) SELECT id FROM s")
def subtree_closure(t):
    return graph.subtree(hierarchy(t), "r/1")


@query(CLOSURE_SQL + " SELECT node, ancestor FROM up")
def ancestors(t):
    return graph.closure(hierarchy(t))


STATS_SQL = CLOSURE_SQL + """, n AS (SELECT 'r/' || r_regionkey AS id FROM region UNION ALL SELECT child FROM edges),
s AS (SELECT id, (SELECT count(*) FROM up WHERE node = id)::INT AS depth, coalesce((SELECT max(ancestor) FROM up WHERE node = id AND ancestor LIKE 'r/%'), id) AS root,
  (SELECT count(*) FROM up WHERE ancestor = id) AS descendants, (SELECT count(*) FROM orders WHERE 'c/' || o_custkey = id) AS docs FROM n)"""


def _stats(t):
    return graph.stats(concepts(t), hierarchy(t), t.orders.select(_id("c", "o_custkey").alias("id")))


@query(STATS_SQL + " SELECT id, depth, root, descendants, docs FROM s")
def concept_stats(t):
    return _stats(t)


@query(STATS_SQL + " SELECT id, round(1 + ln(1 + descendants) + 0.5 * ln(1 + docs), 3) AS mass FROM s")
def graph_nodes_mass(t):
    return graph.masses(_stats(t)).select("id", "mass")


@query(f"""WITH {EDGES_SQL} SELECT child AS s, parent AS t, 'broader' AS k, 1.0::DOUBLE AS w FROM edges
UNION ALL SELECT DISTINCT 'p/' || l_partkey, 's/' || l_suppkey, 'related', 0.5 FROM lineitem
UNION ALL SELECT 'c/' || c_custkey, 'm/' || c_mktsegment, 'mapping', 0.3 FROM customer
UNION ALL SELECT least('p/' || l_partkey, 'o/' || l_orderkey), greatest('p/' || l_partkey, 'o/' || l_orderkey), 'semantic', max(greatest(0.01, least(1.0, l_quantity / 40))) FROM lineitem GROUP BY 1, 2""")
def graph_edges(t):
    frames = {
        "broader": hierarchy(t).select(F.col("child").alias("s"), F.col("parent").alias("t")),
        "related": t.lineitem.select(_id("p", "l_partkey").alias("s"), _id("s", "l_suppkey").alias("t")).distinct(),
        "facet": t.customer.select(_id("c", "c_custkey").alias("s"), _id("m", "c_mktsegment").alias("t")),
    }
    return graph.graph_edges(frames, t.lineitem.select(_id("p", "l_partkey").alias("s"), _id("o", "l_orderkey").alias("t"), (F.col("l_quantity") / 40).alias("w")))


@query(f"WITH RECURSIVE {EDGES_SQL}, s AS (SELECT 'r/2' AS id UNION SELECT e.child FROM s JOIN edges e ON e.parent = s.id) SELECT o_orderkey, o_totalprice FROM orders WHERE 'c/' || o_custkey IN (SELECT id FROM s)")
def under_semi_join(t):
    below = graph.subtree(hierarchy(t), "r/2")
    return t.orders.join(below, _id("c", "o_custkey") == below["id"], "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def unmatched_anti(t):
    urgent = t.orders.where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'")
    return t.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT 'c/' || c_custkey AS child, 'n/' || c_nationkey AS parent, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS stated
FROM customer WHERE c_acctbal > 0""")
def hierarchy_triangle(t):
    rich = t.customer.where("c_acctbal > 0")
    edges = t.customer.select(_id("c", "c_custkey").alias("child"), _id("n", "c_nationkey").alias("parent"))
    matches = rich.select(_id("c", "c_custkey").alias("id"), _id("Qc", "c_custkey").alias("item")).unionByName(t.nation.select(_id("n", "n_nationkey").alias("id"), _id("Qn", "n_nationkey").alias("item")))
    stated = t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(_id("Qc", "c_custkey").alias("subject"), _id("Qn", "c_nationkey").alias("object"))
    return links.triangle(edges, matches, stated)


@query("""WITH RECURSIVE e AS (SELECT 'n/' || n_nationkey AS child, 'r/' || n_regionkey AS parent FROM nation), x AS (SELECT 'r/0' AS id, 0 AS level, ['r/0'] AS path UNION ALL SELECT child, level + 1, list_append(path, child) FROM x JOIN e ON parent = id WHERE level < 2)
SELECT id, level, array_to_string(path, '>') AS path FROM x""")
def tree_paths(t):
    edges = t.nation.select(_id("n", "n_nationkey").alias("child"), _id("r", "n_regionkey").alias("parent"))
    return graph.tree(edges, "r/0", 2).withColumn("path", F.array_join("path", ">"))


# Claims


def _claims(t):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", "preferred").when(F.col("o_orderpriority") == "5-LOW", "deprecated").when(F.col("o_orderpriority") == "3-MEDIUM", "normal")
    return t.orders.select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("predicate"), rank.alias("rank"))


@query("""WITH c AS (SELECT o_orderkey AS claim_id, o_custkey AS subject, o_orderstatus AS predicate, CASE o_orderpriority WHEN '1-URGENT' THEN 'preferred' WHEN '5-LOW' THEN 'deprecated' ELSE 'normal' END AS rank FROM orders)
SELECT claim_id FROM c WHERE rank <> 'deprecated' AND (rank = 'preferred' OR NOT EXISTS (SELECT 1 FROM c d WHERE d.subject = c.subject AND d.predicate = c.predicate AND d.rank = 'preferred'))""")
def truthy_claims(t):
    return claims.truthy(_claims(t)).select("claim_id")


@query("""SELECT o_orderkey AS claim_id, count(DISTINCT l_linenumber) AS n_references, coalesce(bool_or(l_returnflag = 'R'), false) AS sourced FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def claim_evidence(t):
    prop = F.when(F.col("l_returnflag") == "A", "P143").when(F.col("l_returnflag") == "N", "P813").otherwise("P248")
    return claims.evidence(_claims(t), t.lineitem.select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("ref_id"), prop.alias("property")))


@query("""SELECT c.event_id AS claim_id, min(p.ts) AS superseded_at FROM events c LEFT JOIN events p ON p.user_id = c.user_id AND p.event_type = 'purchase' AND p.ts >= c.ts WHERE c.event_type = 'view' GROUP BY 1""")
def supersede_asof(t):
    made = t.events.where("event_type = 'view'").select(F.col("event_id").alias("claim_id"), F.col("user_id").alias("subject"), F.col("ts").alias("recorded_at"))
    read = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("subject"), F.col("ts").alias("at"))
    return claims.supersede(made, read).select("claim_id", "superseded_at")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_decision(t):
    return claims.latest(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""WITH h AS (SELECT user_id, event_id, event_type FROM events WHERE event_type IN ('purchase', 'error', 'signup') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
p AS (SELECT DISTINCT user_id FROM events)
SELECT p.user_id AS target, CASE WHEN event_type = 'signup' THEN 'broadMatch' ELSE 'closeMatch' END AS relation, CASE WHEN event_type IN ('purchase', 'signup') THEN 'accepted' WHEN event_type = 'error' THEN 'rejected' ELSE 'proposed' END AS status,
CASE WHEN event_type IS NULL THEN 'auto' ELSE 'auto+review' END AS method, CASE event_type WHEN 'purchase' THEN 'n; r: approve; e' || event_id WHEN 'signup' THEN 'n; r: revise; e' || event_id WHEN 'error' THEN 'n; r: object; e' || event_id ELSE 'n' END AS note
FROM p LEFT JOIN h USING (user_id)""")
def review_overlay(t):
    lit = F.lit
    proposals = t.events.select(F.col("user_id").alias("target"), lit("closeMatch").alias("relation"), lit("proposed").alias("status"), lit("auto").alias("method"), lit("n").alias("note")).distinct()
    e = F.col("event_type")
    decision = F.when(e == "purchase", "approve").when(e == "signup", "revise").otherwise("object")
    kind = F.when(e.isin("purchase", "error", "signup"), "human").otherwise("agent")
    reviews = t.events.select(F.col("user_id").alias("target"), decision.alias("decision"), lit("broadMatch").alias("relation"), lit("r").alias("reviewer"), kind.alias("reviewer_kind"), F.col("ts").alias("decided_at"), F.concat(lit("e"), F.col("event_id")).alias("rationale"), F.col("event_id").alias("seq"))
    return claims.overlay(proposals, reviews)


@query("SELECT event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def current_integration(t):
    return t.events.groupBy("event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("""WITH l AS (SELECT DISTINCT p_brand AS term, p_type AS lang, p_size % 3 AS kind, p_name AS text FROM part),
k AS (SELECT *, CASE WHEN kind = 0 AND row_number() OVER (PARTITION BY term, lang, kind ORDER BY text) = 1 THEN 'pref' WHEN kind <= 1 THEN 'alt' ELSE 'hidden' END AS label_kind FROM l),
p AS (SELECT term, lang, text AS pref FROM k WHERE label_kind = 'pref')
SELECT DISTINCT k.term, k.lang, label_kind, text FROM k LEFT JOIN p USING (term, lang) WHERE label_kind = 'pref' OR text IS DISTINCT FROM pref""")
def label_pref_demotion(t):
    rows = t.part.select(F.col("p_brand").alias("term"), F.col("p_type").alias("lang"), (F.col("p_size") % 3).alias("kind"), F.col("p_name").alias("text"))
    return claims.prefer_labels(rows)[0]


@query("SELECT user_id, last(value ORDER BY ts, event_id) AS value FROM events GROUP BY 1")
def upsert_last_wins(t):
    rows = t.events.select("user_id", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"))
    return claims.upsert(rows.where("seq = 1"), rows.where("seq > 1"), ["user_id"]).select("user_id", "value")


@query("SELECT c_custkey AS id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'active' ELSE 'deprecated' END AS status FROM customer")
def deprecate_vanished(t):
    return claims.deprecate(t.customer.select(F.col("c_custkey").alias("id"), F.lit("active").alias("status")), t.orders.select(F.col("o_custkey").alias("id")))


# Links and checks


@query("""SELECT p_partkey, 'http://x.org/' || lower(p_type) || '/' || p_partkey AS link, CASE lower(p_type) WHEN 'economy' THEN 'eco/' || p_partkey WHEN 'promo' THEN 'pro/' || p_partkey END AS id FROM part""")
def link_resolve_prefix(t):
    rows = t.part.select("p_partkey", F.concat(F.lit("http://x.org/"), F.lower("p_type"), F.lit("/"), F.col("p_partkey")).alias("link"))
    return links.resolve_prefix(rows, [("http://x.org/", "any"), ("http://x.org/economy/", "eco"), ("http://x.org/promo/", "pro")])


def _labels(t):
    kind = F.when(F.col("p_size") % 2 == 0, "pref").otherwise("alt")
    return t.part.select(F.col("p_brand").alias("concept"), F.col("p_type").alias("lang"), kind.alias("kind"), F.col("p_name").alias("text"))


def _checks(t):
    edges = t.nation.select(_id("n", "n_nationkey").alias("child"), _id("r", "n_regionkey").alias("parent"))
    related = t.supplier.select(_id("r", "s_nationkey").alias("a"), _id("n", "s_nationkey").alias("b"))
    relation = F.when(F.col("l_returnflag") == "R", "exactMatch").when(F.col("l_returnflag") == "A", "broadMatch").otherwise("closeMatch")
    maps = t.lineitem.select(F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), relation.alias("relation"))
    return graph.skos_checks(_labels(t), edges, related, maps)


@query("""SELECT DISTINCT a.p_brand AS concept, a.p_type AS lang, a.p_name AS text FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_name = b.p_name WHERE a.p_size % 2 = 1 AND b.p_size % 2 = 0""")
def skos_s13(t):
    return _checks(t)["S13"]


@query("SELECT p_brand AS concept, p_type AS lang, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1, 2 HAVING count(*) > 1")
def skos_s14(t):
    return _checks(t)["S14"]


@query("SELECT 'n/' || s_nationkey AS a, 'r/' || s_nationkey AS b FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = s_nationkey")
def skos_s27(t):
    return _checks(t)["S27"]


@query("SELECT l_partkey AS from_id, l_suppkey AS to_id FROM lineitem a WHERE l_returnflag = 'R' AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey AND b.l_returnflag = 'A')")
def skos_s46(t):
    return _checks(t)["S46"]


@query("""SELECT 'notation' AS "check", p_name || '|' || p_brand AS key, count(*) || ' rows' AS detail FROM part GROUP BY p_name, p_brand HAVING count(*) > 1""")
def unique_notation(t):
    return integrity.unique(t.part, ["p_name", "p_brand"], "notation")


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey")
def symmetric_pairs(t):
    return graph.symmetric(t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")))


@query("SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60")
def set_vanished(t):
    ids = lambda condition: t.events.where(condition).select(F.col("user_id").alias("id"))
    return links.vanished(ids("event_type = 'view'"), ids("event_type = 'purchase' and value > 60"))


@query("""SELECT 'n/' || n_nationkey AS from_id, 'r/' || n_regionkey AS to_id, 'broadMatch' AS relation, false AS inverse FROM nation UNION ALL SELECT 'r/' || n_regionkey, 'n/' || n_nationkey, 'narrowMatch', true FROM nation""")
def mapping_union_inverse(t):
    return links.with_inverse(t.nation.select(_id("n", "n_nationkey").alias("from_id"), _id("r", "n_regionkey").alias("to_id"), F.lit("broadMatch").alias("relation")))


@query("""WITH m AS (SELECT 's/' || s_suppkey AS f, 'wd/' || s_nationkey AS t FROM supplier UNION SELECT 'n/' || n_nationkey, 'wd/' || n_nationkey FROM nation),
b AS (SELECT f, t FROM m UNION SELECT t, f FROM m), far AS (SELECT x.f AS id, x.t AS via, y.t AS to_id FROM b x JOIN b y ON y.f = x.t WHERE x.t LIKE 'wd/%' AND y.t <> x.f)
SELECT id, via, to_id FROM (SELECT f AS id, NULL AS via, t AS to_id, 0 AS p FROM b UNION ALL SELECT id, via, to_id, 1 FROM far) QUALIFY row_number() OVER (PARTITION BY id, to_id ORDER BY p, via) = 1""")
def linked_two_hops(t):
    maps = t.supplier.select(_id("s", "s_suppkey").alias("from_id"), _id("wd", "s_nationkey").alias("to_id")).unionByName(t.nation.select(_id("n", "n_nationkey").alias("from_id"), _id("wd", "n_nationkey").alias("to_id")))
    return links.two_hops(maps.withColumns({"relation": F.lit("exactMatch"), "status": F.lit("accepted")}), "wd")


@query("""SELECT DISTINCT o_custkey AS subject, o_orderpriority AS code FROM orders WHERE o_orderstatus = 'F' AND regexp_matches(o_orderpriority, '^[12]-') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def hub_join(t):
    rows = t.orders.select(F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("predicate"), F.col("o_orderpriority").alias("value"))
    return links.hub(rows, "F", t.orders.select(F.col("o_orderpriority").alias("code")).distinct(), t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("subject")), "^[12]-")


@query("""WITH l AS (SELECT source AS id, lang, source || lang || max(doc_id) AS text FROM documents GROUP BY source, lang)
SELECT id, arg_min(text, CASE lang WHEN 'en' THEN '0' ELSE '3' || lang END) AS label FROM l GROUP BY 1""")
def display_labels(t):
    rows = t.documents.groupBy(F.col("source").alias("id"), "lang").agg(F.max("doc_id").alias("m")).select("id", "lang", F.concat("id", "lang", "m").alias("text"))
    return links.display_label(rows)


# Statistics


def _members(t):
    return t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("grp"))


SHARES_SQL = """m AS (SELECT DISTINCT o_custkey AS id, o_orderpriority AS grp FROM orders), w AS (SELECT id, grp, 1.0::DOUBLE / count(*) OVER (PARTITION BY id) AS w FROM m),
s AS (SELECT grp, sum(w) AS weight, sum(w) / (SELECT count(DISTINCT id) FROM m) AS share FROM w GROUP BY grp)"""


@query(f"WITH {SHARES_SQL} SELECT grp, round(weight, 6) AS weight, round(share, 6) AS share FROM s")
def fractional_shares(t):
    return audit.shares(_members(t)).select("grp", F.round("weight", 6).alias("weight"), F.round("share", 6).alias("share"))


@query(f"""WITH {SHARES_SQL}, b AS (SELECT o_orderpriority AS grp, count(*)::DOUBLE / sum(count(*)) OVER () AS base FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1), n AS (SELECT count(DISTINCT id)::DOUBLE AS n FROM m)
SELECT grp, round(share, 6) AS share, round(greatest(0, (share + z2 / (2 * n)) / (1 + z2 / n) - z * sqrt(share * (1 - share) / n + z2 / (4 * n * n)) / (1 + z2 / n)), 6) AS low,
round(least(1, (share + z2 / (2 * n)) / (1 + z2 / n) + z * sqrt(share * (1 - share) / n + z2 / (4 * n * n)) / (1 + z2 / n)), 6) AS high, round(base, 6) AS base, round(share / base, 6) AS ratio, round(log2(share / base), 6) AS log2_ratio
FROM s LEFT JOIN b USING (grp), n, (SELECT 1.959964::DOUBLE AS z, 1.959964::DOUBLE * 1.959964::DOUBLE AS z2)""")
def representation_ratio(t):
    base = t.orders.where("o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count("*").cast("double").alias("base"))
    out = audit.representations(_members(t), base)
    return out.select("grp", *(F.round(c, 6).alias(c) for c in ("share", "low", "high", "base", "ratio", "log2_ratio")))


PAIR_SQL = """p AS (SELECT n_nationkey AS k, coalesce(c, 0)::DOUBLE / sum(coalesce(c, 0)) OVER () AS p, coalesce(s, 0)::DOUBLE / sum(coalesce(s, 0)) OVER () AS q FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey)"""


def _pair(t):
    c, s = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("c")), t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("s"))
    both = t.nation.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").fillna(0, ["c", "s"])
    every = Window.partitionBy()
    return both.select((F.col("c") / F.sum("c").over(every)).alias("p"), (F.col("s") / F.sum("s").over(every)).alias("q"))


@query(f"WITH {PAIR_SQL} SELECT round(greatest(0, sum(CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END)), 6) AS jsd FROM p")
def jensen_shannon(t):
    return _pair(t).agg(F.round(stats.jsd(F.col("p"), F.col("q")), 6).alias("jsd"))


@query(f"WITH {PAIR_SQL} SELECT round(-sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) / log2(count(q)), 6) AS entropy FROM p")
def normalized_entropy(t):
    return _pair(t).agg(F.round(stats.entropy(F.col("q")), 6).alias("entropy"))


@query("WITH v AS (SELECT o_custkey, count(*)::DOUBLE AS v FROM orders GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM v) SELECT round(sum((2 * i - n - 1) * v) / (any_value(n) * sum(v)), 6) AS gini FROM r")
def gini_orders(t):
    return stats.gini(t.orders.groupBy("o_custkey").agg(F.count("*").alias("v")), "v").select(F.round("gini", 6).alias("gini"))


@query("""SELECT c_nationkey AS parent, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS sd, round(stddev_pop(c_acctbal) / nullif(avg(c_acctbal), 0), 6) AS cv, round(CASE WHEN min(c_acctbal) > 0 THEN max(c_acctbal) / min(c_acctbal) END, 6) AS ratio FROM customer GROUP BY 1 HAVING count(*) >= 2""")
def sibling_parity(t):
    out = audit.parity(t.customer.select(F.col("c_nationkey").alias("parent"), F.col("c_custkey").alias("child"), F.col("c_acctbal").alias("v")))
    return out.select("parent", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "cv", "ratio")))


@query("""WITH v AS (SELECT c_nationkey AS parent, c_custkey AS child, count(o_orderkey) * (1 + c_custkey % 5) AS v FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2), m AS (SELECT parent, median(v) AS m FROM v GROUP BY 1)
SELECT parent, child, v FROM v JOIN m USING (parent) WHERE v >= 4 AND v >= 3 * greatest(m, 1)""")
def outsized_children(t):
    v = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("parent"), F.col("c_custkey").alias("child")).agg(F.count("*").alias("v"))
    return audit.outsized(v.withColumn("v", F.col("v") * (1 + F.col("child") % 5)))


@query("SELECT c_nationkey, list_sort(list(c_acctbal))[round_even(0.9 * (count(*) - 1), 0)::INT + 1] AS p90 FROM customer GROUP BY 1")
def percentile_nearest(t):
    return t.customer.groupBy("c_nationkey").agg(stats.nearest_rank(F.col("c_acctbal"), 0.9).alias("p90"))


@query("""SELECT n_regionkey AS root, count(*) AS n, sum((c_acctbal > 0)::INT)::BIGINT AS n_with, median(CASE WHEN c_acctbal > 0 THEN c_acctbal END) AS median, arg_min(c_custkey, CASE WHEN c_acctbal > 0 THEN (c_acctbal, c_custkey) END) AS least
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def median_min(t):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return audit.coverage(rows.select(F.col("n_regionkey").alias("root"), F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("value")))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 25")
def thinnest(t):
    return audit.thinnest(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, lang LIMIT 60")
def label_languages(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(60)


@query("SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1")
def scheme_counts(t):
    return t.nation.join(t.supplier.where("s_acctbal > 5000"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n"))


@query()
def audit_null(t):
    base = t.orders.groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count("*").cast("double").alias("base"))
    return audit.null_model(_members(t), base, 200)


# Evaluation and vectors


def _ranks(t):
    """The rank of the first neighbour of a query's own label, by cosine; queries are the vectors, languages their labels."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    named = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    near = semantic.nearest(rows, rows, 15).join(named, "id").join(named.select(F.col("id").alias("neighbour"), F.col("label").alias("theirs")), "neighbour")
    first = near.where("label = theirs").groupBy("id").agg((F.min("rank") + 1).alias("rank"))
    return named.join(first, "id", "left").select(F.col("id").alias("query"), F.concat(F.lit("l"), "label").alias("lang"), "rank")


METRICS_SQL = """e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), p AS (SELECT a.id, b.label = a.label AS same, round(list_cosine_similarity(a.v, b.v), 9) AS s, b.id AS other FROM e a, e b WHERE a.id <> b.id),
k AS (SELECT id, same, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS rank FROM p WHERE s > 0), f AS (SELECT id, min(rank) AS rank FROM k WHERE same AND rank <= 15 GROUP BY 1),
r AS (SELECT e.id, 'l' || label AS lang, rank FROM e LEFT JOIN f USING (id)),
m AS (SELECT lang, CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END AS mrr, CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END AS recall, CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END AS ndcg FROM r),
l AS (SELECT lang, count(*) AS n, avg(mrr) AS mrr, avg(recall) AS recall, avg(ndcg) AS ndcg FROM m GROUP BY 1)"""


@query(f"WITH {METRICS_SQL} SELECT lang, n, round(mrr, 6) AS mrr, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM l")
def eval_by_language(t):
    return evaluate.by_language(_ranks(t)).select("lang", "n", *(F.round(c, 6).alias(c) for c in ("mrr", "recall", "ndcg")))


@query(f"WITH {METRICS_SQL} SELECT round(avg(mrr), 6) AS mrr, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, arg_min(lang, (mrr, lang)) AS worst FROM l")
def eval_mrr_ndcg_recall(t):
    return evaluate.macro(_ranks(t)).select(*(F.round(c, 6).alias(c) for c in ("mrr", "recall", "ndcg")), "worst")


@query("""WITH a AS (SELECT l_returnflag AS query, l_partkey AS id, row_number() OVER (PARTITION BY l_returnflag ORDER BY sum(l_quantity) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_returnflag AS query, l_partkey AS id, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2),
s AS (SELECT query, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM a WHERE rank <= 100 UNION ALL SELECT * FROM b WHERE rank <= 100) GROUP BY 1, 2)
SELECT query, id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 100""")
def rrf_fusion(t):
    groups = t.lineitem.groupBy(F.col("l_returnflag").alias("query"), F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("c"))
    lists = None
    for system, by in (("a", "q"), ("b", "c")):
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(by), "id"))
        part = groups.withColumn("rank", rank).where("rank <= 100").select("query", F.lit(system).alias("system"), "id", "rank")
        lists = part if lists is None else lists.unionByName(part)
    return evaluate.fuse(lists).withColumn("score", F.round("score", 9)).withColumn("rank", F.col("rank").cast("long"))


@query()
def eval_bootstrap(t):
    return evaluate.bootstrap(_ranks(t))


@query()
def eval_paired_test(t):
    ranks = written(_ranks(t))  # one search for both sides
    other = ranks.withColumn("rank", F.when(F.col("query") % 3 == 0, F.col("rank")).otherwise(F.col("rank") + 1))
    return evaluate.paired_test(ranks, other)


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.id, b.id AS neighbour, list_cosine_similarity(a.v, b.v) AS s FROM e a, e b WHERE a.id <> b.id)
SELECT id, neighbour, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, neighbour) - 1 AS rank FROM p WHERE s > 0) WHERE rank < 6""")
def knn_cosine(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return semantic.nearest(rows, rows).select("id", "neighbour", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("SELECT label, i - 1 AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) r(i) GROUP BY label, i")
def centroid_by_label(t):
    return semantic.centroids(t.embeddings, "label", "embedding").select("label", F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"))


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


TFIDF_SQL = r"""tf AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '(\p{L}[\p{L}\p{N}_''-]*[\p{L}\p{N}]|\p{L})', 1)) AS term FROM documents) WHERE length(term) > 2 GROUP BY 1, 2),
n AS (SELECT count(*)::DOUBLE AS n FROM documents), df AS (SELECT term, count(*) AS df FROM tf, n GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= n / 2),
w AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n)"""


@query(f"WITH {TFIDF_SQL} SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w")
def tfidf_weights(t):
    return semantic.tfidf(t.documents, "doc_id", "text", t.documents.count()).withColumn("weight", F.round("weight", 6))


@query()
def lsa_neighbors(t):
    rows = t.benchmark.select("item_id", "text")
    ids = [r["item_id"] for r in rows.select("item_id").orderBy("item_id").collect()]  # a fixed small table
    ids, v = semantic.lsa(semantic.tfidf(rows, "item_id", "text", len(ids)), ids, 16)
    latent = t.spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "id long, v array<double>")
    return semantic.nearest(latent, latent)


# World time, hashes, sources


@query("SELECT o_orderkey, (epoch(o_orderdate)::BIGINT // 86400 + 2440588)::BIGINT AS jdn FROM orders")
def jdn_from_date(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", worldtime.jdn_gregorian(F.year(d), F.month(d), F.day(d)).alias("jdn"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS shown, (epoch(date_trunc('month', o_orderdate))::BIGINT // 86400 + 2440588)::BIGINT AS first_day, (epoch(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::BIGINT // 86400 + 2440587)::BIGINT AS last_day FROM orders""")
def wikidata_time_bounds(t):
    rows = t.orders.select("o_orderkey", F.date_format("o_orderdate", "'+'yyyy-MM-dd'T00:00:00Z'").alias("time"))
    read = worldtime.read_times(rows.withColumns({"precision": F.lit(10), "julian": F.lit(False)}), "time", "precision", "julian")
    return read.select("o_orderkey", "shown", "first_day", "last_day")


@query("SELECT sha256(string_agg(item_id || chr(9) || sha256(text) || chr(10), '' ORDER BY item_id || chr(9) || sha256(text) || chr(10))) AS manifest FROM benchmark")
def manifest_sha(t):
    return integrity.manifest(t.benchmark.select(F.col("item_id").cast("string").alias("name"), F.sha2("text", 256).alias("digest")), 256)


def _ledger(t):
    fields = {"at": F.lit("at"), "actor": F.lit("actor"), "action": F.lit("action"), "target": F.col("n_name"), "detail": F.col("n_regionkey").cast("string"), "receipt": F.lit(None).cast("string"), "undo": F.lit(None).cast("string")}
    return t.nation.select(F.col("n_nationkey").cast("long").alias("seq"), *(c.alias(n) for n, c in fields.items()))


CHAIN_SQL = """n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation), c AS (SELECT 0::BIGINT AS i, repeat('0', 64) AS prev, repeat('0', 64) AS hash
UNION ALL SELECT n.i, c.hash, sha256(c.hash || chr(31) || 'at' || chr(31) || 'actor' || chr(31) || 'action' || chr(31) || n_name || chr(31) || n_regionkey || chr(31) || chr(31)) FROM c JOIN n ON n.i = c.i + 1)"""


@query(f"WITH RECURSIVE {CHAIN_SQL} SELECT n_nationkey::BIGINT AS seq, prev, hash FROM c JOIN n USING (i)")
def ledger_chain(t):
    return integrity.chain(_ledger(t), 256).select("seq", "prev", "hash")


@query("SELECT n_nationkey::BIGINT AS seq, CASE WHEN n_nationkey % 7 = 3 THEN 'changed row' ELSE 'broken link' END AS problem FROM nation WHERE n_nationkey % 7 = 3 OR n_nationkey = 11 ORDER BY 1")
def ledger_verify(t):
    ledger = integrity.chain(_ledger(t), 256)
    forged = F.when(F.col("seq") % 7 == 3, "forged").otherwise(F.col("target"))
    return integrity.verify_chain(ledger.withColumn("target", forged).withColumn("prev", F.when(F.col("seq") == 11, "x").otherwise(F.col("prev"))), 256)


PART_MAPPING = lean.Mapping(
    id="p_partkey", labels=[{"column": "p_name", "lang": "en"}, {"column": "p_name", "kind": "alt", "lang": "en", "split": " "}], broader=[{"column": "p_parent"}], relations=[{"column": "p_brand", "pred": "brand"}],
    attrs=[{"column": "p_size", "pred": "size", "cast": "int"}, {"column": "p_retailprice", "pred": "price", "cast": "float"}, {"column": "p_type", "pred": "notation"}], where={"p_type": ["ECONOMY", "PROMO"]}, status=("p_size", [1, 2]),
)


def _lean(t):
    return lean.convert_table(t.part.withColumn("p_parent", (F.col("p_partkey") / 10).cast("long")), PART_MAPPING)


LEAN_SQL = "p AS (SELECT * FROM part WHERE p_type IN ('ECONOMY', 'PROMO'))"


@query(f"WITH {LEAN_SQL} SELECT DISTINCT p_partkey::VARCHAR AS code, 0::INT AS kind, 'en' AS lang, p_name AS text FROM p UNION SELECT p_partkey::VARCHAR, 1, 'en', unnest(string_split(p_name, ' ')) FROM p")
def csv_mapping_lean(t):
    return _lean(t).label


@query(f"WITH {LEAN_SQL} SELECT p_partkey::VARCHAR AS s, 'broader' AS pred, (p_partkey // 10)::VARCHAR AS o FROM p WHERE p_partkey // 10 IN (SELECT p_partkey FROM p) AND p_partkey // 10 <> p_partkey")
def lean_relations(t):
    return _lean(t).rel


@query(f"""WITH {LEAN_SQL} SELECT p_partkey::VARCHAR AS code, 'brand' AS pred, p_brand AS target FROM p UNION ALL SELECT p_partkey::VARCHAR, 'broader', (p_partkey // 10)::VARCHAR FROM p WHERE p_partkey // 10 NOT IN (SELECT p_partkey FROM p)""")
def lean_links(t):
    return _lean(t).link.select("code", "pred", "target")


@query(f"WITH {LEAN_SQL} SELECT 'part/' || p_partkey AS id, CASE WHEN p_size IN (1, 2) THEN 'deprecated' ELSE 'active' END AS status, p_type AS notation FROM p")
def integrate_full(t):
    return lean.integrate(_lean(t), "part")["concept"]


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1))::BIGINT AS n_links FROM pages""")
def html_title_links(t):
    return readers.titles_and_links(t.pages)


@query(" UNION ALL ".join(f"""SELECT '{x}' AS "table", count(*) AS n FROM {x}""" for x in ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")))
def table_stats(t):
    return integrity.table_stats({x: getattr(t, x) for x in ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")})


@query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(t):
    return ingest.windowed(t.events, "ts", ["event_type"])


@query("SELECT doc_id, lower(replace(trim(lang), '_', '-')) AS lang, regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def text_keys(t):
    return t.documents.select("doc_id", text.norm_lang(F.col("lang")).alias("lang"), text.slug(F.col("source")).alias("slug"))
