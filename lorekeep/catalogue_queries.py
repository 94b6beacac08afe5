"""More of the engine's operators as queries over the test tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text, worldtime
from lorekeep.operators import audit, claims, graph, grep, imports, integrate, integrity, records, search
from lorekeep.operators.stored import shared_path
from lorekeep.queries import TOKENS_SQL, Tables, _id, bm25_sql, hierarchy, query
from lorekeep.sources import web, wikidata
from lorekeep.sources.lean import Lean

# Search


def _prefix_sql() -> str:
    lists = TOKENS_SQL.format("p_name")
    return f"""WITH d AS (SELECT p_partkey AS id, len({lists})::DOUBLE AS len, len(list_filter({lists}, lambda y: starts_with(y, 'sm')))::DOUBLE AS tf, p_type FROM part),
s AS (SELECT count(*) AS n, avg(len) AS avgdl, sum((tf > 0)::INT) AS df FROM d)
SELECT id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl)), 6) AS score FROM d, s WHERE tf > 0"""


@query(_prefix_sql())
def grep_words_prefix(t):
    return search.words(t.part, "p_partkey", {"p_name": 1}, "sm*")[0].withColumn("score", F.round("score", 6))


@query(f"""WITH d AS (SELECT doc_id AS id, len(w)::DOUBLE AS len, (SELECT count(*) FROM range(1, len(w)) r(i) WHERE w[i] = 'the' AND w[i + 1] = 'be')::DOUBLE AS tf FROM (SELECT doc_id, {TOKENS_SQL.format("text")} AS w FROM documents)),
s AS (SELECT count(*) AS n, avg(len) AS avgdl, sum((tf > 0)::INT) AS df FROM d)
SELECT id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl)), 6) AS score FROM d, s WHERE tf > 0""")
def grep_words_phrase(t):
    return search.words(t.documents, "doc_id", {"text": 1}, '"the be"')[0].withColumn("score", F.round("score", 6))


@query("SELECT p_partkey AS id FROM part WHERE p_size % 7 = 0")
def grep_words_marks(t):
    greeting = "नमस्ते"
    rows = t.part.select("p_partkey", F.when(F.col("p_size") % 7 == 0, F.concat("p_name", F.lit(f" {greeting} दुनिया"))).otherwise(F.concat("p_name", F.lit(" नमस"))).alias("p_name"))
    return search.words(rows, "p_partkey", {"p_name": 1}, greeting)[0].select("id")


@query("SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'red') OR lower(p_type) = 'promo'")
def grep_words_columns(t):
    return search.words(t.part, "p_partkey", {"p_name": 1, "p_type": 1}, "p_name : red OR {p_type} : promo")[0].select("id")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a')")
def grep_substring_nfd(t):
    decomposed = F.regexp_replace("p_name", "[aA]", "Á")
    return search.substring(t.part.select("p_partkey", decomposed.alias("name")), "name", "Á", ["p_partkey"]).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'e[a-z]* ')")
def grep_regex_nfd(t):
    decomposed = F.replace("p_name", F.lit("e"), F.lit("é"))
    return search.regex(t.part.select("p_partkey", decomposed.alias("name")), "name", "é\\w* ", ["p_partkey"]).select("p_partkey")


@query("""WITH h AS (SELECT doc_id, text AS t, strpos(lower(text), 'tion') - 1 AS a, length(text) AS n FROM documents WHERE contains(lower(text), 'tion')),
w AS (SELECT doc_id, t, n, CASE WHEN a <= 70 THEN 0 WHEN strpos(substr(t, a - 69, 70), ' ') = 0 THEN a - 70 ELSE a - 70 + strpos(substr(t, a - 69, 70), ' ') END AS l,
  CASE WHEN a + 74 >= n THEN n WHEN strpos(substr(t, a + 5, 70), ' ') = 0 THEN a + 74 ELSE a + 74 - strpos(reverse(substr(t, a + 5, 70)), ' ') END AS r FROM h)
SELECT doc_id, CASE WHEN l > 0 THEN '…' ELSE '' END || substr(t, l + 1, r - l) || CASE WHEN r < n THEN '…' ELSE '' END AS shown,
  ((length(substr(t, l + 1, r - l)) - length(replace(lower(substr(t, l + 1, r - l)), 'tion', ''))) // 4)::BIGINT AS n_marked FROM w""")
def match_parts(t):
    rows = search.snippets(search.substring(t.documents, "text", "TION", ["doc_id"]), "text", "TION")
    shown = F.array_join(F.transform("parts", lambda p: p["t"]), "")
    return rows.select("doc_id", shown.alias("shown"), F.size(F.filter("parts", lambda p: p["m"])).cast("long").alias("n_marked"))


def _catalogue(t: Tables) -> grep.Catalogue:
    """Parts as concepts below brands, their types as labels, documents with their lines."""
    parts = t.part.select(_id("p", "p_partkey").alias("id"), F.when(F.col("p_size") % 11 == 0, "wd").otherwise("p").alias("scheme"), F.when(F.col("p_size") % 13 == 0, "deprecated").otherwise("active").alias("status"), F.col("p_name").alias("label"), F.lower("p_brand").alias("scope_note"), "p_brand", "p_type")
    labels = parts.select(F.col("id").alias("concept_id"), F.lit("en").alias("lang"), F.lit("alt").alias("kind"), F.col("p_type").alias("text")).unionByName(parts.select(F.col("id").alias("concept_id"), F.lit("de").alias("lang"), F.lit("pref").alias("kind"), F.col("label").alias("text")))
    docs = t.documents.select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("doc_id"), F.col("source").alias("title"), F.when(F.col("doc_id") % 5 == 0, "x").alias("superseded_by"), "text")
    lines = search.passages(docs, "doc_id", "text").select(F.col("id").alias("doc_id"), "ord", "text")
    about = t.documents.select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("doc_id"), F.concat(F.lit("p/"), F.col("doc_id") % 50 + 1).alias("concept_id"))
    edges = parts.select(F.col("id").alias("child"), F.col("p_brand").alias("parent"))
    return grep.Catalogue(parts.drop("p_brand", "p_type"), labels, docs.select("doc_id", "title", "superseded_by"), lines, about, edges)


@query(f"""WITH c AS (SELECT 'p/' || p_partkey AS id, p_name, p_type, lower(p_brand) AS note, {TOKENS_SQL.format("p_name")} AS a, {TOKENS_SQL.format("p_type")} AS b, {TOKENS_SQL.format("p_brand")} AS n FROM part WHERE p_size % 11 <> 0 AND p_size % 13 <> 0),
d AS (SELECT id, p_name, (len(a) + len(b) + len(n))::DOUBLE AS len, 10.0::DOUBLE * len(list_filter(a, lambda x: x = 'red')) + 5.0::DOUBLE * len(list_filter(b, lambda x: x = 'red')) + len(list_filter(n, lambda x: x = 'red')) AS tf FROM c),
s AS (SELECT count(*) AS n, avg(len) AS avgdl, sum((tf > 0)::INT) AS df FROM d)
SELECT 'concept' AS type, id AS target, p_name AS title, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl)), 4) AS score
FROM d, s WHERE tf > 0 ORDER BY greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl)) DESC, id LIMIT 20""")
def grep_concepts_words(t):
    return grep.grep(_catalogue(t), "red", scope="concepts", limit=20).hits.select("type", "target", "title", "score")


@query("""SELECT 'passage' AS type, 'doc/' || doc_id || '#p' || ord AS target, source AS title FROM (SELECT doc_id, source, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord
FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_id % 5 <> 0) WHERE regexp_replace(line, '\\s', '', 'g') <> '')
WHERE contains(lower(line), 'tion') ORDER BY 'doc/' || doc_id, ord LIMIT 40""")
def grep_passages_substring(t):
    return grep.grep(_catalogue(t), "tion", "substring", "passages", 40).hits.select("type", "target", "title")


@query("""SELECT 'label' AS type, 'p/' || p_partkey AS target, p_name AS title, 'de' AS lang FROM part WHERE p_size % 11 <> 0 AND regexp_matches(p_name, 'bl[a-z]+') AND p_brand = 'Brand#1' ORDER BY length(p_name), 'p/' || p_partkey LIMIT 30""")
def grep_labels_regex_under(t):
    return grep.grep(_catalogue(t), "bl[a-z]+", "regex", "labels", 30, under="Brand#1", lang="de").hits.select("type", "target", "title", "lang")


@query("""WITH n AS (SELECT least(50, count(*)) AS c FROM part WHERE p_size % 11 <> 0 AND p_size % 13 <> 0 AND (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') OR contains(lower(p_brand), 'ring'))),
l AS (SELECT least(50, count(*)) AS c FROM (SELECT p_name AS x FROM part WHERE p_size % 11 <> 0 UNION ALL SELECT p_type FROM part WHERE p_size % 11 <> 0) WHERE contains(lower(x), 'ring')),
p AS (SELECT least(50, count(*)) AS c FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents WHERE doc_id % 5 <> 0) WHERE contains(lower(x), 'ring'))
SELECT * FROM (SELECT 'concept' AS type, c AS n FROM n UNION ALL SELECT 'passage', c FROM p UNION ALL SELECT 'label', c FROM l) WHERE n > 0""")
def grep_all_scopes(t):
    return grep.grep(_catalogue(t), "ring", "substring").hits.groupBy("type").agg(F.count("*").alias("n"))


@query(bm25_sql("part", "p_partkey::VARCHAR", {"p_name": 1, "p_type": 1}, ["red", "promo"]))
def grep_stored_index(t):
    path = shared_path(t.spark, "index")
    grep.build_index(t.part, "p_partkey", ["p_name", "p_type"], path)
    return grep.search_index(t.spark, path, "red promo")[0].withColumn("score", F.round("score", 6))


@query("SELECT DISTINCT p_brand AS term, first(p_name ORDER BY length(p_name), p_name) OVER (PARTITION BY p_brand ORDER BY length(p_name), p_name) AS text FROM part")
def argmin_best_names(t):
    hits = t.part.select(F.col("p_brand").alias("term"), F.lit("en").alias("lang"), F.lit(0).alias("kind"), F.col("p_name").alias("text"), (-F.length("p_name")).cast("double").alias("score"))
    return records.best_names(hits).select("term", "text")


@query("""SELECT p_partkey AS id, p_name AS label, CASE WHEN lower(p_name) = 'red ring' THEN 0 WHEN starts_with(lower(p_name), 'red') THEN 1 ELSE 2 END AS rank, strpos(lower(p_name), 'red') AS "at" FROM part
WHERE contains(lower(p_name), 'red') ORDER BY rank, "at", p_retailprice DESC, p_name, p_partkey LIMIT 40""".replace("'red ring'", "'red'"))
def label_ranking(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_retailprice").alias("mass"))
    return records.rank_labels(rows, "Red", 40).select("id", "label", "rank", F.col("at").cast("long").alias("at"))


@query("SELECT p_partkey AS id, p_name AS text FROM part WHERE p_type <> 'PROMO' AND NOT starts_with(p_type, 'PROMO-')")
def leave_one_language_out(t):
    return records.leave_out(t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("lang"), F.col("p_name").alias("text")), "PROMO").select("id", "text")


# Reading


@query("""WITH f AS (SELECT n_regionkey AS r, c_custkey AS id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0) SELECT 'r/' || r AS region, count(DISTINCT id) AS n FROM f GROUP BY 1""")
def region_tags(t):
    tagged = t.customer.where("c_acctbal > 0").select("c_custkey", _id("n", "c_nationkey").alias("place"))
    places = graph.closure(t.nation.select(_id("n", "n_nationkey").alias("child"), _id("r", "n_regionkey").alias("parent")))
    inside = places.select(F.col("node").alias("place"), F.col("ancestor").alias("region")).where("region like 'r/%'")
    return tagged.join(inside, "place").groupBy("region").agg(F.countDistinct("c_custkey").alias("n"))


@query("SELECT count(DISTINCT lang) AS n FROM documents")
def distinct_languages(t):
    return t.documents.agg(F.countDistinct("lang").alias("n"))


@query("SELECT o_custkey AS concept_id, max(o_totalprice) AS sitelinks, max(o_totalprice + o_orderkey % 100) AS sitelinks_all, max(o_totalprice + o_orderkey % 100) - max(o_totalprice) AS difference FROM orders GROUP BY 1 ORDER BY difference DESC, 1 LIMIT 10")
def attention_differences(t):
    links = t.orders.select(F.col("o_custkey").alias("concept_id"), F.col("o_totalprice").alias("sitelinks"), (F.col("o_totalprice") + F.col("o_orderkey") % 100).alias("sitelinks_all"))
    return records.attention(links, 10)


@query("SELECT event_type AS model, max(ts) AS created_at FROM events WHERE event_type IN (SELECT event_type FROM events WHERE value > 99.5) GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1")
def newest_model(t):
    models = t.events.groupBy(F.col("event_type").alias("model")).agg(F.max("ts").alias("created_at"))
    return records.newest_model(models, t.events.where("value > 99.5").select(F.col("event_type").alias("model")))


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR (o_custkey = 70 AND o_orderkey % 2 = 0)")
def reviews_of_concept(t):
    target = F.when((F.col("o_custkey") == 70) & (F.col("o_orderkey") % 2 == 0), F.lit("mapping:c_7|x")).when(F.col("o_custkey") == 70, F.lit("mapping:cx7|x")).otherwise(F.concat(F.lit("c_"), F.col("o_custkey")))
    return records.reviews_about(t.orders.select("o_orderkey", target.alias("target")), "c_7").select("o_orderkey")


@query("""SELECT 'p/' || l_partkey AS from_id, 's/' || l_suppkey AS to_id, relation FROM (SELECT l_partkey, l_suppkey, CASE WHEN l_partkey % 3 = 0 THEN 'exactMatch' WHEN l_partkey % 3 = 1 THEN 'closeMatch' ELSE 'broadMatch' END AS relation FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size % 2 = 0)""")
def review_queue(t):
    relation = F.when(F.col("l_partkey") % 3 == 0, "exactMatch").when(F.col("l_partkey") % 3 == 1, "closeMatch").otherwise("broadMatch")
    maps = t.lineitem.where("l_returnflag = 'R'").select("l_partkey", _id("p", "l_partkey").alias("from_id"), _id("s", "l_suppkey").alias("to_id"), relation.alias("relation"), F.lit("accepted").alias("status"), F.lit("ai+rule").alias("method")).distinct()
    seen = maps.join(t.part.where("p_size % 2 = 0"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    reviews = seen.select(F.concat_ws("", F.lit("mapping:"), F.col("from_id"), F.lit("|"), F.col("to_id")).alias("target"), F.lit("human").alias("reviewer_kind"))
    return records.review_queue(maps.drop("l_partkey"), reviews).select("from_id", "to_id", "relation")


@query("""WITH e AS (SELECT o_orderstatus AS predicate, o_orderkey, count(l_linenumber) AS refs, coalesce(bool_or(l_returnflag = 'R'), false) AS sourced FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT predicate, count(*) AS n, sum((refs > 0)::INT)::BIGINT AS n_referenced, sum(sourced::INT)::BIGINT AS n_sourced, round(sum(sourced::INT) / count(*)::DOUBLE, 6) AS share FROM e GROUP BY 1""")
def evidence_share(t):
    prop = F.when(F.col("l_returnflag") == "A", "P143").when(F.col("l_returnflag") == "N", "P813").otherwise("P248")
    ev = claims.evidence(t.orders.select(F.col("o_orderkey").alias("claim_id")), t.lineitem.select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("ref_id"), prop.alias("property")))
    named = ev.join(t.orders.select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderstatus").alias("predicate")), "claim_id")
    return records.evidence_share(named).withColumn("share", F.round("share", 6))


@query("""SELECT CASE WHEN l_returnflag = 'R' THEN 'model' WHEN l_returnflag = 'A' THEN 'human' ELSE 'none' END AS decider, l_linestatus AS relation, count(*) AS n, sum((l_quantity > 25)::INT)::BIGINT AS n_accepted FROM lineitem GROUP BY 1, 2""")
def review_coverage(t):
    who = F.when(F.col("l_returnflag") == "R", "AI model 1").when(F.col("l_returnflag") == "A", "Ada").otherwise("")
    return records.review_coverage(t.lineitem.select(who.alias("reviewer"), F.col("l_linestatus").alias("relation"), F.when(F.col("l_quantity") > 25, "accepted").otherwise("proposed").alias("status")))


@query("SELECT o_orderpriority AS source, count(*) AS n, sum((o_orderstatus = 'F')::INT)::BIGINT AS n_downloaded, CASE WHEN bool_or(o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') THEN NULL ELSE sum(o_orderkey)::BIGINT END AS bytes FROM orders GROUP BY 1")
def plan_table(t):
    size = F.when(~((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")), F.col("o_orderkey"))
    return records.expected(t.orders.select(F.col("o_orderpriority").alias("source"), size.alias("size"), (F.col("o_orderstatus") == "F").alias("downloaded")))


@query("SELECT CASE WHEN l_partkey = 5 THEN 's/' || l_suppkey END AS other, 'related' AS kind, max(l_quantity) AS weight FROM lineitem WHERE l_partkey = 5 GROUP BY 1")
def node_neighbours(t):
    return records.neighbourhood(t.lineitem.select(_id("p", "l_partkey").alias("s"), _id("s", "l_suppkey").alias("t"), F.lit("related").alias("k"), F.col("l_quantity").alias("w")), "p/5")


@query("SELECT p_brand AS brand, string_agg(p_name, ' | ' ORDER BY p_name) AS joined FROM part GROUP BY 1")
def ordered_group_concat(t):
    return records.joined_names(t.part, "p_brand", "p_name").withColumnRenamed("p_brand", "brand")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 1")
def most_common_value(t):
    return records.most_common(t.events, "event_type", "event_id")


@query("SELECT event_type AS corpus, max(ts) AS at FROM events WHERE user_id::VARCHAR LIKE '1%' GROUP BY 1")
def record_times(t):
    return records.record_time(t.events.select(F.col("event_type").alias("corpus"), F.col("user_id").cast("string").alias("name"), F.col("ts").alias("retrieved_at")), "1")


@query("SELECT user_id, (row_number() OVER (ORDER BY min(event_id), user_id) - 1)::BIGINT AS place FROM events GROUP BY 1")
def first_mention_order(t):
    return records.first_mentions(t.events, "user_id", "event_id")


@query("""SELECT l_linestatus AS "check", l_orderkey || '|' || l_linenumber AS key, l_returnflag AS detail FROM lineitem WHERE l_quantity > 40 QUALIFY row_number() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey || '|' || l_linenumber, l_returnflag) <= 50""")
def violations_first_50(t):
    rows = t.lineitem.where("l_quantity > 40").select(F.col("l_linestatus").alias("check"), F.concat_ws("|", "l_orderkey", "l_linenumber").alias("key"), F.col("l_returnflag").alias("detail"))
    return records.first_violations(rows)


@query("SELECT o_orderkey AS doc_id, c_custkey AS concept_id FROM orders JOIN customer ON o_custkey % 100 = c_custkey % 100")
def title_multimap(t):
    concepts = t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("t"), F.col("c_custkey") % 100).alias("page"))
    documents = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("T"), F.col("o_custkey") % 100).alias("title"))
    aliases = t.customer.select(F.concat(F.lit("t"), F.col("c_custkey") % 100).alias("alias"), F.concat(F.lit("T"), F.col("c_custkey") % 100).alias("title")).distinct()
    return records.documents_of_titles(concepts, documents, aliases)


@query("SELECT a.p_partkey AS id, a.p_name AS text, b.v FROM part a JOIN (SELECT p_name, min(p_size) AS v FROM part WHERE p_size > 10 GROUP BY 1) b USING (p_name)")
def hash_key_join(t):
    vectors = t.part.where("p_size > 10").groupBy(F.sha2("p_name", 256).alias("key")).agg(F.min("p_size").alias("v"))
    return records.vectors_of_texts(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), vectors)


@query("SELECT p_partkey AS id, p_name AS text FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 10)")
def hash_key_missing(t):
    vectors = t.part.where("p_size > 10").select(F.sha2("p_name", 256).alias("key")).distinct()
    return records.without(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), vectors)


@query("SELECT c_custkey AS doc_id, coalesce(string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus), '') AS found FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def batched_lookups(t):
    ids = t.customer.select(F.col("c_custkey").alias("doc_id"))
    return records.batched(ids, "doc_id", t.orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("value")), "value").withColumn("found", F.array_join("found", ","))


@query("SELECT id FROM (SELECT 'n/' || n_nationkey AS id FROM nation UNION ALL SELECT 'r/' || r_regionkey FROM region) WHERE split_part(id, '/', 1) <> 'r'")
def scheme_filter(t):
    ids = t.nation.select(_id("n", "n_nationkey").alias("id")).unionByName(t.region.select(_id("r", "r_regionkey").alias("id")))
    return records.in_schemes(ids, "id", t.spark.createDataFrame([("r",)], "scheme string"), inside=False)


@query("SELECT p_partkey FROM part WHERE lower(substr(p_name, 1, 3)) = 'red'")
def like_prefix(t):
    return records.with_prefix(t.part, "p_name", "RED").select("p_partkey")


@query("SELECT id, kind FROM (SELECT 'n/' || n_nationkey AS id, 'nation' AS kind FROM nation UNION ALL SELECT 'r/' || r_regionkey, 'region' FROM region UNION ALL SELECT 'x/1', NULL)")
def resolve_ids(t):
    nations, regions = t.nation.select(_id("n", "n_nationkey").alias("id")), t.region.select(_id("r", "r_regionkey").alias("id"))
    ids = nations.unionByName(regions).unionByName(t.spark.createDataFrame([("x/1",)], "id string"))
    return records.resolve(ids, {"nation": nations, "region": regions})


@query("""SELECT 'n/3' AS id, (SELECT 'r/' || n_regionkey FROM nation WHERE n_nationkey = 3) AS broader, (SELECT count(*) FROM customer WHERE c_nationkey = 3) AS n_narrower, (SELECT count(DISTINCT s_suppkey) FROM supplier WHERE s_nationkey = 3) AS n_mappings, 1::BIGINT AS n_labels""")
def node_record(t):
    e = hierarchy(t).where("not child like 'o/%'")
    ids = e.select(F.col("child").alias("id")).unionByName(t.region.select(_id("r", "r_regionkey").alias("id"))).withColumn("label", F.upper("id"))
    labels = t.nation.select(_id("n", "n_nationkey").alias("concept_id"), F.lit("pref").alias("kind"), F.lit("en").alias("lang"), F.col("n_name").alias("text"))
    maps = t.supplier.select(_id("s", "s_suppkey").alias("from_id"), _id("n", "s_nationkey").alias("to_id"), F.lit("closeMatch").alias("relation"), F.lit("accepted").alias("status"))
    none = t.spark.createDataFrame([], "a string, b string")
    docs = t.spark.createDataFrame([], "concept_id string, doc_id string, title string")
    said = t.spark.createDataFrame([], "subject string, predicate string, value string, superseded_at string")
    row = records.node("n/3", ids, labels, e, none, maps, docs, said)
    size = lambda c: F.size(c).cast("long")
    return row.select("id", F.col("broader")[0]["other"].alias("broader"), size("narrower").alias("n_narrower"), size("mappings").alias("n_mappings"), size("labels").alias("n_labels"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND (a.p_size - b.p_size) ** 2 + (a.p_retailprice - b.p_retailprice) ** 2 <= 4.0""")
def grid_neighbours(t):
    return records.nearby(t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y")), 2.0)


# Writing


@query("""WITH d AS (SELECT l_partkey, l_suppkey, l_returnflag, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_returnflag <> 'N' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 5))
SELECT 'p/' || l_partkey AS from_id, 's/' || l_suppkey AS to_id, CASE WHEN last(l_returnflag ORDER BY seq) = 'R' THEN 'accepted' ELSE 'proposed' END AS status FROM d GROUP BY l_partkey, l_suppkey""")
def decisions_to_mappings(t):
    status = F.when(F.col("l_returnflag") == "R", "accepted").when(F.col("l_returnflag") == "A", "proposed").otherwise("unmatched")
    rows = t.lineitem.select(_id("p", "l_partkey").alias("from_id"), _id("s", "l_suppkey").alias("to_id"), F.lit("closeMatch").alias("relation"), status.alias("status"), F.lit("m").alias("method"), F.lit("").alias("reviewer"), F.lit("").alias("note"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return imports.decisions_to_mappings(rows, t.part.where("p_size > 5").select(_id("p", "p_partkey").alias("id"))).select("from_id", "to_id", "status")


@query("""SELECT 'x' || l_partkey AS from_id, 'x' || l_suppkey AS to_id, (l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 30) AND l_suppkey IN (SELECT p_partkey FROM part WHERE p_size < 30)) AS linked FROM lineitem GROUP BY l_partkey, l_suppkey""")
def second_pass_links(t):
    known = t.part.where("p_size < 30").select(F.concat(F.lit("x"), F.col("p_partkey")).alias("id"))
    ends = t.lineitem.select(F.concat(F.lit("x"), F.col("l_partkey")).alias("from_id"), F.concat(F.lit("x"), F.col("l_suppkey")).alias("to_id")).distinct()
    ok, dangling = imports.second_pass(ends, known)
    return ok.withColumn("linked", F.lit(True)).unionByName(dangling.withColumn("linked", F.lit(False)))


@query("""SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'now' WHEN o_orderstatus = 'P' THEN 'before' END AS superseded_at FROM orders""")
def supersede_by_source(t):
    rows = t.orders.select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderstatus").alias("source_sha"), F.when(F.col("o_orderstatus") == "P", "before").alias("superseded_at"))
    sources = t.spark.createDataFrame([("F",), ("P",)], "sha string")
    return imports.supersede_sources(rows, sources, F.lit("now"), rows.where("claim_id % 10 = 0")).select("claim_id", "superseded_at")


@query("""SELECT event_id AS doc_id, nullif(last_value(event_id) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), event_id) AS superseded_by FROM events""")
def supersede_documents(t):
    rows = t.events.select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("family"), F.col("user_id").alias("name"), F.col("ts").alias("corpus"))
    return imports.supersede_documents(rows).select("doc_id", "superseded_by")


@query("SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents GROUP BY 1 ORDER BY 1 LIMIT 5)")
def clear_regenerable(t):
    again = t.documents.select("source").distinct().orderBy("source").limit(5).select(F.col("source").alias("sha"))
    return imports.without_sources(t.documents.select("doc_id", F.col("source").alias("source_sha")), again).select("doc_id")


@query("""SELECT c_custkey AS id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'deprecated' ELSE 'active' END AS status FROM customer""")
def retire_schemes(t):
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("scheme"), F.lit("active").alias("status"))
    return imports.retired(rows, t.spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "scheme string")).select("id", "status")


@query("""SELECT key, problem FROM (SELECT o_orderkey AS key, unnest([CASE WHEN o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' THEN 'an objection gives its reason' END, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'a revision names a relation' END, CASE WHEN o_orderkey % 7 = 0 THEN 'no reviewer' END]) AS problem FROM orders) WHERE problem IS NOT NULL""")
def review_problems(t):
    s = F.col("o_orderstatus")
    decision = F.when(s == "O", "object").when(s == "P", "revise").otherwise("approve")
    rows = t.orders.select(
        F.col("o_orderkey").alias("target"), decision.alias("decision"), F.when((s == "P") & (F.col("o_orderkey") % 2 == 1), "broadMatch").alias("relation"), F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise("Ada").alias("reviewer"),
        F.lit("human").alias("reviewer_kind"), F.lit("2024-01-02").alias("decided_at"), F.when(F.col("o_orderpriority") == "1-URGENT", "because").alias("rationale"),
    )
    return imports.review_problems(rows)


@query("""SELECT l_suppkey::VARCHAR AS id, arg_min(l_returnflag, (l_orderkey * 10 + l_linenumber, l_returnflag)) AS label, 1.0::DOUBLE AS w FROM lineitem GROUP BY 1""")
def graph_nodes_parsed(t):
    nodes = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_suppkey").cast("string").alias("id"), F.col("l_returnflag").alias("label"), F.lit(None).cast("double").alias("mass"))
    return imports.parsed_graph(nodes, t.spark.createDataFrame([], "s long, t long, k string, w double"))[0].select("id", "label", F.col("mass").alias("w"))


@query("""SELECT 'one concept an id' AS "check", p_name AS key, count(*) || ' rows' AS detail FROM part GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'status of concepts', p_name, 'not allowed' FROM part WHERE p_size % 10 = 0 UNION ALL SELECT 'no concept is above itself', l_partkey::VARCHAR, 'not allowed' FROM lineitem WHERE l_partkey = l_suppkey""")
def declared_constraints(t):
    concept = t.part.select(F.col("p_name").alias("id"), F.when(F.col("p_size") % 10 == 0, "lost").otherwise("active").alias("status"))
    edges = t.lineitem.select(F.col("l_partkey").cast("string").alias("child"), F.col("l_suppkey").cast("string").alias("parent"))
    return imports.constraints({"concept": concept}).unionByName(imports.constraints({"broader": edges}))


@query("SELECT c_custkey AS id, c_mktsegment AS scheme, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS descendants FROM customer")
def concept_view(t):
    stat = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_custkey").alias("id")).agg(F.count("o_orderkey").alias("descendants")).withColumns({"depth": F.lit(0), "root": F.lit("r")})
    imports.create_views(t.spark, {"concept": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("scheme")), "concept_stat": stat})
    return imports.read_only(t.spark, "SELECT id, scheme, descendants FROM v_concept", 10_000_000)


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') AND regexp_matches(p_name, 'r.d ')")
def registered_functions(t):
    imports.register(t.spark)
    t.part.createOrReplaceTempView("part_names")
    return t.spark.sql("SELECT p_partkey FROM part_names WHERE contains_any_case(p_name, 'RED') AND matches(p_name, 'r.d ') AND case_key(p_name) IS NOT NULL")


@query("""SELECT sum(n)::BIGINT AS n, count(*) AS lines FROM (SELECT 1 AS n FROM nation UNION ALL SELECT 1 FROM region UNION ALL SELECT 0 FROM nation)""")
def graph_export(t):
    nodes = t.nation.select(_id("n", "n_nationkey").alias("id")).unionByName(t.region.select(_id("r", "r_regionkey").alias("id")))
    edges = t.nation.select(_id("n", "n_nationkey").alias("s"), _id("r", "n_regionkey").alias("t"), F.lit("broader").alias("k"), F.lit(1.0).alias("w"))
    return imports.graph_document(nodes, edges).agg(F.count_if(F.get_json_object("line", "$.type") == "node").alias("n"), F.count("*").alias("lines"))


# Sources


@query("""WITH v AS (SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey) SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM v UNION SELECT 'r' || r_regionkey, 'w' FROM region""")
def region_parents(t):
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lit("en").alias("lang"), F.col("n_nationkey").alias("seq"), F.lit("w").alias("global_code"), F.lit("World").alias("global_name"), F.concat(F.lit("r"), F.col("r_regionkey")).alias("region_code"), F.col("r_name").alias("region_name"),
        F.lit("").alias("sub_code"), F.lit("").alias("sub_name"), F.lit(None).cast("string").alias("mid_code"), F.lit(None).cast("string").alias("mid_name"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("code"), F.col("n_name").alias("name"),
    )
    return web.regions(rows)[1]


@query("""SELECT o_custkey AS id, arg_max(year(o_orderdate), o_orderdate)::INT AS year, arg_max(o_totalprice, (year(o_orderdate), o_totalprice)) AS value FROM orders WHERE o_custkey < 676 GROUP BY 1""")
def indicator_values(t):
    letters = F.concat(F.lit("A"), F.chr(F.lit(65) + F.floor(F.col("o_custkey") / 26).cast("int")), F.chr((F.lit(65) + F.col("o_custkey") % 26).cast("int")))
    rows = t.orders.where("o_custkey < 676")
    point = F.struct(letters.alias("countryiso3code"), F.date_format("o_orderdate", "yyyy").alias("date"), F.col("o_totalprice").alias("value"))
    content = rows.groupBy((F.col("o_orderkey") % 10).alias("page")).agg(F.concat(F.lit("[{}, "), F.to_json(F.collect_list(point)), F.lit("]")).alias("content"))
    return web.indicators(content, rows.select(letters.alias("iso3"), F.col("o_custkey").alias("id")).distinct())[0]


@query("""SELECT page_id AS id, CASE WHEN page_id % 4 = 0 THEN 'no page' ELSE 'not on the page' END AS problem FROM pages WHERE page_id % 4 = 0 OR page_id % 4 = 1""")
def captions_unverified(t):
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    kind = F.col("page_id") % 4
    captions = t.pages.select(F.col("page_id").alias("id"), F.when(kind == 0, "http://none").otherwise(F.concat("url", F.lit("#"), F.col("page_id"))).alias("url"), F.when(kind == 1, "zzz qqq").otherwise(F.upper(title)).alias("quote"))
    return web.unverified(captions, t.pages.select(F.concat("url", F.lit("#"), F.col("page_id")).alias("url"), "html"))


def _payloads(t: Tables) -> DataFrame:
    """Orders as statements of their customers: P1 the clerk's item, P585 the day as a qualifier, a reference each."""
    snak = lambda p, kind, value: F.to_json(F.struct(F.lit("value").alias("snaktype"), F.lit(p).alias("property"), F.lit(kind).alias("datatype"), F.struct(F.lit("wikibase-entityid" if kind == "wikibase-item" else kind).alias("type"), value.alias("value")).alias("datavalue")))
    item = F.struct(F.concat(F.lit("Q"), F.col("o_orderkey") % 100).alias("id"))
    day = F.struct(F.date_format("o_orderdate", "'+'yyyy-MM-dd'T00:00:00Z'").alias("time"), F.when(F.col("o_orderstatus") == "P", 9).when(F.col("o_orderstatus") == "O", 10).otherwise(11).alias("precision"), F.lit("http://www.wikidata.org/entity/Q1985727").alias("calendarmodel"))
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", "preferred").otherwise("normal")
    st = F.concat(
        F.lit('{"id":"Q'), F.col("o_custkey"), F.lit("$"), F.col("o_orderkey"), F.lit('","rank":"'), rank, F.lit('","mainsnak":'), snak("P1", "wikibase-item", item), F.lit(',"qualifiers":{"P585":['), snak("P585", "time", day),
        F.lit(']},"references":[{"hash":"h","snaks":{"P248":['), snak("P248", "wikibase-item", item), F.lit("]}}]}"),
    )
    entity = t.orders.select("o_custkey", "o_orderkey", st.alias("st")).groupBy("o_custkey").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "st"))), lambda x: x["st"])).alias("list"))
    one = F.concat(F.lit('"Q'), F.col("o_custkey"), F.lit('":{"lastrevid":1,"claims":{"P1":['), F.col("list"), F.lit("]}}"))
    return entity.select(F.concat(F.lit("entities/"), F.col("o_custkey")).alias("name"), F.lit("2024-01-01").alias("retrieved_at"), F.concat(F.lit('{"entities":{'), one, F.lit("}}")).alias("content"))


DAYS = """CASE o_orderstatus WHEN 'P' THEN date_trunc('year', o_orderdate) WHEN 'O' THEN date_trunc('month', o_orderdate) ELSE date_trunc('day', o_orderdate) END"""
SPAN = """CASE o_orderstatus WHEN 'P' THEN INTERVAL 1 YEAR WHEN 'O' THEN INTERVAL 1 MONTH ELSE INTERVAL 1 DAY END"""


@query(f"""SELECT 'Q' || o_custkey || '$' || o_orderkey AS statement_id, 'wd/Q' || o_custkey AS subject, 'wd/P1' AS predicate, 'wd/Q' || (o_orderkey % 100) AS object, CASE WHEN o_orderpriority = '1-URGENT' THEN 'preferred' ELSE 'normal' END AS rank,
'/entities/Q' || o_custkey || '/claims/P1/' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS source_pointer,
CASE o_orderstatus WHEN 'P' THEN strftime(o_orderdate, '%Y') WHEN 'O' THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS valid_from, CASE o_orderstatus WHEN 'P' THEN 9 WHEN 'O' THEN 10 ELSE 11 END AS time_precision,
(epoch({DAYS})::BIGINT // 86400 + 2440588)::BIGINT AS valid_from_day, (epoch({DAYS} + {SPAN})::BIGINT // 86400 + 2440587)::BIGINT AS valid_to_day FROM orders""")
def statement_claims(t):
    cols = ["statement_id", "subject", "predicate", "object", "rank", "source_pointer", "valid_from", "time_precision", "valid_from_day", "valid_to_day"]
    return wikidata.statements(_payloads(t))["claims"].select(*cols)


@query("SELECT DISTINCT 'Q' || (o_orderkey % 100) AS id FROM orders UNION SELECT unnest(['P1', 'P585', 'P248'])")
def referenced_entities(t):
    return wikidata.referenced(_payloads(t))


@query("SELECT 'Q' || o_custkey || '$' || o_orderkey AS statement_id, 'h' AS ref_hash, 'wd/P248' AS property, 'wd/Q' || (o_orderkey % 100) AS object FROM orders")
def statement_references(t):
    return wikidata.statements(_payloads(t))["references"].select("statement_id", "ref_hash", "property", "object")


_TIMES = [
    ("-0001-00-00T00:00:00Z", 9, False, "0000", 1721060, 1721425), ("+1582-10-05T00:00:00Z", 11, True, "1582-10-15", 2299161, 2299161), ("+1500-00-00T00:00:00Z", 9, True, "1500", 2268933, 2269298), ("+1500-03-00T00:00:00Z", 10, True, "1500", 2268993, 2269023),
    ("+1900-00-00T00:00:00Z", 7, False, "1900", 2378862, 2415385), ("+1879-03-00T00:00:00Z", 11, False, "1879-03", 2407410, 2407440), ("-13798000000-00-00T00:00:00Z", 3, False, "-13797999999", None, None), ("-4800-00-00T00:00:00Z", 9, False, "-4799", None, None),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{s}', {'NULL' if x is None else x}::BIGINT, {'NULL' if y is None else y}::BIGINT)" for a, _, _, s, x, y in _TIMES) + ") v(time, shown, first_day, last_day)")
def world_times(t):
    rows = t.spark.createDataFrame([r[:3] for r in _TIMES], "time string, precision int, julian boolean")
    return worldtime.read_times(rows, "time", "precision", "julian").select("time", "shown", "first_day", "last_day")


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'no value' WHEN 1 THEN p_name WHEN 2 THEN p_size || ' Q11' ELSE p_name || ' (en)' END AS shown FROM part")
def claim_values_shown(t):
    k = F.col("p_size") % 4
    quantity = F.to_json(F.struct(F.concat(F.lit("+"), F.col("p_size")).alias("amount"), F.lit("http://www.wikidata.org/entity/Q11").alias("unit")))
    value = F.when(k == 2, quantity).when(k == 3, F.to_json(F.struct(F.col("p_name").alias("text"), F.lit("en").alias("language"))))
    rows = t.part.select(F.col("p_partkey").alias("id"), F.when(k == 0, "novalue").otherwise("value").alias("snak_type"), F.when(k == 1, "wd/Q1").alias("object"), F.when(k == 1, F.col("p_name")).alias("object_label"), value.alias("value"), F.when(k == 2, "quantity").when(k == 3, "monolingualtext").alias("datatype"), F.lit(None).cast("string").alias("shown_time"))
    return records.rendered(rows).select("id", "shown")


@query("""SELECT p_partkey AS id, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda x: x), ' ') AS spelled FROM part""")
def spellings(t):
    return t.part.select(F.col("p_partkey").alias("id"), text.spelling(F.replace("p_name", F.lit(" "), F.lit("--"))).alias("spelled"))


@query("""SELECT a.p_brand AS id, (b.n)::BIGINT AS n FROM (SELECT DISTINCT p_brand FROM part) a JOIN (SELECT p_brand, least(5, count(DISTINCT p_partkey)) AS n FROM part GROUP BY 1) b USING (p_brand)""")
def reconciled_counts(t):
    concepts = t.part.select(F.col("p_brand").alias("id"), F.lower("p_brand").alias("text")).distinct()
    candidates = t.part.select(F.concat(F.lit("Q"), F.col("p_partkey")).alias("qid"), F.col("p_brand").alias("text"), F.col("p_type").alias("description"), F.lit(1).alias("rank"), F.col("p_size").alias("sitelinks"))
    return web.reconciled(concepts, candidates).groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT scheme, ids FROM (SELECT r_name AS scheme, string_agg(n_name, ',' ORDER BY n_name) AS ids, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0 GROUP BY 1) WHERE n > 1")
def registry_conflicts(t):
    sources = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("id"), F.col("r_name").alias("scheme"), "n_nationkey")
    return web.conflicts(sources.drop("n_nationkey"), sources.where("n_nationkey % 2 = 0").select("id"))



# Integration: parts of two types become concepts of a scheme, a frame for every destination


def _integrated(t: Tables) -> dict[str, DataFrame]:
    p = t.part.where("p_type in ('ECONOMY', 'PROMO')").withColumn("code", F.col("p_partkey").cast("string"))
    n, none = F.col("p_partkey"), F.lit(None)
    term = p.select("code", (F.col("p_size") == 1).cast("int").alias("status"), F.col("p_type").alias("kind"))
    label = p.select("code", F.lit(0).alias("kind"), F.when(n % 3 == 0, "de").otherwise("en").alias("lang"), F.col("p_name").alias("text")).unionByName(p.select("code", F.lit(1).alias("kind"), F.lit("en").alias("lang"), F.col("p_name").alias("text")))
    ends = p.select(F.col("code").alias("s"), F.when(n % 2 == 0, "broader").otherwise("made_with").alias("pred"), (F.floor(n / 10)).cast("string").alias("o")).where("s <> o")
    rel = ends.join(term.select(F.col("code").alias("o")), "o", "left_semi").select("s", "pred", "o")
    empty = lambda kind: none.cast(kind)
    row = lambda pred, lang, i, r, x: p.select("code", F.lit(pred).alias("pred"), lang.alias("lang"), i.alias("value_int"), r.alias("value_real"), x.alias("value_text"))
    attr = (
        row("definition", F.when(n % 5 == 0, "fr").otherwise("en"), empty("bigint"), empty("double"), F.concat(F.lit("d "), "p_name")).where(n % 2 == 0)
        .unionByName(row("scopeNote", F.lit("en"), empty("bigint"), empty("double"), F.concat(F.lit("s "), "p_name")))
        .unionByName(row("notation", F.lit(""), empty("bigint"), empty("double"), F.col("p_brand"))).unionByName(row("notation", F.lit(""), empty("bigint"), empty("double"), F.lit("zz")))
        .unionByName(row("isReplacedBy", F.lit(""), empty("bigint"), empty("double"), F.concat(F.lit("http://w/"), "code")).where("p_size = 1"))
        .unionByName(row("size", F.lit(""), F.col("p_size").cast("bigint"), empty("double"), empty("string")))
    )
    link = p.select("code", F.when(n % 2 == 0, "exactMatch").otherwise("seeAlso").alias("pred"), empty("string").alias("map"), F.when(n % 7 == 0, "nothing known").when(n % 3 == 0, F.concat(F.lit("http://w/"), "code")).otherwise(F.concat(F.lit("GO:"), "code")).alias("target"))
    preds = t.spark.createDataFrame([("definition", "note", None, None), ("scopeNote", "note", None, None), ("notation", "notation", None, None), ("isReplacedBy", "replacedBy", None, None), ("exactMatch", None, "exactMatch", None), ("broader", "broader", None, None)], "pred string, role string, map string, datatype string")
    facets = t.spark.createDataFrame([("PROMO", "f/promo")], "kind string, facet_id string")
    return integrate.integrate(Lean(term, label, rel, attr, link), "x", preds, integrate.Resolver((("http://w/", "wd"),), (("GO", "go"),)), facets)


_X = "p AS (SELECT *, p_partkey AS n FROM part WHERE p_type IN ('ECONOMY', 'PROMO'))"
_TARGET = "CASE WHEN n % 7 = 0 THEN NULL WHEN n % 3 = 0 THEN 'wd/' || n ELSE 'go/' || n END"


@query(f"""WITH {_X} SELECT 'x/' || n AS id, n::VARCHAR AS code, p_name AS label, CASE WHEN n % 2 = 0 AND n % 5 <> 0 THEN 'd ' || p_name ELSE 's ' || p_name END AS scope_note,
p_brand AS notation, CASE WHEN p_size = 1 THEN 'deprecated' ELSE 'active' END AS status, CASE WHEN p_size = 1 THEN 'wd/' || n END AS replaced_by FROM p""")
def integrated_concepts(t):
    return _integrated(t)["concept"]


@query(f"""WITH {_X} SELECT 'x/' || n AS id, CASE WHEN n % 3 = 0 THEN 'de' ELSE 'en' END AS lang, 'pref' AS kind, p_name AS text FROM p UNION SELECT 'x/' || n, 'en', 'alt', p_name FROM p WHERE n % 3 = 0
UNION SELECT 'x/' || n, CASE WHEN n % 5 = 0 THEN 'fr' ELSE 'en' END, 'desc', 'd ' || p_name FROM p WHERE n % 2 = 0""")
def integrated_labels(t):
    return _integrated(t)["label"]


@query(f"WITH {_X} SELECT 'x/' || n AS child, 'x/' || (n // 10) AS parent FROM p WHERE n % 2 = 0 AND n // 10 <> n AND n // 10 IN (SELECT n FROM p)")
def integrated_broader(t):
    return _integrated(t)["broader"]


@query(f"WITH {_X} SELECT 'x/' || n AS from_id, {_TARGET} AS to_id, 'exactMatch' AS relation, 'declared:x (exactMatch)' AS method, 'proposed' AS status FROM p WHERE n % 2 = 0 AND n % 7 <> 0")
def integrated_mappings(t):
    return _integrated(t)["mapping"]


@query(f"""WITH {_X} SELECT 'x/' || n AS subject, 'x/@size' AS predicate, NULL::VARCHAR AS object, p_size::VARCHAR AS value, 'int' AS datatype FROM p UNION ALL SELECT 'x/' || n, 'x/@notation', NULL, 'zz', 'string' FROM p
UNION ALL SELECT 'x/' || n, 'x/@scopeNote', NULL, '{{"language":"en","text":"s ' || p_name || '"}}', 'monolingualtext' FROM p UNION ALL SELECT 'x/' || n, 'x/@made_with', 'x/' || (n // 10), NULL, 'wikibase-item' FROM p WHERE n % 2 = 1 AND n // 10 <> n AND n // 10 IN (SELECT n FROM p)
UNION ALL SELECT 'x/' || n, 'x/@seeAlso', {_TARGET}, CASE WHEN n % 7 = 0 THEN 'nothing known' END, CASE WHEN n % 7 = 0 THEN 'external-id' ELSE 'wikibase-item' END FROM p WHERE n % 2 = 1""")
def integrated_claims(t):
    return _integrated(t)["claim"]


@query(f"WITH {_X} SELECT 'x/' || n AS id, 'f/promo' AS facet_id FROM p WHERE p_type = 'PROMO'")
def integrated_facets(t):
    return _integrated(t)["facet"]


@query(f"WITH {_X} SELECT (SELECT count(*) FROM p WHERE n % 3 <> 0)::BIGINT AS labels_dropped, (SELECT count(*) FROM p WHERE n % 2 = 0 AND n % 7 = 0)::BIGINT AS links_unresolved")
def integrated_counts(t):
    return _integrated(t)["counts"]


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'wd/Q' || p_size WHEN 1 THEN 'go/GO_' || p_size WHEN 2 THEN 'm49/' || p_size END AS id FROM part""")
def link_resolve_forms(t):
    k = F.col("p_size") % 4
    link = F.when(k == 0, F.concat(F.lit("http://www.wikidata.org/entity/Q"), "p_size")).when(k == 1, F.concat(F.lit("P686:GO:"), "p_size")).when(k == 2, F.concat(F.lit("m:"), "p_size")).otherwise(F.lit("m:not a code"))
    r = integrate.Resolver((("http://www.wikidata.org/entity/", "wd"), ("http://www.wikidata.org/", "x")), (("m", "m49"),), (("P686", "go"),))
    return r(t.part.select("p_partkey", link.alias("target"))).select("p_partkey", "id")


# Audits and checks


@query("""WITH a AS (SELECT 1 AS level, 'r/' || n_regionkey AS area, 'n/' || n_nationkey AS id FROM nation UNION SELECT 1, 'r/' || r_regionkey, 'r/' || r_regionkey FROM region UNION SELECT 1, 'r/' || n_regionkey, 'c/' || c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_nationkey < 5
UNION SELECT 2, 'n/' || n_nationkey, 'n/' || n_nationkey FROM nation UNION SELECT 2, 'n/' || c_nationkey, 'c/' || c_custkey FROM customer WHERE c_nationkey < 5) SELECT level, area, count(*) AS n FROM a GROUP BY 1, 2""")
def region_grouping(t):
    top = t.region.select(_id("r", "r_regionkey").alias("child"), F.lit("w").alias("parent"))
    edges = top.unionByName(t.nation.select(_id("n", "n_nationkey").alias("child"), _id("r", "n_regionkey").alias("parent"))).unionByName(t.customer.where("c_nationkey < 5").select(_id("c", "c_custkey").alias("child"), _id("n", "c_nationkey").alias("parent")))
    return graph.areas(edges, "w").groupBy("level", "area").agg(F.count("*").alias("n"))


@query("""SELECT 'orders' AS metric, o_orderstatus AS key, unnest(['n', 'total']) AS measure, unnest([count(*)::DOUBLE, round(sum(o_totalprice), 2)]) AS value FROM orders GROUP BY 2
UNION ALL SELECT 'parts', p_brand, 'n', count(*)::DOUBLE FROM part GROUP BY 2""")
def audit_run(t):
    orders = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return audit.long_rows({"orders": orders, "parts": t.part.groupBy("p_brand").agg(F.count("*").alias("n"))})


@query("""SELECT 'concepts' AS part, p_name AS key, count(*) || ' rows' AS detail FROM part GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'concepts', p_name, 'not allowed' FROM part WHERE p_size % 10 = 0
UNION ALL SELECT 'ledger', n_nationkey::VARCHAR, 'changed row' FROM nation WHERE n_nationkey = 7""")
def verify_all(t):
    concept = t.part.select(F.col("p_name").alias("id"), F.when(F.col("p_size") % 10 == 0, "lost").otherwise("active").alias("status"))
    fields = {c: F.lit("x") for c in integrity.FIELDS}
    ledger = integrity.chain(t.nation.select(F.col("n_nationkey").cast("long").alias("seq"), *(v.alias(c) for c, v in fields.items())), 256)
    forged = ledger.withColumn("detail", F.when(F.col("seq") == 7, "y").otherwise(F.col("detail")))
    return imports.verified({"concepts": imports.constraints({"concept": concept}).select("key", "detail"), "ledger": integrity.verify_chain(forged, 256)})
