"""Search over a small catalogue, its imports, stores and archives."""

import bz2
import gzip
import io
import json
import lzma
import random
import re
import sqlite3
import tarfile
import unicodedata
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.operators import grep, imports, integrate, integrity, records, search
from lorekeep.sources import archives, web
from lorekeep.sources.lean import Lean


@pytest.fixture(scope="module")
def catalogue(spark):
    labels = [
        ("a/physics", "en", "pref", "physics"), ("a/physics", "zh", "pref", "物理学"), ("a/physics", "tr", "pref", "Fizik"), ("a/sky", "en", "pref", "sky god"), ("a/sky", "en", "alt", "Tengri"), ("a/sky", "hi", "pref", "विज्ञान"),
        ("a/city", "tr", "pref", "İstanbul şehri"), ("a/cafe", "fr", "pref", "café noir"), ("a/ring", "en", "pref", "ringing bells"), ("a/ring2", "en", "pref", "a ring"), ("wd/Q1", "en", "pref", "physics item"),
    ]
    concepts = [(i, i.split("/")[0], "active", t, None) for i, t in {"a/physics": "physics", "a/sky": "sky god", "a/city": "Istanbul", "a/cafe": "café", "a/ring": "ringing bells", "a/ring2": "a ring", "wd/Q1": "Q1", "a/indo": "Indo-European languages"}.items()] + [("a/old", "a", "deprecated", "physics of old", None)]
    docs = [("d1", "Sky", None, "the sky god Tengri and the sky\n\nrings ring"), ("d2", "Old sky", "d1", "the sky"), ("d3", "Else", None, "physics")]
    documents = spark.createDataFrame(docs, "doc_id string, title string, superseded_by string, text string")
    lines = search.passages(documents, "doc_id", "text").select(F.col("id").alias("doc_id"), "ord", "text")
    return grep.Catalogue(
        spark.createDataFrame(concepts, "id string, scheme string, status string, label string, scope_note string"), spark.createDataFrame(labels, "concept_id string, lang string, kind string, text string"),
        documents.drop("text"), lines, spark.createDataFrame([("d1", "a/sky"), ("d3", "a/physics")], "doc_id string, concept_id string"), spark.createDataFrame([("a/sky", "a/belief"), ("a/belief", "a/root")], "child string, parent string"),
    )


def found(c, pattern, **options):
    return [r.target for r in grep.grep(c, pattern, **options).hits.collect()]


def test_modes_and_scopes(catalogue):
    assert found(catalogue, "physics", scope="concepts") == ["a/physics"]
    answer = grep.grep(catalogue, "Indo-European", scope="concepts")
    assert [r.target for r in answer.hits.collect()] == ["a/indo"] and answer.notes and answer.plan
    assert found(catalogue, "विज्ञान", scope="labels") == ["a/sky"]
    assert set(found(catalogue, "ring*", scope="labels")) == {"a/ring", "a/ring2"}
    assert found(catalogue, "fizik", mode="substring", scope="labels", lang="tr") == ["a/physics"]
    assert found(catalogue, "istanbul", mode="substring", scope="labels") == ["a/city"]
    assert found(catalogue, "CAFÉ", mode="substring", scope="labels") == ["a/cafe"] == found(catalogue, "caf. n", mode="regex", scope="labels")
    for mode in ("words", "substring"):
        assert found(catalogue, "物理", mode=mode, scope="labels") == ["a/physics"]
    assert found(catalogue, "学物", scope="labels") == []
    assert found(catalogue, "sky", scope="passages") == ["d1#p0"] == found(catalogue, "sky", scope="passages", under="a/root")
    assert found(catalogue, "physics", scope="passages", under="a/belief") == []
    every = grep.grep(catalogue, "physics", limit=1).hits.collect()
    assert [(r.type, r.target) for r in every] == [("concept", "a/physics"), ("passage", "d3#p0"), ("label", "a/physics")]
    hit = grep.grep(catalogue, "tengri", mode="substring", scope="passages").hits.first()
    assert [(p.t, p.m) for p in hit.parts] == [("the sky god ", False), ("Tengri", True), (" and the sky", False)] and hit.concepts == ["a/sky"]
    stale = grep.grep(catalogue, "Tengri", mode="regex", scope="labels", key_version="0")
    assert [r.target for r in stale.hits.collect()] == ["a/sky"] and "every row" in stale.notes[0]
    for bad in ({"mode": "fuzzy"}, {"scope": "pages"}):
        with pytest.raises(grep.GrepError):
            grep.grep(catalogue, "x", **bad)
    with pytest.raises(grep.GrepError, match="invalid"):
        grep.grep(catalogue, "(unclosed", mode="regex")
    with pytest.raises(grep.GrepError, match="empty"):
        grep.grep(catalogue, "  ")


def test_search_misses_nothing(spark):
    """Against a plain scan with Python's re, over texts with case pairs, marks and texts that are not in NFC."""
    rng = random.Random(7)
    pool = ["Straße", "ISPARTA", "ısparta", "Kelvin 5K", "ſalz", "café", "café", "İstanbul", "ΣΑΣ σας", "Ангелы", "naïve", "x" * 70, "Å Å", "ǅ dž", "ﬁne"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 5)))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, t string").cache()
    for _ in range(12):
        source = unicodedata.normalize("NFC", rng.choice(pool))
        i = rng.randrange(len(source) - 1)
        needle = rng.choice([str.upper, str.lower, str.swapcase, str])(source[i : i + rng.randint(1, 4)])
        plain = re.compile(re.escape(unicodedata.normalize("NFC", needle)), re.I)
        want = {i for i, t in rows if plain.search(unicodedata.normalize("NFC", t))}
        assert {r.id for r in search.substring(df, "t", needle, ["id"]).collect()} == want, needle
        pattern = rng.choice(["{}", "(?i){}", "{}|zzz", "(?:{})+"]).format(re.escape(source[i : i + 4]))
        want = {i for i, t in rows if re.search(pattern, unicodedata.normalize("NFC", t))}
        assert {r.id for r in search.regex(df, "t", pattern, ["id"]).collect()} == want, pattern
    df.unpersist()


def test_keys_of_all_characters(spark):
    """The native key of every character is that of Python's fold."""
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = [(i, "".join(chars[i : i + 64])) for i in range(0, len(chars), 64)]
    df = spark.createDataFrame(rows, "i int, t string").repartition(8)
    table = text._fold_map()
    got = df.select("i", "t", text.fold_key(F.col("t")).alias("k")).collect()
    assert all(r.k == r.t.translate(table) for r in got)
    single = spark.createDataFrame([(c,) for c in chars if c.lower() != c or c.translate(table) != c], "t string").repartition(8)
    assert all(r.k == r.t.translate(table) for r in single.select("t", text.fold_key(F.col("t")).alias("k")).collect())
    odd = [(c, unicodedata.normalize("NFC", "a" + c) != "a" + c or unicodedata.normalize("NFC", c) != c) for c in chars[0x250:0x3400]]
    flags = spark.createDataFrame([(c,) for c, _ in odd], "c string").select("c", text.needs_nfc(F.col("c")).alias("f")).collect()
    assert all(r.f or not changes for r, (_, changes) in zip(flags, odd, strict=True))


def test_words_without_diacritics(spark):
    rows = spark.createDataFrame([(1, "Éléphants à l'école"), (2, "elephants"), (3, "école")], "id long, t string")
    ids = lambda q: sorted(r.id for r in search.words(rows, "id", {"t": 1}, q)[0].collect())
    assert ids("ecole") == [1, 3] == ids("école") and ids("éléphants") == [1, 2] and ids("elephants NOT ecole") == [2]
    assert ids('"a l ecole"') == [1] and ids("NEAR(elephants ecole, 1)") == [] and ids("NEAR(elephants ecole, 2)") == [1] and ids("^elephants") == [1, 2] and ids("a + l + eco*") == [1]


def test_stored_index_equals_a_scan(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["alpha", "beta", "gamma", "delta", "alphabet", "Épée"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9))), rng.choice(vocabulary)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    grep.build_index(df, "id", ["a", "b"], f"{tmp_path}/i")
    weights = {"a": 2.0, "b": 1.0}
    for q in ("alpha", "alpha beta", "alph*", '"alpha beta"', "gamma OR delta NOT beta", "b : epee", "NEAR(alpha gamma, 2)", "what's this"):
        scan, stored = search.words(df, "id", weights, q)[0], grep.search_index(spark, f"{tmp_path}/i", q, weights)[0]
        assert {(str(r.id), round(r.score, 6)) for r in scan.collect()} == {(r.id, round(r.score, 6)) for r in stored.collect()}, q
    plan = grep.search_index(spark, f"{tmp_path}/i", "alpha")[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "folder" in plan


def test_snippets_of_any_text(spark):
    assert search.marked("the sky god Tengri and the sky", [(4, 7), (27, 30)]) == [("the ", False), ("sky", True), (" god Tengri and the ", False), ("sky", True)]
    assert search.marked("", []) == [] and search.marked("ab" * 100, [], 10) == [("ab" * 10, False), ("…", False)]
    long = "word " * 40 + "needle" + " word" * 40
    parts = search.marked(long, [(200, 206)], 12)
    assert parts == [("…", False), ("word word ", False), ("needle", True), (" word word", False), ("…", False)]
    assert search.literal_spans("abc", "") == []
    row = search.snippets(spark.createDataFrame([("un café noir",), (None,)], "t string"), "t", "CAFÉ").collect()
    assert [(p.t, p.m) for p in row[0].parts] == [("un ", False), ("café", True), (" noir", False)] and row[1].parts is None
    assert spark.range(1).select(search.parts_from_marks(F.lit("a \x02b\x03 c"))).first()[0] == [("a ", False), ("b", True), (" c", False)]


def test_passages_of_repeated_ids_and_many_lines(spark):
    many = "\n".join(f" line {i}\t" if i % 3 else "" for i in range(1500))
    rows = search.passages(spark.createDataFrame([(1, "a\n\n b \r\nc"), (1, "xx\ny"), (2, many), (3, None), (4, "")], "id long, t string"), "id", "t").collect()
    assert sorted((r.ord, r.start, r.end, r.text) for r in rows if r.id == 1) == sorted([(0, 0, 1, "a"), (1, 3, 7, "b"), (2, 8, 9, "c"), (0, 0, 2, "xx"), (1, 3, 4, "y")])
    got = sorted((r.ord, r.start, r.end, r.text) for r in rows if r.id == 2)
    want, at = [], 0
    for x in many.split("\n"):
        if x.strip():
            want.append((len(want), at, at + len(x), x.strip()))
        at += len(x) + 1
    assert got == want and not [r for r in rows if r.id in (3, 4)]


def test_archives(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("b/x.tsv", "1\t2\r\n3\t4\n")
        f.writestr("y.txt", "é\n")
    (tmp_path / "a.zip").write_bytes(z.getvalue())
    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("n.tsv")
        info.size = 3
        t.addfile(info, io.BytesIO(b"5\t6"))
    for name, pack in (("d.tsv.gz", gzip.compress), ("e.tsv.bz2", bz2.compress), ("f.tsv.xz", lzma.compress)):
        (tmp_path / name).write_bytes(pack(name.encode()))
    (tmp_path / "g.tsv").write_bytes(b"\xff")
    every = archives.members(spark, str(tmp_path), "*.tsv")
    assert sorted(r.member for r in every.collect()) == ["b/x.tsv", "d.tsv", "e.tsv", "f.tsv", "g.tsv", "n.tsv"]
    assert [(r.number, r.line) for r in archives.text_lines(archives.one(every, "b/x.*")).collect()] == [(0, "1\t2"), (1, "3\t4")]
    for bad in ("*.none", "*.tsv"):
        with pytest.raises(ValueError):
            archives.one(every, bad)
    with pytest.raises(PySparkException, match="not UTF-8"):
        archives.text_lines(archives.one(every, "g.tsv")).collect()


def test_sqlite_and_blobs(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "w.db")
    con.execute("CREATE TABLE wish(id INTEGER, title TEXT)")
    con.executemany("INSERT INTO wish VALUES (?, ?)", [(1, "a"), (2, None)])
    con.commit()
    con.close()
    assert [tuple(r) for r in archives.sqlite_table(spark, str(tmp_path / "w.db"), "SELECT id, title FROM wish ORDER BY id", "id long, title string").collect()] == [(1, "a"), (2, None)]
    items = spark.createDataFrame([("a", b"same"), ("b", b"same"), ("c", b"other")], "name string, content binary")
    stored = archives.blobs(items)
    assert sorted(r.names for r in stored.collect()) == [["a", "b"], ["c"]]
    assert archives.damaged(stored).count() == 0
    worse = stored.withColumn("content", F.when(F.array_contains("names", "c"), F.lit(b"oth3r")).otherwise(F.col("content")))
    assert [r.problem for r in archives.damaged(worse).collect()] == ["bytes"]
    with pytest.raises(PySparkException, match="two contents"):
        archives.blobs(items.unionByName(spark.createDataFrame([("a", b"new")], items.schema))).collect()


def test_reviews(spark):
    schema = "seq long, target string, decision string, relation string, reviewer string, reviewer_kind string, decided_at string, rationale string"
    old = spark.createDataFrame([(1, "a/x", "approve", None, "Ada", "human", "2024-01-01", None)], schema)
    new = spark.createDataFrame([(1, "mapping:a/x|wd/Q1", "revise", "broadMatch", "Ada", "human", "2024-01-02", None), (2, "mapping:a/x|wd/Q2", "approve", None, "Ada", "human", "2024-01-02", None), (3, "a/y", "maybe", "x", "", "robot", "today", None)], schema)
    rows, bad = imports.append_reviews(old, new, spark.createDataFrame([("a/x", "wd/Q1")], "from_id string, to_id string"))
    assert sorted((r.seq, r.target) for r in rows.collect()) == [(1, "a/x"), (2, "mapping:a/x|wd/Q1")]
    assert sorted((r.key, r.problem) for r in bad.collect()) == [
        ("a/y", "no date"), ("a/y", "no reviewer"), ("a/y", "only a revision names a relation"), ("a/y", "unknown decision"), ("a/y", "unknown kind of reviewer"), ("mapping:a/x|wd/Q2", "no such mapping"),
    ]


def test_snapshots(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, x string")
    new, receipt = imports.migrated(df, 1, {1: [("y", F.lit(0))], 2: [("z", F.lit("q"))]})
    assert new.columns == ["id", "x", "y", "z"] and receipt.first().digest == imports.row_set(df.repartition(3).orderBy(F.desc("id")), ["id", "x"]).first().digest
    assert imports.row_set(df, ["id"]).first().digest != receipt.first().digest
    with pytest.raises(ValueError):
        imports.migrated(df, 9, {})
    lists = spark.createDataFrame([("s1", "h1", 1), ("s2", "h2", 2)], "sha string, name string, seq long")
    again = imports.new_sources(lists, spark.createDataFrame([("s1", "other", 5), ("s3", "h3", 6)], lists.schema))
    assert sorted((r.sha, r.name) for r in again.collect()) == [("s1", "h1"), ("s2", "h2"), ("s3", "h3")]
    done = spark.createDataFrame([(1, "p", "l1", "full"), (2, "p", "l2", "full")], "id long, scheme string, lean_sha string, mode string")
    todo = spark.createDataFrame([("p", "l2", "full"), ("p", "l1", "full"), ("q", "l1", "attach")], "scheme string, lean_sha string, mode string")
    assert sorted(map(tuple, imports.to_integrate(todo, done).collect())) == [("p", "l1", "full"), ("q", "l1", "attach")]
    nodes = spark.createDataFrame([(0, "a", "A", 1.0), (1, "", "B", 1.0), (2, "a", "again", 2.0), (3, "c", "C", None)], "seq long, id string, label string, mass double")
    edges = spark.createDataFrame([(0, 3, "k", 5.0), (2, 3, "k", 0.1), (0, 2, "k", 1.0), (1, 3, "k", 1.0), (0, 9, "k", 1.0)], "s long, t long, k string, w double")
    kept, lines, counts = imports.parsed_graph(nodes, edges)
    assert sorted(map(tuple, kept.collect())) == [("a", "A", 1.0), ("c", "C", 1.0)] and [tuple(r) for r in lines.collect()] == [("a", "c", "k", 1.0)] and tuple(counts.first()) == (4, 2, 5, 1)
    a, b = imports.graph_digest(kept, lines).first(), imports.graph_digest(kept.orderBy(F.desc("id")), lines).first()
    assert a == b != imports.graph_digest(kept.where("id = 'a'"), lines).first()
    assert [json.loads(r.line)["type"] for r in imports.graph_document(kept, lines).collect()] == ["node", "node", "edge"]
    tree = spark.createDataFrame([("r", 0, ["r"]), ("b", 1, ["r", "b"]), ("a", 1, ["r", "a"]), ("c", 2, ["r", "a", "c"])], "id string, level int, path array<string>")
    assert [r.line for r in imports.outline(tree, spark.createDataFrame([("a", "Alpha")], "id string, label string")).collect()] == ["- r", "  - Alpha", "    - c", "  - b"]


def test_integration_is_idempotent_and_retires(spark):
    term = spark.createDataFrame([("c1", 0, "k"), ("c2", 1, None)], "code string, status int, kind string")
    label = spark.createDataFrame([("c1", 0, "en", "One"), ("c1", 0, "en", "Uno"), ("c1", 1, "en", "One")], "code string, kind int, lang string, text string")
    none = lambda s: spark.createDataFrame([], s)
    lean = Lean(term, label, none("s string, pred string, o string"), none("code string, pred string, lang string, value_int bigint, value_real double, value_text string"), spark.createDataFrame([("c1", "sees", "closeMatch", "http://w/Q1"), ("c2", "sees", "closeMatch", "x/c2")], "code string, pred string, map string, target string"))
    preds = none("pred string, role string, map string, datatype string")
    one, two = (integrate.integrate(lean, "x", preds, integrate.Resolver((("http://w/", "wd"),))) for _ in range(2))
    for name in one:
        assert sorted(map(tuple, one[name].collect()), key=str) == sorted(map(tuple, two[name].collect()), key=str), name
    assert sorted((r.id, r.lang, r.kind, r.text) for r in one["label"].collect()) == [("x/c1", "en", "alt", "Uno"), ("x/c1", "en", "pref", "One")]
    assert [(r.from_id, r.to_id, r.relation) for r in one["mapping"].collect()] == [("x/c1", "wd/Q1", "closeMatch")] and one["counts"].first().links_unresolved == 1
    old = spark.createDataFrame([("x/c1", "active"), ("x/gone", "active")], "id string, status string")
    after = {r.id: r.status for r in integrate.snapshot(old, one["concept"].select("id", "status")).collect()}
    assert after == {"x/c1": "active", "x/c2": "deprecated", "x/gone": "deprecated"}
    assert {(r.id, r.label) for r in integrate.attached(term, label.where("text = 'One'"), "x").collect()} == {("x/c1", "One"), ("x/c2", "c2")}
    assert integrity.not_deleted(old, old.limit(1), "id", "kept").count() == 1


def test_lean_search_and_record(spark):
    labels = spark.createDataFrame([("p", "1", "en", 0, "red ring"), ("p", "1", "de", 1, "red"), ("p", "2", "en", 0, "blue"), ("q", "9", "en", 0, "a red red ring"), ("q", "8", "en", 0, "other"), ("q", "7", "en", 0, "more")], "scheme string, term string, lang string, kind int, text string")
    assert [(r.term, r.text) for r in records.lean_search(labels, "Red").collect()] == [("q/9", "a red red ring"), ("p/1", "red")] or {r.term for r in records.lean_search(labels, "Red").collect()} == {"q/9", "p/1"}
    assert [r.term for r in records.lean_search(labels, "ring red").collect() if r.term == "q/9"] == ["q/9"]
    term = spark.createDataFrame([("1", 0)], "code string, status int")
    rel = spark.createDataFrame([("2", "broader", "1"), ("1", "broader", "0")], "s string, pred string, o string")
    empty = lambda s: spark.createDataFrame([], s)
    row = records.lean_record("p", "1", term, labels.where("scheme = 'p'").withColumnRenamed("term", "code"), rel, empty("code string, pred string, value_int bigint, value_real double, value_text string"), empty("code string, pred string, map string, target string")).first()
    assert row["in"] == [("broader", "2")] and row["out"] == [("broader", "0")] and len(row.labels) == 2 and row.attrs == []
    assert records.lean_record("p", "none", term, labels.withColumnRenamed("term", "code"), rel, empty("code string, pred string, value_int bigint, value_real double, value_text string"), empty("code string, pred string, map string, target string")).count() == 0


def test_introductions_and_candidates(spark):
    page = {"query": {"redirects": [{"from": "Heaven god", "to": "Sky god"}], "pages": [{"title": "Sky god", "extract": "First.\nSecond."}, {"title": "None", "missing": True}]}}
    docs, lines, aliases = web.introductions(spark.createDataFrame([("w-20240101", "p1", json.dumps(page))], "corpus string, name string, content string"))
    assert [tuple(r) for r in docs.collect()] == [("doc/w-20240101/Sky god", "w-20240101", "Sky god", "First.\nSecond.")]
    assert [(r.ord, r.text) for r in lines.collect()] == [(0, "First."), (1, "Second.")] and [tuple(r) for r in aliases.collect()] == [("Heaven god", "Sky god")]
    cases = [("Wikimedia disambiguation page", True), ("2004 film by X", True), ("family name", True), ("study of the synthesis of film", False), ("branch of physics", False), (None, False), ("1990s British novel", True), ("scientific article", True)]
    got = spark.createDataFrame(cases, "d string, want boolean").select("want", web.junk(F.col("d")).alias("j")).collect()
    assert all(r.want == r.j for r in got)
    concepts = spark.createDataFrame([("c/1", "Sky-god"), ("c/1", "Tengri")], "id string, text string")
    candidates = spark.createDataFrame([("Q2", "sky god", "deity", 1, 9), ("Q1", "Sky God!", "film by X", 1, 50), ("Q3", "tengri", "deity", 1, 30), ("Q4", "else", "deity", 1, 99)], "qid string, text string, description string, rank int, sitelinks int")
    assert [(r.place, r.qid, r.junk) for r in web.reconciled(concepts, candidates).orderBy("place").collect()] == [(1, "Q3", False), (2, "Q2", False), (3, "Q1", True)]


def test_registry(spark):
    sources = spark.createDataFrame([("geo", "Geo", "geo", "geonames", "CC"), ("Bad id", "", "x y", "none", "")], "id string, title string, scheme string, converter string, license string")
    files = spark.createDataFrame([("geo", "a.zip", "https://x/a.zip", None), ("geo", "../b", "ftp://x", "12"), ("lost", "c", "https://x", None)], "source string, name string, url string, sha512 string")
    got = sorted((r.key, r.problem) for r in web.registry_problems(sources, files, ["geonames"]).collect())
    assert [p for k, p in got if k == "Bad id"] == ["bad id", "bad scheme", "no license", "no title", "unknown converter"]
    assert [x for x in got if x[0] != "Bad id"] == [("geo/../b", "bad address"), ("geo/../b", "bad hash"), ("geo/../b", "name leaves its folder"), ("lost/c", "no such source")]
    chosen = web.expanded(spark.createDataFrame([("start",), ("iso",)], "name string"), spark.createDataFrame([("start", "geo"), ("start", "cldr")], "preset string, id string"))
    assert sorted(r.id for r in chosen.collect()) == ["cldr", "geo", "iso"]


def test_small_functions(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    assert one(text.fnv1a(F.lit("")), text.fnv1a(F.lit("a")), text.fnv1a(F.lit("foobar"))) == (2166136261, 0xE40C292C, 0xBF9CF968)
    assert one(text.megabytes(F.lit(None).cast("long")), text.megabytes(F.lit(5)), text.megabytes(F.lit(2_500_000))) == ("?", "5 B", "2.5 MB")
    assert one(text.slug(text.ascii_form(F.lit("Éa Ünï—x"))), text.spelling(F.lit("Ⅳ  Straße—A")), text.flat_html(F.lit("<b>A&amp;B</b>\n c"))) == ("ea-unix", "iv strasse a", "a&b c")
    assert (text.phrase('a"b'), text.gram_phrase("Ab"), text.gram_phrase("ABC"), text.cjk_runs("物理学 a 天")) == ('"a""b"', None, '"abc"', [["物理", "理学"]])
    kinds = spark.createDataFrame([("Ada",), (None,), ("AI model",), ("rule 3",)], "r string").select(records.reviewer_kind(F.col("r"))).collect()
    assert [r[0] for r in kinds] == ["human", "none", "model", "rule"]
    with pytest.raises(ValueError):
        imports.read_only(spark, "DROP TABLE x")
