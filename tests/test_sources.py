import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lorekeep.sources import lean, readers
from lorekeep.streaming import ingest

SKOS = "http://www.w3.org/2004/02/skos/core#"


def test_ntriples_to_lean(spark):
    x = "http://x.org/"
    lines = [
        f"<{x}c1> <{readers.TYPE}> <{SKOS}Concept> .", f"<{x}c2> <{readers.TYPE}> <{SKOS}Concept> <{x}g> .", "# a comment", "",
        f'<{x}c1> <{SKOS}prefLabel> "One \\u00e9 \\"q\\""@EN .', f"<{x}c2> <{SKOS}broader> <{x}c1> .", f"<{x}c2> <{SKOS}broader> <http://y.org/z> .",
        f"_:b <{SKOS}note> _:d .", f'<{x}c2> <{SKOS}notation> "7"^^<http://www.w3.org/2001/XMLSchema#integer> .', f"<{x}c2> <{SKOS}exactMatch> <http://y.org/q> .",
    ]
    triples = readers.ntriples(spark.createDataFrame([(v,) for v in lines], "value string"), "d1")
    got = readers.skos(triples, x)
    assert [tuple(r) for r in got.label.collect()] == [("c1", 0, "en", 'One é "q"')]
    assert [tuple(r) for r in got.rel.collect()] == [("c2", "broader", "c1")]
    assert sorted((r.pred, r.target) for r in got.link.collect()) == [("broader", "http://y.org/z"), ("exactMatch", "http://y.org/q")]
    assert triples.where("s like '\\_:d1:%'").count() == 1
    with pytest.raises(PySparkException):
        readers.ntriples(spark.createDataFrame([("no statement",)], "value string")).collect()


def test_obo(spark, tmp_path):
    (tmp_path / "x.obo").write_text(
        'format-version: 1.2\n\n[Term]\nid: GO:1\nname: root ! top\ndef: "a \\"b\\" c" [x]\nsynonym: "top" EXACT []\nsynonym: "wide" BROAD []\n\n'
        "[Term]\nid: GO:2\nname: leaf\nis_a: GO:1 ! root\nrelationship: regulates GO:1\nis_obsolete: true\n\n[Typedef]\nid: part_of\nname: part of\n"
    )
    got = readers.obo(spark, str(tmp_path / "x.obo"))
    assert sorted(tuple(r) for r in got.term.collect()) == [("GO_1", 0), ("GO_2", 1)]
    assert sorted((r.code, r.kind, r.text) for r in got.label.collect()) == [("GO_1", 0, "root"), ("GO_1", 1, "top"), ("GO_1", 3, "wide"), ("GO_2", 0, "leaf")]
    assert sorted(tuple(r) for r in got.rel.collect()) == [("GO_2", "broader", "GO_1"), ("GO_2", "regulates", "GO_1")]
    assert [r.value_text for r in got.attr.collect()] == ['a "b" c']


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "", "x; y", "7", "u"), ("b", "a", "", "seven", "u"), ("c", "zz", "z", None, "v")], "id string, up string, names string, n string, kind string")
    mapping = lean.Mapping("id", [{"column": "names", "split": ";"}], [{"column": "up"}], attrs=[{"column": "n", "pred": "n", "cast": "int"}], where={"kind": ["u"]})
    lean.write(lean.convert_table(df, mapping), str(tmp_path / "lean"))
    got = lean.read(spark, str(tmp_path / "lean"))
    assert sorted(r.text for r in got.label.collect()) == ["x", "y"]
    assert [tuple(r) for r in got.rel.collect()] == [("b", "broader", "a")]
    assert {(r.code, r.value_int, r.value_text) for r in got.attr.collect()} == {("a", 7, None), ("b", None, "seven")}
    frames = lean.integrate(got, "s")
    assert {r.id for r in frames["concept"].collect()} == {"s/a", "s/b"}
    with pytest.raises(KeyError):
        lean.convert_table(df, lean.Mapping("nothing"))


def test_seed_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("code\tlabel\n# note\na\tA\nb\n")
    assert sorted(tuple(r) for r in readers.strict_tsv(spark, str(tmp_path / "t.tsv"), ["code", "label"]).collect()) == [("a", "A"), ("b", "")]
    with pytest.raises(ValueError):
        readers.strict_tsv(spark, str(tmp_path / "t.tsv"), ["code", "other"])
    spans = spark.createDataFrame([("-43/12",), ("../1900",), ("1500",)], "w string").select(*readers.when_span(F.col("w"))).collect()
    assert [tuple(r) for r in spans] == [(-43, 12), (None, 1900), (1500, 1500)]


def test_html_tables(spark):
    html = "<table><tr><th> A  b</th><td>1<table><tr><td>in</td></tr></table></td></tr></table>"
    assert spark.createDataFrame([(html,)], "h string").select(readers.html_tables("h")).first()[0] == [[["in"]], [["A b", "1"]]]


def test_stream_keeps_the_newest(spark, tmp_path):
    schema = "k string, at long, v string"
    source = str(tmp_path / "in")
    for part in ([("a", 2, "new"), ("b", 1, "b1")], [("a", 1, "late"), ("b", 3, "b3")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.latest_readings(stream, str(tmp_path / "out"), str(tmp_path / "check"), ["k"], "at").awaitTermination()
    rows = ingest.current(spark, str(tmp_path / "out"), ["k"], "at").collect()
    assert sorted((r.k, r.v) for r in rows) == [("a", "new"), ("b", "b3")]
