import json

from pyspark.sql import functions as F

from lorekeep.functions import worldtime
from lorekeep.operators import claims
from lorekeep.sources import wikidata

GREGORIAN = "http://www.wikidata.org/entity/Q1985727"


def time(text, precision, calendar=GREGORIAN):
    return {"type": "time", "value": {"time": text, "precision": precision, "calendarmodel": calendar}}


def item(q):
    return {"type": "wikibase-entityid", "value": {"entity-type": "item", "id": q}}


def snak(p, value, datatype="wikibase-item", kind="value"):
    return {"snaktype": kind, "property": p, "datatype": datatype} | ({"datavalue": value} if value else {})


ENTITY = {
    "id": "Q1", "lastrevid": 7, "labels": {"en": {"language": "en", "value": "one"}, "tr": {"language": "tr", "value": "bir"}},
    "aliases": {"en": [{"language": "en", "value": "uno"}]}, "descriptions": {"en": {"language": "en", "value": "number"}},
    "sitelinks": {"enwiki": {"site": "enwiki", "title": "One"}, "cebwiki": {"site": "cebwiki", "title": "x"}, "commonswiki": {"site": "commonswiki", "title": "x"}, "enwikiquote": {"site": "enwikiquote", "title": "x"}},
    "claims": {
        "P279": [
            {"id": "Q1$a", "rank": "normal", "mainsnak": snak("P279", item("Q2")), "qualifiers": {"P580": [snak("P580", time("+1900-00-00T00:00:00Z", 9), "time")], "P1": [snak("P1", item("Q9"))]}, "qualifiers-order": ["P1", "P580"]},
            {"id": "Q1$b", "rank": "preferred", "mainsnak": snak("P279", item("Q2")), "qualifiers": {"P585": [snak("P585", time("+1917-10-25T00:00:00Z", 11, wikidata.JULIAN), "time")]},
             "references": [{"hash": "h1", "snaks": {"P248": [snak("P248", item("Q3"))], "P813": [snak("P813", time("+2020-01-02T00:00:00Z", 11), "time")]}, "snaks-order": ["P813", "P248"]}]},
        ],
        "P1082": [{"id": "Q1$c", "rank": "normal", "mainsnak": snak("P1082", {"type": "quantity", "value": {"unit": "1", "amount": "+8"}}, "quantity")}],
        "P244": [{"id": "Q1$d", "rank": "deprecated", "mainsnak": snak("P244", {"type": "string", "value": "sh 1"}, "external-id"), "qualifiers": {"P580": [snak("P580", time("+1900-00-00T00:00:00Z", 9), "time")] * 2, "P582": [snak("P582", None, "time", "somevalue")]}}],
        "P5": [{"id": "Q1$e", "rank": "normal", "mainsnak": snak("P5", None, "string", "novalue")}],
    },
}


def payloads(spark, *contents):
    return spark.createDataFrame([(f"entities/{i}", f"2024-01-0{i + 1}", json.dumps(c)) for i, c in enumerate(contents)], "name string, retrieved_at string, content string")


def test_statements(spark):
    frames = wikidata.statements(payloads(spark, {"entities": {"Q1": ENTITY, "Q999": {"id": "Q999", "missing": ""}}}))
    rows = {r.statement_id: r for r in frames["claims"].collect()}
    assert len(rows) == 5
    a = rows["Q1$a"]
    assert (a.subject, a.predicate, a.snak_type, a.object, a.value, a.rank, a.source_revision, a.source_pointer) == ("wd/Q1", "wd/P279", "value", "wd/Q2", None, "normal", 7, "/entities/Q1/claims/P279/0")
    assert (a.valid_from, a.valid_to, a.time_precision, a.valid_from_day, a.valid_to_day) == ("1900", None, 9, 2415021, None)
    b = rows["Q1$b"]
    assert (b.valid_from, b.valid_to, b.time_precision, b.valid_from_day, b.valid_to_day) == ("1917-11-07", "1917-11-07", 11, 2421540, 2421540)
    assert rows["Q1$c"].value == '{"amount":"+8","unit":"1"}' and rows["Q1$d"].value == "sh 1"
    assert (rows["Q1$e"].snak_type, rows["Q1$e"].value, rows["Q1$e"].datatype) == ("novalue", None, "string")
    assert rows["Q1$d"].valid_from is None and rows["Q1$d"].valid_to is None  # two starts, an unknown end
    quals = sorted((r.statement_id, r.ord, r.property, r.object) for r in frames["qualifiers"].collect())
    assert quals[:2] == [("Q1$a", 0, "wd/P1", "wd/Q9"), ("Q1$a", 1, "wd/P580", None)] and len(quals) == 6
    refs = sorted((r.ref_hash, r.ord, r.property, r.object) for r in frames["references"].collect())
    assert refs == [("h1", 0, "wd/P813", None), ("h1", 1, "wd/P248", "wd/Q3")]


def test_names_sites_and_references(spark):
    p = payloads(spark, {"entities": {"Q1": ENTITY}})
    assert sorted(map(tuple, wikidata.names(p).collect())) == [("Q1", "en", "alt", "uno"), ("Q1", "en", "desc", "number"), ("Q1", "en", "pref", "one"), ("Q1", "tr", "pref", "bir")]
    assert tuple(wikidata.sitelink_counts(p).first()) == ("Q1", 1, 2, "One")
    assert {r.id for r in wikidata.referenced(p).collect()} == {"P279", "P1082", "P244", "P5", "P580", "P1", "P585", "P582", "P248", "P813", "Q2", "Q3", "Q9"}
    assert tuple(wikidata.display_names(p).first()) == ("Q1", "one")
    matches = spark.createDataFrame([("c/1", "Q1")], "concept_id string, id string")
    own = spark.createDataFrame([("c/1", "en", "uno")], "concept_id string, lang string, text string")
    assert sorted(map(tuple, wikidata.donated(wikidata.names(p), matches, own).collect())) == [("c/1", "en", "alt", "one"), ("c/1", "en", "desc", "number"), ("c/1", "tr", "pref", "bir")]


def test_summaries_and_supersession(spark):
    cell = lambda v: {"value": v}
    rows = [{"item": cell("http://x/entity/Q1"), "pid": cell("P31"), "value": cell(f"http://x/entity/{v}"), "valueLabel": cell("five"), "rank": cell("http://wikiba.se/ontology#PreferredRank")} for v in ("Q5", "L7")]
    p = spark.createDataFrame([("sparql/claims-1", "2024-01-03", json.dumps({"results": {"bindings": rows}}))], "name string, retrieved_at string, content string")
    got = wikidata.summaries(p).collect()
    assert [(r.subject, r.predicate, r.object, r.rank, r.object_label) for r in got] == [("wd/Q1", "wd/P31", "wd/Q5", "preferred", "five")]
    reads = wikidata.covered(payloads(spark, *[{"entities": {"Q1": ENTITY}}] * 5))
    out = claims.supersede(wikidata.summaries(p).select(F.lit(1).alias("claim_id"), "subject", "recorded_at"), reads)
    assert out.first().superseded_at == "2024-01-03"  # the first reading that is not before; older ones never supersede


def test_times(spark):
    j, g = True, False
    cases = [
        ("-0001-00-00T00:00:00Z", 9, g, "0000", 9), ("-0500-00-00T00:00:00Z", 9, j, "-0499", 9), ("+1582-10-05T00:00:00Z", 11, j, "1582-10-15", 11),
        ("+2000-01-01T00:00:00Z", 11, g, "2000-01-01", 11), ("+1905-06-00T00:00:00Z", 10, g, "1905-06", 10), ("+1500-03-00T00:00:00Z", 10, j, "1500", 9),
        ("+1900-00-00T00:00:00Z", 7, g, "1900", 7), ("+2001-02-03T04:05:06Z", 14, g, "2001-02-03", 11), ("garbage", 9, g, None, None),
        ("+1879-03-00T00:00:00Z", 11, g, "1879-03", 10), ("+1879-00-00T00:00:00Z", 11, g, "1879", 9), ("-0044-03-15T00:00:00Z", 11, j, "-0043-03-13", 11),
        ("+12345-00-00T00:00:00Z", 9, g, "12345", 9), ("-13798000000-00-00T00:00:00Z", 3, g, "-13797999999", 3),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, time string, precision int, julian boolean, want string, want_precision int")
    for r in worldtime.read_times(df, "time", "precision", "julian").collect():
        assert (r.shown, r.shown_precision) == (r.want, r.want_precision), r


def test_days(spark):
    n = lambda *v: spark.range(1).select(worldtime.jdn_gregorian(*map(F.lit, v))).first()[0]
    cases = [
        ("+1900-00-00T00:00:00Z", 7, n(1801, 1, 1), n(1900, 12, 31)), ("+2000-00-00T00:00:00Z", 6, n(1001, 1, 1), n(2000, 12, 31)), ("-0500-00-00T00:00:00Z", 7, n(-499, 1, 1), n(-400, 12, 31)),
        ("-0001-00-00T00:00:00Z", 7, n(-99, 1, 1), n(0, 12, 31)), ("+1960-00-00T00:00:00Z", 8, n(1960, 1, 1), n(1969, 12, 31)), ("+2024-02-00T00:00:00Z", 10, n(2024, 2, 1), n(2024, 2, 29)),
        ("-1000-00-00T00:00:00Z", 8, n(-1008, 1, 1), n(-999, 12, 31)), ("-0500-00-00T00:00:00Z", 8, n(-508, 1, 1), n(-499, 12, 31)), ("-0005-00-00T00:00:00Z", 8, n(-8, 1, 1), n(0, 12, 31)),
        ("+0005-00-00T00:00:00Z", 8, n(1, 1, 1), n(9, 12, 31)), ("-13798000000-00-00T00:00:00Z", 3, None, None), ("-4700-00-00T00:00:00Z", 6, None, None), ("+1879-03-00T00:00:00Z", 11, n(1879, 3, 1), n(1879, 3, 31)),
        ("+1879-12-00T00:00:00Z", 11, n(1879, 12, 1), n(1879, 12, 31)), ("+1879-00-00T00:00:00Z", 10, n(1879, 1, 1), n(1879, 12, 31)),
    ]
    df = spark.createDataFrame([(*c, False) for c in cases], "time string, precision int, a long, b long, julian boolean")
    for r in worldtime.read_times(df, "time", "precision", "julian").collect():
        assert (r.first_day, r.last_day) == (r.a, r.b), r
    assert n(-4713, 11, 24) == 0
    old = spark.createDataFrame([("+1500-03-00T00:00:00Z", 10, True)], "time string, precision int, julian boolean")
    r = worldtime.read_times(old, "time", "precision", "julian").first()
    j = lambda *v: spark.range(1).select(worldtime.jdn_julian(*map(F.lit, v))).first()[0]
    assert (r.first_day, r.last_day) == (j(1500, 3, 1), j(1500, 3, 31))
