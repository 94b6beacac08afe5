import json

from lorekeep.sources import vocabularies as v


def put(path, text):
    path.write_text(text)
    return str(path)


def rels(x):
    return sorted((r.s, r.pred, r.o) for r in x.rel.collect())


def labels(x):
    return sorted((r.code, r.kind, r.lang, r.text) for r in x.label.collect())


def test_geonames(spark, tmp_path):
    row = lambda n, **k: "\t".join(str(k.get(f"c{i}", "")) for i in range(n))
    countries = put(tmp_path / "c", "#iso\n" + row(18, c0="XA", c4="Landia", c16="10") + "\n")
    admin = put(tmp_path / "a", row(4, c0="XA.01", c1="North", c3="11") + "\n")
    places = put(tmp_path / "p", row(19, c0="12", c1="Town", c4="1.5", c8="XA", c10="01", c14="7") + "\n" + row(19, c0="13", c1="Hut", c8="XA", c10="99") + "\n")
    names = put(tmp_path / "n", row(10, c1="12", c2="de", c3="Stadt", c4="1") + "\n" + row(10, c1="12", c2="link", c3="http://t") + "\n")
    got = v.geonames(spark, countries, admin, places, names)
    assert rels(got) == [("11", "broader", "10"), ("12", "broader", "11"), ("13", "broader", "10")]
    assert ("12", 0, "de", "Stadt") in labels(got) and [r.target for r in got.link.collect()] == ["http://t"]


def test_languages_and_taxa(spark, tmp_path):
    codes = put(tmp_path / "i", "Id\tPart2b\naaa\t\t\t\tI\tL\tAaa\t\nmmm\t\t\t\tM\tL\tMmm\t\n")
    macros = put(tmp_path / "m", "M_Id\tI_Id\tI_Status\nmmm\taaa\tA\n")
    retired = put(tmp_path / "r", "Id\tRef\nzzz\tZzz\tC\taaa\t\t2000\n")
    got = v.iso_639_3(spark, codes, macros=macros, retired=retired)
    assert rels(got) == [("aaa", "broader", "mmm")] and {(r.code, r.status) for r in got.term.collect()} == {("aaa", 0), ("mmm", 0), ("zzz", 1)}
    nodes = put(tmp_path / "n", "1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tkingdom\t|\n")
    names = put(tmp_path / "t", "1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tBacteria\t|\tx\t|\tscientific name\t|\n2\t|\tbugs\t|\t\t|\tblast name\t|\n")
    got = v.ncbi_taxonomy(spark, nodes, names)
    assert rels(got) == [("2", "broader", "1")] and ("2", 1, "en", "bugs") in labels(got)


def test_json_sources(spark, tmp_path):
    cldr = put(tmp_path / "c.json", json.dumps({"main": {"de-AT": {"localeDisplayNames": {"languages": {"en": "Englisch", "en-alt-short": "Eng"}}}}}))
    assert labels(v.cldr_names(spark, cldr)) == [("en", 0, "de-at", "Englisch"), ("en", 1, "de-at", "Eng")]
    period = {"id": "p1", "label": "Iron Age", "localizedLabels": {"en": ["Iron Age", "IA"]}, "start": {"in": {"year": "-0800"}}, "stop": {"in": {"latestYear": "0100"}}}
    got = v.periodo(spark, put(tmp_path / "p.json", json.dumps({"authorities": {"a1": {"id": "a1", "periods": {"p1": period}}}})))
    assert sorted((r.pred, r.value_int) for r in got.attr.collect()) == [("first_year", -800), ("last_year", 100)] and rels(got) == [("p1", "related", "a1")]
    claim = lambda q: {"rank": "normal", "mainsnak": {"snaktype": "value", "datatype": "wikibase-item", "datavalue": {"value": {"id": q}}}}
    ext = {"rank": "normal", "mainsnak": {"snaktype": "value", "datatype": "external-id", "datavalue": {"value": "GO:1"}}}
    items = [{"id": "Q1", "labels": {"en": {"language": "en", "value": "one"}}, "claims": {"P31": [claim("Q5")], "P279": [claim("Q2")], "P686": [ext]}}, {"id": "Q2", "claims": {"P31": [claim("Q5")]}}, {"id": "Q3", "claims": {}}]
    got = v.wikidata_dump(spark, put(tmp_path / "w", "[\n" + ",\n".join(map(json.dumps, items)) + "\n]\n"), classes=["Q5"])
    assert {r.code for r in got.term.collect()} == {"Q1", "Q2"} and rels(got) == [("Q1", "broader", "Q2")]
    assert ("P686", "GO:1") in {(r.pred, r.target) for r in got.link.collect()}
    topics = [{"id": "https://openalex.org/T1", "display_name": "Topic", "keywords": ["k"], "subfield": {"id": "https://openalex.org/subfields/2"}}, {"id": "https://openalex.org/subfields/2", "display_name": "Sub"}]
    got = v.openalex(spark, put(tmp_path / "o", "\n".join(map(json.dumps, topics))))
    assert rels(got) == [("T1", "broader", "subfields/2")]
    orgs = [{"id": "https://ror.org/1", "status": "active", "names": [{"value": "Uni", "lang": "en", "types": ["ror_display", "label"]}, {"value": "U", "types": ["acronym"]}], "relationships": [{"type": "parent", "id": "https://ror.org/2"}]}, {"id": "https://ror.org/2", "status": "withdrawn", "names": []}]
    got = v.ror(spark, put(tmp_path / "r.json", json.dumps(orgs)))
    assert rels(got) == [("1", "broader", "2")] and labels(got) == [("1", 0, "en", "Uni"), ("1", 1, "", "U")]


def test_xml_sources(spark, tmp_path):
    record = "<DescriptorRecord><DescriptorUI>{0}</DescriptorUI><DescriptorName><String>{1}</String></DescriptorName><TreeNumberList><TreeNumber>{2}</TreeNumber></TreeNumberList><ConceptList><Concept><ScopeNote> n </ScopeNote><TermList><Term><String>{1}</String></Term><Term><String>{1}s</String></Term></TermList></Concept></ConceptList></DescriptorRecord>"
    xml = "<DescriptorRecordSet>" + record.format("D1", "Body", "A01") + record.format("D2", "Head", "A01.1") + "</DescriptorRecordSet>"
    got = v.mesh(spark, put(tmp_path / "m.xml", xml))
    assert rels(got) == [("D2", "broader", "D1")] and ("D1", 1, "en", "Bodys") in labels(got)
    lmf = (
        '<LexicalResource><Lexicon><LexicalEntry id="w1"><Lemma writtenForm="dog" partOfSpeech="n"/><Sense id="s1" synset="a"/></LexicalEntry>'
        '<Synset id="a" ili="i1"><Definition>pet</Definition><SynsetRelation relType="hypernym" target="b"/></Synset><Synset id="b" ili=""><SynsetRelation relType="hyponym" target="a"/></Synset></Lexicon></LexicalResource>'
    )
    got = v.wordnet(spark, put(tmp_path / "l.xml", lmf))
    assert rels(got) == [("i1", "broader", "b")] and labels(got) == [("i1", 1, "en", "dog")]


def test_subtags(spark, tmp_path):
    jar = "File-Date: 2020-01-01\n%%\nType: language\nSubtag: aa\nDescription: Afar\nDescription: a\n  long one\n%%\nType: language\nSubtag: xx\nDescription: Old\nDeprecated: 2001-01-01\nPreferred-Value: aa\n"
    got = v.iana_subtags(spark, put(tmp_path / "s", jar))
    assert {(r.code, r.status) for r in got.term.collect()} == {("language-aa", 0), ("language-xx", 1)}
    assert ("language-aa", 1, "en", "a long one") in labels(got)
