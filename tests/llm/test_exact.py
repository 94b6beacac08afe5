import hashlib
import re
from collections import defaultdict

from conftest import values_stay

from lorekeep.llm import exact, queries


def brute(rows):
    """rows: (doc_id, text) -> {(doc_id, sha): (keep, size)}"""
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    by = defaultdict(list)
    for i, t in rows:
        by[norm(t)].append(i)
    out = {}
    for t, ids in by.items():
        least = min((i for i in ids if i is not None), default=None)
        for i in ids:
            out[(i, hashlib.sha256(t.encode()).hexdigest())] = (least, len(ids), i == least)
    return out


def check(df, rows):
    got = [((r.doc_id, r.text_sha256), (r.keep_id, r.group_size, r.kept)) for r in df.collect()]
    assert len(dict(got)) == len(got)
    assert dict(got) == brute(rows)


def test_whole_table(spark, sf, texts):
    check(queries.op2_exact_dedup(spark, sf), [(i, r.text) for i, r in texts.items()])


def test_small_blocks_and_odd_rows(odd, odd_rows, empty):
    rows = [(r[0], r[1]) for r in odd_rows]
    for size in (7, 64, 16384):
        check(exact.groups(odd, size), rows)
    assert exact.groups(empty).count() == 0


def test_dedup_keeps_one(odd, odd_rows):
    kept = exact.dedup(odd)
    assert kept.columns == odd.columns
    brute_kept = {k for k, v in brute([(r[0], r[1]) for r in odd_rows]).items() if v[2]}
    assert len({(r.doc_id) for r in kept.collect()}) == len(brute_kept)


def test_dedup_keeps_one_row_of_each_text(spark, clashing, odd_rows, empty):
    """Repeated rows too: nine of the odd texts differ, and each stays once, with its columns as they were."""
    out = exact.dedup(clashing)
    rows = out.collect()
    assert out.columns == clashing.columns and all(map(values_stay, rows))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert sorted(norm(r.text) for r in rows) == sorted({norm(r[1]) for r in odd_rows})
    want = {k[0] for k, v in brute([(r[0], r[1]) for r in odd_rows]).items() if v[2]}
    assert {r.doc_id for r in rows} == want
    assert exact.dedup(empty).count() == 0 and exact.dedup(empty).columns == empty.columns


def test_rows_that_differ_elsewhere(spark):
    """Of rows with one id and text, the one whose columns come first stays, whatever the partitions."""
    rows = [(1, "a  b", "z"), (1, "a b", "y"), (1, "a b", "x"), (2, "a b", "a"), (1, "c", "q"), (None, "d", "t"), (None, "d", "s")]
    for n in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(n)
        got = {(r.doc_id, r.text, r.lang) for r in exact.dedup(df).collect()}
        assert got == {(1, "a  b", "z"), (1, "c", "q"), (None, "d", "s")}


def test_very_long_text(spark):
    long = "word " * 300_000
    df = spark.createDataFrame([(3, long), (1, long + "x"), (2, long.replace(" ", "\n"))], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact.groups(df).collect()} == {(3, 2, 2), (2, 2, 2), (1, 1, 1)}
