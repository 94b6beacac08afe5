import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
from conftest import values_stay
from pyspark.sql import functions as F
from test_mixing import brute_targets
from test_simhash import brute_components, brute_mark

from lorekeep.llm import quality


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_stages_against_brute_force(spark, sf, texts, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, frames = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        frames[name] = docs.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns

    kept = {r.doc_id: r for r in frames["quality rules"]}
    judged = {r.doc_id: r for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert kept.keys() == {i for i, r in judged.items() if r.kept}
    assert all(r.text == judged[i].clean_text and r.n_chars == len(r.text) for i, r in kept.items())

    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i].text), i)
    assert sorted(r.doc_id for r in frames["exact dedup"]) == sorted(first.values())

    marks = [(r.doc_id, brute_mark(r.text)) for r in sorted(frames["exact dedup"], key=lambda r: r.doc_id)]
    assert sorted(r.doc_id for r in frames["simhash near-dedup"]) == sorted(set(brute_components(marks)))

    sizes, taken = defaultdict(int), defaultdict(int)
    for r in frames["simhash near-dedup"]:
        sizes[r.source] += len(words(r.text))
    for r in frames["source mixing"]:
        taken[r.source] += len(words(r.text))
    assert all(math.isclose(taken[s], t, abs_tol=0.5) for s, t in brute_targets(sizes).items())
    assert max(Counter(r.doc_id for r in frames["source mixing"]).values()) <= 2

    packed = frames["best-fit packing"]
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        assert sum(n for _, n in p) <= 2048
        assert [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))]
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in frames["source mixing"])


def test_run_gives_rows(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_stages_on_odd_and_empty_tables(spark, sf, clashing, empty, tmp_path):
    """Nulls in any column, repeated rows, ties, clashing names: each stage keeps the columns and their values."""
    good = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) + "." for i in range(12))
    more = clashing.where("doc_id = 3").withColumn("text", F.lit(good))
    docs = clashing.unionByName(more).unionByName(more).unionByName(more.withColumn("doc_id", F.lit(None).cast("long")))
    for start, rows_wanted in ((docs, True), (empty, False)):
        now = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{rows_wanted}-{i}"
            stage(spark, now, sf).write.parquet(path)
            now = spark.read.parquet(path)
            rows = now.collect()
            assert bool(rows) == rows_wanted
            if i < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == start.columns
                assert not rows_wanted or all(map(values_stay, rows))
        assert "sequence_id" in now.columns
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).collect()
