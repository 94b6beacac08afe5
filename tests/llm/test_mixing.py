import re
from collections import defaultdict

import pytest

from lorekeep.llm import mixing, queries


def brute_targets(sizes):
    """{source: size} -> {source: target}, the excess shared out round after round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = budget - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        out = {s: 2.0 * sizes[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if s not in full and out[s] > 2 * sizes[s]}
        if not over:
            return out
        full |= over


def check(rows, docs):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d[1]] += len(re.findall(r"[^\x20\x09-\x0D]+", d[2] or ""))
    want, taken = brute_targets(sizes), defaultdict(int)
    source = {d[0]: d[1] for d in docs}
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, abs=0.5)


def test_whole_table(spark, sf, texts):
    rows = queries.op1_source_mixing(spark, sf).collect()
    check(rows, [(i, r.source, r.text) for i, r in texts.items()])
    assert sorted(rows) == sorted(queries.op1_source_mixing(spark, sf).collect())


def test_odd_rows(odd, odd_rows, empty):
    check(mixing.takes(odd).collect(), [(r[0], r[3], r[1]) for r in odd_rows])
    assert mixing.takes(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.takes(odd.where("doc_id < 3")).agg({"taken": "sum"}).first()[0] == 0


def test_tree_uses_each_block_once(spark, sf):
    docs = mixing.documents(spark, sf) if hasattr(mixing, "documents") else spark.read.parquet(f"{sf}/documents.parquet")
    sources = mixing.targets(mixing.sized(docs, 20))
    leaves = mixing.shards(sources, 3, 20).collect()
    quota = {r["rank"]: -(-r.quota // r.block_words) for r in sources.collect()}
    assert sorted((r["rank"], r.block) for r in leaves) == sorted((k, b) for k, n in quota.items() for b in range(n))
    per = defaultdict(int)
    for r in leaves:
        per[r.shard] += 1
    assert len(per) == 8 and max(per.values()) - min(per.values()) <= 1


def test_shards_and_texts(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    parts = mixing.shuffled(mixing.draw(docs, levels=3)).collect()
    by = defaultdict(list)
    for r in parts:
        by[r.shard].append(r.position)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    words = defaultdict(int)
    for r in mixing.mixed(docs).collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        words[r.doc_id] += n
        assert r.text == texts[r.doc_id].text or texts[r.doc_id].text.split()[:n] == r.text.split()
    assert {r.doc_id: r.taken for r in mixing.takes(docs).collect() if r.taken} == dict(words)


def places_of(rows):
    """(doc_id, pass) -> (shard, position)"""
    return {(r.doc_id, int(p.split(":")[0])): tuple(map(int, p.split(":")[1:])) for r in rows for p in r.places.split(",") if p}


def test_result_comes_through_the_tree(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.takes(docs, levels=3).collect()
    places = places_of(rows)
    assert {k for k, _ in places} == {r.doc_id for r in rows if r.taken}
    assert len({s for s, _ in places.values()}) == 8
    deal = mixing._deal
    monkeypatch.setattr(mixing, "_deal", lambda counts, node, seed: deal(counts, node, seed + 99))
    other = places_of(mixing.takes(docs, levels=3).collect())
    assert other.keys() == places.keys() and sum(other[k][0] != places[k][0] for k in places) > len(places) / 3
    shards = mixing.shards
    monkeypatch.setattr(mixing, "shards", lambda *a: shards(*a).where("shard > 3"))
    half = mixing.takes(docs, levels=3).collect()
    assert {s for s, _ in places_of(half).values()} == {4, 5, 6, 7}
    assert sum(r.taken for r in half) < 0.8 * sum(r.taken for r in rows)


def test_blocks_of_a_shard_are_permuted(spark, sf):
    parts = mixing.draw(spark.read.parquet(f"{sf}/documents.parquet"), levels=2).where("taken > 0").collect()
    by = defaultdict(set)
    for r in parts:
        by[(r.shard, r["rank"])].add((r["pass"], r.block))
    assert len(set().union(*by.values())) <= sum(map(len, by.values()))
    seen = [b for v in by.values() for b in v]
    per_rank = defaultdict(list)
    for (_, k), v in by.items():
        per_rank[k] += list(v)
    assert all(len(v) == len(set(v)) for v in per_rank.values()) and seen
    runs = [sum(b - a == 1 for (_, a), (_, b) in zip(sorted(v), sorted(v)[1:])) / len(v) for v in by.values() if len(v) > 5]
    assert runs and max(runs) < 0.9


def test_mixed_is_in_shuffled_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    places = places_of(mixing.takes(docs, levels=3).collect())
    once = {i: places[(i, 0)] for i, p in places if (i, 1) not in places}
    by = defaultdict(list)
    for r in mixing.mixed(docs, levels=3).collect():
        if r.doc_id in once:
            by[once[r.doc_id][0]].append(once[r.doc_id][1])
    assert by and all(v == sorted(v) for v in by.values())
    assert any(len(v) > 3 for v in by.values())


def test_clashing_names(spark, odd, odd_rows):
    names = ["_row", "_size", "_taken", "_shard", "_order0", "Pass", "block", "first", "rank", "words"]
    docs = odd.selectExpr("*", *(f"concat('{n}', coalesce(cast(doc_id as string), 'null')) AS {n}" for n in names))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    values = {r[0]: (r[5], r[6], r[7], r[8]) for r in odd_rows if r[0] is not None}
    rows = out.collect()
    assert rows and all(r[n] == f"{n}{'null' if r.doc_id is None else r.doc_id}" for r in rows for n in names)
    assert all((r.value, r.name, r.kept, r.size) == values[r.doc_id] for r in rows if r.doc_id is not None)


def test_very_long_text_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    monkeypatch.setattr(mixing, "LEAST_BUCKETS", 2)
    docs = [(i, "a", "w " * (200_000 if i == 3 else 40)) for i in range(30)] + [(100 + i, None, "x " * 50) for i in range(10)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    check(mixing.takes(frame).collect(), docs)
