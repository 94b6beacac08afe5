"""Joins with far more pairs than rows: the pairs by brute force, and plans that neither collect a side nor deal a result."""

import math
import random
import re
from collections import Counter

import numpy as np

from lorekeep.operators import evaluate, links, records, semantic


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearby(spark):
    r = random.Random(1)
    points = [(i, r.choice([-3.5, 0.0, 1.0, r.uniform(-6, 6)]), r.choice([0.0, 2.0, r.uniform(-6, 6)])) for i in range(150)]
    got = records.nearby(spark.createDataFrame(points, "id long, x double, y double"), 2.0)
    assert "Broadcast" not in plan(got)  # a grid of small rows and many cells went through the driver
    want = sorted((a, b) for a, x, y in points for b, u, v in points if a < b and (x - u) ** 2 + (y - v) ** 2 <= 4)
    assert sorted(map(tuple, got.collect())) == want


def test_documents_of_titles(spark):
    r = random.Random(2)
    concepts = [(i, r.choice(["a", "b", "c", "d", None])) for i in range(40)] + [(3, "a"), (3, "b"), (5, "zz")] * 2
    documents = [(100 + i, r.choice(["A", "B", "d", "none", None])) for i in range(40)] + [(103, "A"), (103, "B")] * 2
    aliases = [("a", "A"), ("b", "B"), ("b", "A"), ("c", "d")]
    got = records.documents_of_titles(spark.createDataFrame(concepts, "id long, page string"), spark.createDataFrame(documents, "doc_id long, title string"), spark.createDataFrame(aliases, "alias string, title string"))
    pages = {(i, to) for i, p in concepts if p for to in [t for a, t in aliases if a == p] or [p]}
    want = sorted({(d, i) for d, t in documents for i, to in pages if t == to})
    assert sorted(map(tuple, got.collect())) == want


def test_title_multimap_reads_all_orders(spark, sf):
    from lorekeep.queries import ORACLES, QUERIES

    assert "o_orderkey %" not in ORACLES["title_multimap"]
    got = QUERIES["title_multimap"](spark, sf)
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_two_hops(spark):
    r = random.Random(3)
    names = [f"a/{i}" for i in range(12)] + [f"wd/{i}" for i in range(5)]
    for n in (10, 40, 80):
        maps = [(r.choice(names), r.choice(names), "exactMatch", r.choice(["accepted", "accepted", "no"])) for _ in range(n)]
        got = links.two_hops(spark.createDataFrame(maps, "from_id string, to_id string, relation string, status string"), "wd")
        assert "Window" not in plan(got)  # all pairs were sorted by both ends
        both = {p for a, b, _, s in maps if s == "accepted" for p in ((a, b), (b, a))}
        want = {(a, b): None for a, b in both}
        for a, w in sorted(both, key=lambda p: p[1]):
            for v, b in both:
                if v == w and w.startswith("wd/") and b != a:
                    want.setdefault((a, b), w)
        rows = [tuple(x) for x in got.collect()]
        assert len(rows) == len(want) and {(a, b): w for a, w, b in rows} == want


def ranked(ids, v, other, w, k):
    s = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (w / np.linalg.norm(w, axis=1, keepdims=True)).T
    out = {}
    for i, row in zip(ids, s, strict=True):
        best = sorted((-round(float(x), 9), int(n)) for n, x in zip(other, row, strict=True) if n != i and x > 0)[:k]
        out[int(i)] = [(n, -x) for x, n in best]
    return out


def test_best_by_single_precision():
    """Close similarities, equal vectors, repeated ids and few vectors, over several tiles."""
    r = np.random.default_rng(4)
    for n, dims, k, noise in ((9000, 8, 5, 1.0), (3000, 16, 15, 1e-7), (2500, 4, 40, 0.0), (3, 4, 6, 1.0)):
        v = r.normal(size=dims) + noise * r.normal(size=(n, dims)) if noise < 1 else r.normal(size=(n, dims))
        vi, qi = np.sort(r.permutation(2 * n)[:n]), r.permutation(2 * n)[:300]
        if n > 100:
            vi[1:4] = vi[0]
        q = np.concatenate([v[:100], r.normal(size=(200, dims))])[: len(qi)]
        unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
        rows, cols, s = semantic._best(qi, unit(q), vi, unit(v), k)
        got = {int(i): [] for i in qi}
        for a, b, x in zip(rows, cols, s, strict=True):
            got[int(qi[a])].append((int(vi[b]), round(float(x), 9)))
        want = ranked(qi, q, vi, v, k)
        assert {i: sorted(x, key=lambda p: (-p[1], p[0])) for i, x in got.items()} == want


def test_nearest_by_blocks_and_shards(spark):
    """Sizes of both are given: shards had been 64 at least and blocks of 2,048, so copies grew with the square early."""
    r = np.random.default_rng(5)
    v = r.normal(size=(400, 6))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = semantic.nearest(rows, rows, 4, block=20, shard=60)
    out = {}
    for i, n, s, rank in got.select("id", "neighbour", "similarity", "rank").collect():
        out.setdefault(i, []).append((rank, n, round(s, 9)))
    assert {i: [p[1:] for p in sorted(x)] for i, x in out.items()} == ranked(range(400), v, range(400), v, 4)


def test_paired_test_reads_ranks_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for f in batches:
            read.add(len(f))
            yield f

    ranks = spark.createDataFrame([(i, f"l{i % 3}", i % 12 + 1) for i in range(90)], "query long, lang string, rank int").mapInPandas(counted, "query long, lang string, rank int")
    other = spark.createDataFrame([(i, "", 1) for i in range(90)], "query long, lang string, rank int")
    assert evaluate.paired_test(ranks, other).count() == 1
    assert read.value == 90


def test_tfidf_shuffles_texts_and_words_of_buckets(spark):
    r = random.Random(6)
    texts = [(i % 50, " ".join(r.choice(["red", "blue", "Green", "don't", "a", "xy", "zeta", f"w{i % 9}x", f"one{i}"]) for _ in range(r.randrange(12)))) for i in range(60)] + [(70, None), (71, "")]
    got = semantic.tfidf(spark.createDataFrame(texts, "id long, text string"), "id", "text", 52)
    moved = re.findall(r"Exchange (\w+)\(([^,)]*)", plan(got))
    assert not [x for x in moved if "id" in x[1].replace("direct_shuffle_partition_id", "")]  # no row of a word by its document
    tf = {}
    for i, x in texts:
        tf.setdefault(i, Counter()).update(w for w in re.findall(r"[^\W\d_](?:[\w'-]*[^\W_])?", (x or "").lower()) if len(w) > 2)
    df = Counter(w for c in tf.values() for w in c)
    want = {}
    for i, c in tf.items():
        w = {t: (1 + math.log(f)) * (math.log(53 / (1 + df[t])) + 1) for t, f in c.items() if 2 <= df[t] <= 26}
        want |= {(i, t): round(x / math.sqrt(sum(y * y for y in w.values())), 9) for t, x in w.items()}
    assert {(i, t): round(x, 9) for i, t, x in got.select("id", "term", "weight").collect()} == want
