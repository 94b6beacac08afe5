import random

import numpy as np
import xxhash

from conftest import values_stay

from lorekeep.llm import queries, simhash


def brute_mark(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(marks):
    """marks: list of (id, mark)"""
    parent = list(range(len(marks)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if bin(marks[i][1] ^ marks[j][1]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(marks):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[find(i)] for i in range(len(marks))]


def test_whole_table(spark, sf, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash_near_dedup(spark, sf).collect()}
    marks = [(i, brute_mark(r.text)) for i, r in sorted(texts.items())]
    assert {i: f"{m:016x}" for i, m in marks} == {i: v[0] for i, v in got.items()}
    assert brute_components(marks) == [got[i][1] for i, _ in marks]


def test_odd_rows(odd, odd_rows, empty):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect())
    marks = [(r[0], brute_mark(r[1])) for r in odd_rows]
    want = sorted((d if d is not None else -1, f"{m:016x}", c) for (d, m), c in zip(marks, brute_components(marks), strict=True))
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.dedup(odd).columns == odd.columns


def test_long_text_in_segments(monkeypatch):
    text = " ".join(random.Random(3).choice(["Alpha", "be", "çß", "d\n"]) for _ in range(500))
    want = brute_mark(text)
    monkeypatch.setattr(simhash, "SEGMENT", 40)
    assert simhash.fingerprint(text) == want


def test_links_of_dense_buckets(spark, monkeypatch):
    rng = random.Random(5)
    center = rng.getrandbits(64)
    marks = {center} | {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for _ in range(300)}
    marks |= {rng.getrandbits(64) for _ in range(200)}
    marks = sorted(marks)
    want = brute_components(list(enumerate(marks)))
    df = spark.createDataFrame([(int(np.uint64(m).view(np.int64)),) for m in marks], "mark long")
    edges = [(r.u, r.v) for r in simhash.links(df).collect()]
    index = {int(np.uint64(m).view(np.int64)): i for i, m in enumerate(marks)}
    assert components_of(edges, index) == want
    monkeypatch.setattr(simhash, "DENSE", 8)
    u = np.array(marks, np.uint64)
    dense = [(int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))) for a, b in simhash._bucket(u, list(range(64)))]
    assert components_of(dense, index) == want


def components_of(edges, index):
    parent = list(range(len(index)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in edges:
        a, b = sorted((find(index[u]), find(index[v])))
        parent[b] = a
    return [find(i) for i in range(len(index))]


def test_dedup_keeps_one_row_of_each_component(spark, clashing, odd_rows, empty):
    out = simhash.dedup(clashing)
    rows = out.collect()
    assert out.columns == clashing.columns and all(map(values_stay, rows))
    got = [simhash.fingerprint(r.text) for r in rows]
    every = {simhash.fingerprint(r[1]) for r in odd_rows}
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(got) for b in got[:i])
    assert len(got) <= len(every) and {simhash.fingerprint(r.text) for r in rows} <= every
    assert simhash.dedup(empty).count() == 0


def test_one_id_in_two_components(spark):
    """An id with two texts is judged text by text; repeated rows leave one."""
    a, b = " ".join(f"a{i}" for i in range(200)), " ".join(f"b{i}" for i in range(200))
    rows = [(5, a, "x"), (3, a, "x"), (5, b, "z"), (5, b, "y"), (9, b, "x"), (None, a, "n")]
    got = [(r.doc_id, r.text[0], r.lang) for r in simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()]
    assert sorted(got) == [(3, "a", "x"), (5, "b", "y")]
