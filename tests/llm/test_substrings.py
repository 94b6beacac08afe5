import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from lorekeep.llm import queries, substrings


def brute(docs, window=20):
    """docs: (id, text) in order; [(id, n, removed, sha)]"""
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def key(r):
    return (-1 if r[0] is None else r[0], *r[1:])


def test_whole_table(spark, sf, texts):
    got = sorted(tuple(r) for r in queries.op5_substring_dedup(spark, sf).collect())
    assert got == brute([(i, r.text) for i, r in texts.items()])


def test_odd_rows_and_more_levels(odd, odd_rows, empty):
    want = sorted(brute([(r[0], r[1]) for r in odd_rows]), key=key)
    assert sorted(map(tuple, substrings.dedup(odd).collect()), key=key) == want
    assert sorted(map(tuple, substrings.dedup(odd, doublings=2).collect()), key=key) == want
    assert substrings.dedup(empty).count() == 0


def test_random_repeats(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(30)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    docs = [(i, " ".join(w for _ in range(rng.randint(0, 6)) for w in rng.choice(passages))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for options in ({}, {"chunk_bytes": 500, "bucket_bytes": 300}):
        assert sorted(map(tuple, substrings.dedup(df, **options).collect())) == brute(docs)
    kept = {r.doc_id: r for r in substrings.dedup(df, with_text=True).collect()}
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in kept.values())


def test_buckets_follow_the_data():
    assert substrings.buckets_for(0, 8, 1 << 24) == 3
    for total in (1 << 30, 1 << 40, 160 * 10**12):
        bits = substrings.buckets_for(total, 8, 1 << 24)
        assert total / 2**bits <= 1 << 24 and bits <= 31
    assert substrings.buckets_for(160 * 10**12, 8, 1 << 24) > 16


def test_the_last_length_compares_both_hashes():
    class Chunk:
        left, ids, doc = np.array([1, 1, 1, 1]), np.array([4]), np.zeros(4, int)

        def hashes(self, n, lane=0):
            return np.array([7, 7, 7, 7], np.uint64) if lane == 0 else np.array([1, 2, 1, 3], np.uint64)

    asked = substrings._Asked(Chunk(), 1, None, True)
    assert asked.place.tolist() == [0, 1, 0, 2] and asked.first.tolist() == [0, 1, 3] and asked.count.tolist() == [2, 1, 1]
    one = substrings._Asked(Chunk(), 1, None, False)
    assert one.place.tolist() == [0, 0, 0, 0] and one.count.tolist() == [4]

    def row(second, owner):
        return substrings._pack(np.array([7], np.uint64)), substrings._pack(np.array([owner])) + substrings._pack(np.array([second], np.uint64))

    for seconds, want in (((1, 2), [False, False]), ((1, 1), [False, True])):
        data, owners = zip(*(row(s, o) for s, o in zip(seconds, (10, 11))))
        said = substrings._reply(2, True)(pa.table({"bucket": pa.array([0, 0], pa.int32()), "chunk": pa.array([0, 1], pa.int32()), "data": pa.array(data, pa.binary()), "owners": pa.array(owners, pa.binary())}))
        assert [bool(b[0] & 128) for b in said.column("bits").to_pylist()] == want


def test_many_buckets_and_a_very_long_text(spark):
    rng = random.Random(4)
    long = " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(120_000))
    docs = [(1, long), (2, "start " + long[: len(long) // 2].rsplit(" ", 1)[0] + " end"), (3, "short text")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, substrings.dedup(df, bucket_bytes=100).collect())) == brute(docs)
