import glob
import os
import random
import subprocess
import sys
import zlib
from collections import defaultdict
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lorekeep.llm import encoding, packing, queries, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain(path, special_as_text=False):
    """The tokenizer as its file gives it, text by text."""
    t = Tokenizer.from_file(path)
    if special_as_text:
        t.encode_special_tokens = True
    return lambda s: np.array([*t.encode(s or "", add_special_tokens=False).ids, 0], "<u4").tobytes()


@pytest.mark.parametrize("special_as_text", [False, True])
@pytest.mark.parametrize(("path", "word_level"), [(BYTE, False), (WORD, True)])
def test_encoder_equals_the_tokenizer(monkeypatch, path, word_level, special_as_text):
    monkeypatch.setattr(encoding, "SEGMENT", 50)
    monkeypatch.setattr(encoding, "MEMO_PIECES", 200)
    rng, own, want = random.Random(5), encoding.Encoder(path, word_level, special_as_text), plain(path, special_as_text)
    odd = ["a", "B", "The", " ", " ", "\n", "\n\n", "  ", "\t", "é", "É", "e\u0301", "\u00a0", "don't", "<|endoftext|>", "12", "ſ", "İ", "Σ", "中文", "😀", "\x1c", "\x85", "\r\n", ".", "!!", "\u200b", "\u2003", "<|startoftext|>", "<|", "|>", "x###", "It's", "#%"]
    for i in range(1500):
        alphabet = odd if i % 2 else ["a ", "bc ", "d\n", "Foo. ", " x", "É, ", "y"]
        s = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 30, 200])))
        assert own.ids(s) == want(s), repr(s)


@pytest.mark.parametrize(("path", "word_level"), [(BYTE, False), (WORD, True)])
def test_texts_together_equal_the_tokenizer(monkeypatch, path, word_level):
    monkeypatch.setattr(encoding, "MEMO_PIECES", 50)
    monkeypatch.setattr(encoding, "MARKS", 1 << 8)
    rng, own, want = random.Random(9), encoding.Encoder(path, word_level), plain(path)
    odd = ["a", "The", " ", "\n", "  ", "\t", "é", "\x00", "\x01", "don't", "<|endoftext|>", "12", "İ", "中文", "x###", ", ", "Foo ", "bar\n", " baz", "\u00a0"]
    for together in (1, 40, 300, 1 << 20):
        monkeypatch.setattr(encoding, "TOGETHER_BYTES", together)
        for _ in range(25):
            texts = [None if rng.random() < 0.1 else "".join(rng.choice(odd if rng.random() < 0.3 else odd[-6:-1]) for _ in range(rng.choice([0, 1, 5, 30]))) for _ in range(rng.choice([0, 1, 2, 20]))]
            ids, begins = own.batch(pa.array(texts, pa.string()))
            assert [ids[a:b].astype("<u4").tobytes() for a, b in zip(begins, begins[1:])] == [want(t) for t in texts]
            sliced, begins = own.batch(pa.array(["zz", *texts, "q"], pa.string())[1:-1])
            assert sliced.tolist() == ids.tolist()


WORKER = """
import re, sys, threading, time
import numpy as np, pyarrow as pa
from pyspark import TaskContext
from lorekeep.llm import tokens

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def watch():
    while True:
        most[0] = max(most[0], held())
        time.sleep(0.02)

TaskContext.get = classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})())
rng, most = np.random.default_rng(1), [0]
threading.Thread(target=watch, daemon=True).start()
words = ["".join(w) for w in np.array(list("abcdefghijklmnopqrstuvwxyz"))[rng.integers(0, 26, (600_000, 8))].tolist()]
start, n = held(), 0
for task in range(5):
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 400)) for _ in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(texts, pa.string())], ["doc_id", "text"])
    n += sum(b.num_rows for b in tokens._encode(sys.argv[1])(iter([batch])))
assert n == 20_000
print(most[0] - start)
"""


def test_memory_of_a_worker():
    """8 million words, 600,000 distinct: memo, parts of texts and ids stay small beside the texts."""
    run = subprocess.run([sys.executable, "-c", WORKER, BYTE], capture_output=True, text=True, check=True, timeout=300, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    assert float(run.stdout) < 310


def test_file_layout_and_selective_reads(spark, sf, tmp_path):
    """Encodings, indexes and bounded row groups of the files; reads of one column and of few documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 1000)).unionByName(docs.withColumn("doc_id", docs.doc_id + 2000))
    tokens.write_tokens(docs, BYTE, f"{tmp_path}/t", row_group_bytes=200_000)
    files = sorted(glob.glob(f"{tmp_path}/t/*.parquet"))
    last, groups, want, encode = -1, 0, {r.doc_id: r.text for r in docs.collect()}, plain(BYTE)
    for f in files:
        meta = pq.ParquetFile(f).metadata
        columns = {meta.schema.column(i).path.split(".")[0]: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            ids, ahead = group.column(columns["ids"]), group.column(columns["first"])
            assert "RLE_DICTIONARY" in ids.encodings and ids.has_dictionary_page
            assert "DELTA_BINARY_PACKED" in ahead.encodings or "RLE_DICTIONARY" in ahead.encodings
            assert ids.has_offset_index and group.column(columns["doc_id"]).has_column_index and group.column(columns["doc_id"]).has_offset_index
            assert group.num_rows == 1 or group.total_byte_size < 4 * 200_000
            low = group.column(columns["doc_id"]).statistics
            assert last < low.min <= low.max
            last = low.max
        groups += meta.num_row_groups
    assert groups > 2 * len(files)
    stored = tokens.read_tokens(spark, f"{tmp_path}/t")
    some = stored.where("doc_id in (7, 1150)").select("doc_id", "ids")
    assert {r.doc_id: np.array(r.ids, "<u4").tobytes() for r in some.collect()} == {i: encode(want[i]) for i in (7, 1150)}
    plan = stored.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().executedPlan().toString()


def check_tokens(rows, docs):
    """docs: (id, text) in the order of the files."""
    want, start, encode = [], 0, plain(BYTE)
    for i, t in docs:
        raw = encode(t)
        want.append((i, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    key = lambda r: (r[1], r[2])
    assert sorted((tuple(r)[:4] for r in rows), key=key) == want


def test_token_files(spark, sf, texts, odd, odd_rows, empty):
    check_tokens(queries.op4_token_output(spark, sf).collect(), [(i, texts[i].text) for i in sorted(texts)])
    order = sorted(((r[0], r[1]) for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    check_tokens(tokens.encode_and_digest(odd, BYTE).select("doc_id", "start", "n_tokens", "ids_crc32").collect(), order)
    assert tokens.encode_and_digest(empty, BYTE).count() == 0


def check_packing(rows, docs, size):
    by, encode = defaultdict(list), plain(WORD)
    for i, t in docs:
        raw = encode(t)
        for k, j in enumerate(range(0, len(raw), 4 * size)):
            part = raw[j : j + 4 * size]
            by[(i, k)].append((j // 4, len(part) // 4, zlib.crc32(part)))
    got, places = defaultdict(list), defaultdict(list)
    for r in rows:
        got[(r.doc_id, r.piece)].append((r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in by.items()}
    total = 0
    for p in places.values():
        end = 0
        for o, n in sorted(p):
            assert o == end
            end += n
        assert end <= size
        total += end
    return len(places), -(-total // size)


def test_packing(spark, sf, texts, odd, odd_rows, empty):
    n, least = check_packing(queries.op9_best_fit_packing(spark, sf).collect(), [(i, r.text) for i, r in texts.items()], 2048)
    assert n <= least * 1.03 + 1
    check_packing(packing.pack(odd, WORD, 64).collect(), [(r[0], r[1]) for r in odd_rows], 64)
    assert packing.pack(empty, WORD).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(2)
    for counts in ({1: 5000, 2048: 3}, {1500: 700, 548: 650, 2000: 9}, {int(k): int(c) for k, c in zip(rng.integers(1, 2049, 300), rng.integers(1, 999, 300), strict=True)}):
        runs, sequences = packing.plan(counts)
        used, fill = defaultdict(list), np.zeros(sequences, np.int64)
        for k, first, n, seq, offset, m in runs.tolist():
            used[k] += [first, first + n]
            for i in range(n):
                fill[seq + i // m] += k
        assert fill.max() <= 2048 and fill.sum() == sum(k * c for k, c in counts.items())
        for k, c in counts.items():
            ends = sorted(used[k])
            assert ends[0] == 0 and ends[-1] == c and ends[1:-1:2] == ends[2::2]


def test_completions_are_the_best_patterns():
    rng, size = np.random.default_rng(3), 24
    for _ in range(20):
        worth = np.where(rng.random(size + 1) < 0.5, rng.normal(size=size + 1), -np.inf)
        worth[0] = -np.inf
        lengths = np.flatnonzero(np.isfinite(worth)).tolist()
        best = {}
        for k in (1, 2, 3, 4):
            for c in combinations_with_replacement(lengths, k):
                if sum(c) == size:
                    for x in set(c):
                        best[x] = max(best.get(x, -np.inf), sum(worth[y] for y in c))
        rows, total = packing.completions(worth.copy(), size)
        assert (rows.sum(1) == size).all()
        assert np.allclose([sum(worth[y] for y in r if y) for r in rows], total)
        assert np.allclose(sorted(total), sorted(best.values()))


def test_packing_with_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 1)
    docs = [(i, "word " * (i % 70)) for i in range(700)]
    check_packing(packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), WORD, 64).collect(), docs, 64)
