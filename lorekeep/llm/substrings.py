"""Substring deduplication by level-wise doubling.

A window of ``window`` words is removed where its word sequence also starts earlier in the corpus. Documents are dealt
into chunks of a bounded size. At the shortest length, a quarter of the window, every chunk sends the distinct hashes of
its windows to hashed buckets; a bucket answers which of them other chunks have too. Only windows repeated at one length
are extended to twice that length, as two repeated halves, and asked for again; at the last length the bucket answers
whether another chunk holds an earlier occurrence, by document. What a chunk sends is distinct, so a passage that a
third of the documents share costs one entry for each chunk, and no occurrences are ever paired. Requests are sorted,
delta-coded arrays and answers are bit masks. 32 bits of a hash suffice beneath its bucket at the lengths that only
filter; the last length compares 128 bits, two hashes of the words that share nothing.

Buckets become more with the data, so that each holds about ``BUCKET_BYTES`` at any size. All lengths are one query: the
chunks' texts are shuffled once, and that exchange is reused by each length, which hashes the words anew. A lost executor
costs the map outputs that it held; finished stages of the others stay. (Written answers between the lengths would make
each a query of its own that shuffles the texts again.)

Cases: null, empty and short texts keep every word. Repeated rows stand one after the other: the second one's windows
start later. Rows without an id come after all others. Very long texts are in one chunk, whose arrays hold sixteen bytes
a word. Extra columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
_LAST = (1 << 63) - 1
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
ANSWER = "chunk int, level int, bucket int, bits binary"
ASKED = "bucket int, chunk int, data binary, owners binary"


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A ^ ((b * _B) >> np.uint64(29)) ^ b * _C
    return (x ^ x >> np.uint64(32)) * _B


def _pack(x: np.ndarray) -> bytes:
    """Byte planes: the high bytes of small numbers compress to nothing."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


class _Chunk:
    """The documents of a chunk in the order of their ids, and the hashes of their windows."""

    def __init__(self, table: pa.Table):
        import xxhash

        ids = [_LAST if d is None else d for d in table.column("doc_id").to_pylist()]
        order = sorted(range(len(ids)), key=ids.__getitem__)
        texts = table.column("text")
        self.rows = order
        self.ids = np.array([ids[i] for i in order], np.int64)
        parts, sizes = [], []
        for i in order:
            words = (texts[i].as_py() or "").encode().split()
            sizes.append(len(words))
            parts.append(b"".join(map(xxhash.xxh3_128_digest, words)))
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        words = np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2)
        self.left = np.repeat(self.ends, self.sizes) - np.arange(len(words))  # words to the end of the document
        self.doc = np.repeat(np.arange(len(order)), self.sizes)
        self._known = [{1: np.ascontiguousarray(words[:, k])} for k in range(2)]

    def hashes(self, n: int, lane: int = 0) -> np.ndarray:
        """Of the n words from each position on; meaningless where the document has fewer. There are two lanes, from
        the two halves of a 128-bit hash of each word."""
        known = self._known[lane]
        if n not in known:
            half = n // 2
            a, b = self.hashes(half, lane), self.hashes(n - half, lane)
            known[n] = _mix(a, np.concatenate([b[half:], b[:half]]))
        return known[n]


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, the first most; and where in it a new combination begins."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, new


class _Asked:
    """The distinct windows of one length, in the order of their hashes: positions, the hashes, second hashes at the
    last length, and for each position the place of its window."""

    def __init__(self, chunk: _Chunk, n: int, among: np.ndarray | None, last: bool):
        at = chunk.left >= n
        if among is not None:
            at &= among
        self.at = np.flatnonzero(at)
        keys = [chunk.hashes(n, lane)[self.at] for lane in range(1 + last)]
        order, new = _runs(*keys)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.first = order[new]  # the orders are stable, so the earliest
        self.hash, self.second = keys[0][self.first], keys[1][self.first] if last else None
        self.count = np.diff(np.flatnonzero(np.append(new, True)))

    def cuts(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that get something, and where each begins and ends among the sorted hashes."""
        bucket = (self.hash >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(self.hash), np.int32)
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
        return bucket[starts], np.append(starts, len(bucket))


def _levels(window: int, doublings: int) -> list[int]:
    if window % (1 << doublings):
        raise ValueError("the window is not a multiple of the first length")
    return [window >> k for k in range(doublings, -1, -1)]


def _resolve(chunk: _Chunk, answers: pa.Table | None, lengths: list[int], upto: int, bits: int):
    """The windows that level ``upto`` asks about, given the answers to the levels before; also the answer to each."""
    by = {}
    if answers is not None:
        for level, bucket, raw in zip(answers.column("level").to_pylist(), answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            by[(level, bucket)] = raw
    among = None
    for level in range(upto + 1):
        asked = _Asked(chunk, lengths[level], among, level == len(lengths) - 1)
        said = np.zeros(len(asked.hash), bool)
        buckets, cuts = asked.cuts(bits)
        for k, b in enumerate(buckets):
            raw, n = by.get((level, int(b))), cuts[k + 1] - cuts[k]
            if raw is not None:
                said[cuts[k] : cuts[k + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
        if level == upto:
            return asked, said
        repeated = np.zeros(len(chunk.left) + lengths[level], bool)
        repeated[asked.at] = (said | (asked.count > 1))[asked.place]
        half = lengths[level]
        among = repeated[: len(chunk.left)] & repeated[half : half + len(chunk.left)]


def _ask(lengths: list[int], level: int, bits: int):
    last = level == len(lengths) - 1

    def run(table: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        if not table.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), "data": pa.array([], pa.binary()), "owners": pa.array([], pa.binary())})
        number = table.column("chunk")[0].as_py()
        chunk = _Chunk(table)
        asked, _ = _resolve(chunk, answers, lengths, level, bits)
        buckets, cuts = asked.cuts(bits)
        data, owners = [], []
        own = chunk.ids[chunk.doc[asked.at[asked.first]]] if len(asked.first) else np.zeros(0, np.int64)
        rest = asked.hash if last else (asked.hash >> np.uint64(32 - bits)).astype(np.uint32)
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            part = rest[i:j]
            data.append(_pack(np.diff(part, prepend=part.dtype.type(0))))
            owners.append(_pack(own[i:j]) + _pack(asked.second[i:j]) if last else None)
        n = len(data)
        return pa.table({"bucket": pa.array(buckets[:n], pa.int32()), "chunk": pa.array([number] * n, pa.int32()), "data": pa.array(data, pa.binary()), "owners": pa.array(owners, pa.binary())})

    return run


def _first(ask):
    """The first level has no answers to go by."""
    return lambda table: ask(table)


def _reply(level: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        bucket, chunks = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist()
        kind = np.uint64 if last else np.uint32
        parts = [np.cumsum(_unpack(raw, kind), dtype=kind) for raw in table.column("data").to_pylist()]
        sizes = [len(p) for p in parts]
        values = np.concatenate(parts)
        if last:
            halves = [(raw[: len(raw) // 2], raw[len(raw) // 2 :]) for raw in table.column("owners").to_pylist()]
            owners = np.concatenate([_unpack(a, np.int64) for a, _ in halves])
            second = np.concatenate([_unpack(b, np.uint64) for _, b in halves])
            who = np.repeat(np.array(chunks), sizes)
            order = np.lexsort((who, owners, second, values))
            v, w = values[order], second[order]
            new = np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
            said = np.empty(len(values), bool)
            said[order] = ~new  # all but the chunk with the earliest document
        else:
            _, place, count = np.unique(values, return_inverse=True, return_counts=True)
            said = (count > 1)[place]
        ends = np.cumsum([0, *sizes])
        bits = [np.packbits(said[i:j]).tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
        n = len(chunks)
        return pa.table({"chunk": pa.array(chunks, pa.int32()), "level": pa.array([level] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "bits": pa.array(bits, pa.binary())})

    return run


def _remove(lengths: list[int], bits: int, with_text: bool):
    window = lengths[-1]

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text
        if not table.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
        chunk = _Chunk(table)
        asked, earlier = _resolve(chunk, answers, lengths, len(lengths) - 1, bits)
        repeated = earlier[asked.place]
        later = np.ones(len(asked.at), bool)
        later[asked.first] = False  # the first of the chunk falls only to another chunk
        at = asked.at[repeated | later]
        edge = np.zeros(len(chunk.left) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        gone = np.cumsum(edge)[: len(chunk.left)] > 0
        out, start = [], 0
        docs, texts = table.column("doc_id"), table.column("text")
        for row, end in zip(chunk.rows, chunk.ends, strict=True):
            words, g = (texts[row].as_py() or "").encode().split(), gone[start:end]
            removed = int(g.sum())
            if removed:
                words = [words[i] for i in np.flatnonzero(~g)]
            kept = b" ".join(words)
            out.append((docs[row].as_py(), len(g), removed, hashlib.sha256(kept).hexdigest(), *([kept.decode()] * with_text)))
            start = end
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*out, strict=True), kinds, strict=True)})

    return run


def buckets_for(total: int, least: int, bucket_bytes: int) -> int:
    """Bits of the bucket number: buckets of about bucket_bytes, at least as many as asked for."""
    return max(0, math.ceil(math.log2(max(1, least, total / bucket_bytes))))


def dedup(docs: DataFrame, window: int = 20, doublings: int = 2, with_text: bool = False, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the remaining text if asked for."""
    spark, lengths = docs.sparkSession, _levels(window, doublings)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(least, -(-total // chunk_bytes))
    bits = buckets_for(total, 1, bucket_bytes)  # partitions don't count: every chunk writes to every bucket
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    answers = None
    for level in range(len(lengths)):
        ask, last = _ask(lengths, level, bits), level == len(lengths) - 1
        if answers is None:
            asked = rows.groupBy("chunk").applyInArrow(_first(ask), ASKED)
        else:
            asked = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask, ASKED)
        said = asked.groupBy("bucket").applyInArrow(_reply(level, last), ANSWER)
        answers = said if answers is None else answers.unionByName(said)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_remove(lengths, bits, with_text), schema)
