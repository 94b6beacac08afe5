"""Packing documents into fixed-length sequences by patterns fitted with non-negative least squares.

Documents are encoded and cut into pieces of at most ``size`` tokens. The histogram of piece lengths, ``size`` numbers
at most, goes to the driver. Patterns are multisets of one to four lengths that fill a sequence exactly. Single lengths
and pairs are all listed; of triples and quadruples, too many to list, those are that can still lessen the residual of
the fit: for each length the best completion by one to three more is found over all patterns at once, by dynamic
programming, and the fit is repeated with the new ones, until none is left to add or ``PRICINGS`` times. Projected
gradients fit how often each pattern is repeated so that together they use up the histogram, the counts are rounded down
to what is there, and what remains is packed by best fit in bulk, on counts. The plan is a list of runs: pieces of one
length, from a rank on, go to consecutive sequences at one offset. Its size follows the number of lengths, not of
documents, so it is broadcast. Pieces get their rank within a length through hashed buckets, which become more with the
pieces, and find their run by a binary search.

Cases: a null or empty text is one piece, the end id. Repeated rows and equal ids are packed row by row. Texts of any
length are cut into pieces of ``size`` tokens, the last one shorter. Extra columns are ignored, whatever their names. An
empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import cut
from lorekeep.llm.encoding import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = encoder(path, word_level=True)
        for batch in batches:
            rows = []
            ids, begins = memo.batch(batch.column(1))
            for doc, a, b in zip(batch.column(0).to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                for k, i in enumerate(range(a, b, size)):
                    part = ids[i : min(b, i + size)]
                    rows.append((doc, k, i - a, len(part), zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048) -> DataFrame:
    """One row for each piece of each document: PIECES."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(tokenizer_path, size), PIECES)


#: How often patterns are sought for what the fit leaves over, and the share of the pieces that is not worth another.
PRICINGS = 12
LEFT_OVER = 1e-5
#: Pieces of one length in a bucket, about.
BUCKET_ROWS = 1 << 16


def pairs(have: np.ndarray, size: int) -> np.ndarray:
    """Every pattern of one or two lengths that occur: rows of four lengths, 0 for none, that sum to size."""
    lengths = np.flatnonzero(have)
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    whole = np.array([[size, 0, 0, 0]] if there[size] else [], np.int64).reshape(-1, 4)
    a = lengths[(lengths * 2 <= size) & there[np.clip(size - lengths, 0, size)]]
    return np.concatenate([whole, np.stack([size - a, a, 0 * a, 0 * a], 1)]).astype(np.int64)


def completions(worth: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each length with a finite worth, the pattern with it whose lengths are worth most together, and that worth. All
    multisets of one to four such lengths that sum to size are considered."""
    best, sums = [worth], [np.zeros(size + 1, np.int64)]  # by the number of lengths: the most for each sum, and the last length
    best[0][0] = -np.inf
    for _ in range(2):
        more, last = np.full(size + 1, -np.inf), np.zeros(size + 1, np.int64)
        for s in range(2, size + 1):
            both = worth[1:s] + best[-1][s - 1 : 0 : -1]
            k = int(both.argmax())
            more[s], last[s] = both[k], k + 1
        best.append(more)
        sums.append(last)
    lengths = np.flatnonzero(np.isfinite(worth))
    rest = size - lengths
    values = np.stack([np.where(rest > 0, b[rest], -np.inf) for b in best])
    values = np.concatenate([np.where(rest == 0, 0.0, -np.inf)[None], values])
    many = values.argmax(0)
    rows = np.zeros((len(lengths), 4), np.int64)
    rows[:, 0] = lengths
    for i in np.flatnonzero(many > 0):
        s = int(rest[i])
        for j in range(int(many[i]) - 1, 0, -1):
            rows[i, j + 1] = sums[j][s]
            s -= int(sums[j][s])
        rows[i, 1] = s
    total = worth[lengths] + values.max(0)
    ok = np.isfinite(total)
    return np.sort(rows[ok], 1)[:, ::-1], total[ok]


def patterns(have: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns, and how often the fit repeats them."""
    pats = pairs(have, size)
    for _ in range(PRICINGS):
        x = fit(have, pats)
        residual = have.astype(float) - sum(np.bincount(pats[:, j], weights=x, minlength=size + 1) for j in range(4))
        rows, worth = completions(np.where(have > 0, residual, -np.inf), size)
        new = np.unique(rows[worth > LEFT_OVER * have.sum()], axis=0)
        grown = np.unique(np.concatenate([pats, new]), axis=0)
        if len(grown) == len(pats):
            return pats, x
        pats = grown
    return pats, fit(have, pats)


def fit(have: np.ndarray, pats: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - have|, by projected gradients with momentum."""
    x = np.zeros(len(pats))
    if not len(pats):
        return x
    n = len(have)
    def use(v):
        return sum(np.bincount(pats[:, j], weights=v, minlength=n) for j in range(4)) * (np.arange(n) > 0)
    def back(r):
        r = r.copy()
        r[0] = 0
        return r[pats].sum(1)
    v = np.ones(len(pats))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = back(use(v))
        norm = np.linalg.norm(v)
        v /= norm
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(use(y) - have) / (1.01 * norm))
        t, s = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (s - 1) / t * (new - x), new
    return x


def plan(counts: dict[int, int], size: int = 2048) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, number of pieces, first sequence, offset, pieces in a row) and the number of sequences."""
    have = np.zeros(size + 1, np.int64)
    for k, c in counts.items():
        have[k] = c
    groups: list[tuple[int, list[list[int]]]] = []  # how many sequences, and their [length, repeats]
    pats, x = patterns(have.astype(float), size)
    for i in np.argsort(-x, kind="stable"):
        want = int(x[i] + 1e-6)
        if want <= 0:
            break
        need = defaultdict(int)
        for k in pats[i][pats[i] > 0]:
            need[int(k)] += 1
        times = min(want, *(int(have[k]) // m for k, m in need.items()))
        if times:
            groups.append((times, [[k, m] for k, m in need.items()]))
            for k, m in need.items():
                have[k] -= times * m
    free: dict[int, list[tuple[int, list[list[int]]]]] = defaultdict(list)  # room left: groups of open sequences
    for k in range(size, 0, -1):
        c = int(have[k])
        room = k
        while c and room <= size:
            if not free[room]:
                room += 1
                continue
            times, inside = free[room].pop()
            take = min(times, c)
            if take < times:
                free[room].append((times - take, inside))
            free[room - k].append((take, [*inside, [k, 1]]))
            c -= take
            room = k
        per = size // k
        if c >= per:
            free[size - per * k].append((c // per, [[k, per]]))
        if c % per:
            free[size - c % per * k].append((1, [[k, c % per]]))
    groups += [g for room in sorted(free) for g in free[room]]
    rank, seq, runs = defaultdict(int), 0, []
    for times, inside in groups:
        offset = 0
        for k, m in inside:
            runs.append((k, rank[k], times * m, seq, offset, m))
            rank[k] += times * m
            offset += k * m
        seq += times
    runs.sort()
    return np.array(runs, np.int64).reshape(-1, 6), seq


def place(parts: DataFrame, size: int = 2048) -> DataFrame:
    """parts (PIECES) with sequence_id and offset. parts is read twice and must be stable."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # size rows at most
    runs, _ = plan(counts, size)
    buckets = max(256, max(counts.values(), default=0) // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).alias("_bucket")
    keyed = parts.select("*", bucket)
    sizes = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("_i", F.row_number().over(within) - 1).join(sizes, ["length", "_bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_i")).cast("long").alias("_rank"))
    shared = parts.sparkSession.sparkContext.broadcast(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for b in batches:
            length, rank = np.asarray(b.column(3)), np.asarray(b.column(5))
            i = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            k = rank - table[i, 1]
            m = table[i, 5]
            sequence, offset = table[i, 3] + k // m, table[i, 4] + k % m * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048) -> DataFrame:
    """Encode, cut and pack docs (doc_id, text)."""
    return place(cut(pieces(docs, tokenizer_path, size)), size)
