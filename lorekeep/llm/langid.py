"""Language identification by prediction by partial matching.

A model is one context tree of bytes for each language, up to ``ORDER`` bytes of context, with escapes to shorter
contexts (method C: an unseen byte costs the number of distinct successors over that and all occurrences). After
training the statistics are frozen, so the code length of a byte depends on the bytes before it alone and a text costs
the sum over its positions. Lengths are computed exactly, by binary search in sorted n-gram counts, for each distinct
context and byte that occurs, and remembered; scoring a batch is then table lookups in numpy. The language with the
shortest code wins; the score is its posterior share, with the difference of code lengths scaled to a byte.

Training takes at most ``FIT_ROWS`` documents of each language, those with the least hash of their id, and of these the
ones of at most ``FIT_BYTES``: a bounded sample of labelled rows, found by a limit that is applied before the shuffle.
Only the chosen ids are joined to the texts, by broadcast as long as they are at most ``MOST_IDS`` (a count that is
checked), so no text is shuffled but the sample's. Only training sees languages and ids. The model is broadcast; its size
is bounded by the sample. Scoring is one pass without a shuffle.

Cases: texts that are null or have no letter are ``und`` with score 0, as is everything where nothing was learned.
Repeated rows are judged row by row. Whole texts are scored, a bounded part at a time. Extra columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import cut

ORDER = 3
FIT_ROWS = 150
FIT_BYTES = 1 << 18
MOST_IDS = 100_000
#: Bytes scored at once.
PART = 1 << 20
#: n-grams that a worker remembers.
KNOWN = 500_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text and lang of the training documents."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    first = lambda df: df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows)
    ids = cut(first(usable.select("lang", "doc_id")).select("lang", "doc_id").distinct())
    if ids.count() <= MOST_IDS:
        ids = F.broadcast(ids)
    # Rows that repeat an id come along with it, so the limit is applied again.
    found = first(usable.select("lang", "doc_id", "text").join(ids, ["lang", "doc_id"], "left_semi"))
    return found.where(F.octet_length("text") <= FIT_BYTES).select("lang", "text")


class Tree:
    """Counts of all n-grams up to ORDER + 1 bytes of one language."""

    def __init__(self, texts: list[str]):
        self.grams, self.totals = [], []
        codes = [self._codes(np.frombuffer(t.encode(), np.uint8)) for t in texts]
        for n in range(ORDER + 1):  # n bytes of context
            mask = np.uint32((1 << 8 * (n + 1)) - 1)
            every = np.concatenate([c & mask for c in codes]) if codes else np.zeros(0, np.uint32)
            grams, counts = np.unique(every, return_counts=True)
            contexts, first = np.unique(grams >> np.uint32(8), return_index=True)
            seen = np.add.reduceat(counts, first) if len(first) else counts
            distinct = np.diff(np.append(first, len(grams)))
            self.grams.append((grams, counts))
            self.totals.append((contexts, seen + distinct, distinct))

    @staticmethod
    def _codes(data: np.ndarray) -> np.ndarray:
        """Each byte with the ORDER bytes before it; zero bytes stand before the text."""
        x = np.concatenate([np.zeros(ORDER, np.uint8), data]).astype(np.uint32)
        out = np.zeros(len(data), np.uint32)
        for k in range(ORDER + 1):
            out = out << np.uint32(8) | x[k : k + len(data)]
        return out

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return i, keys[i] == wanted

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code lengths of bytes after their contexts."""
        cost, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
        for n in range(ORDER, -1, -1):
            mask = np.uint32((1 << 8 * (n + 1)) - 1)
            (grams, counts), (contexts, total, distinct) = self.grams[n], self.totals[n]
            j, known = self._find(contexts, (codes & mask) >> np.uint32(8))
            i, hit = self._find(grams, codes & mask)
            hit &= open_
            cost[hit] += np.log2(total[j[hit]] / counts[i[hit]])
            open_ &= ~hit
            escape = open_ & known
            cost[escape] += np.log2(total[j[escape]] / distinct[j[escape]])
        return cost + 8 * open_


def train(rows: list[tuple[str, str]]) -> list[tuple[str, Tree]]:
    """(language, text) -> a tree for each language, in the order of their names."""
    by: dict[str, list[str]] = {}
    for lang, text in rows:
        by.setdefault(lang, []).append(text)
    return [(lang, Tree(by[lang])) for lang in sorted(by)]


class Scorer:
    """Frozen trees and the code lengths that were needed so far."""

    def __init__(self, model: list[tuple[str, Tree]]):
        self.langs, self.trees = [x for x, _ in model], [t for _, t in model]
        self.keys = np.zeros(0, np.uint32)
        self.costs = np.zeros((0, len(model)))

    def _costs(self, codes: np.ndarray) -> np.ndarray:
        i, hit = Tree._find(self.keys, codes)
        if not hit.all():
            new = np.unique(codes[~hit])
            fresh = np.stack([t.bits(new) for t in self.trees], 1)
            keys = np.concatenate([self.keys, new]) if len(self.keys) + len(new) <= KNOWN else new
            costs = np.concatenate([self.costs, fresh]) if len(keys) > len(new) else fresh
            order = np.argsort(keys)
            self.keys, self.costs = keys[order], costs[order]
            return self._costs(codes) if len(keys) > len(new) else self._direct(codes)
        return self.costs[i]

    def _direct(self, codes: np.ndarray) -> np.ndarray:
        distinct, place = np.unique(codes, return_inverse=True)
        return np.stack([t.bits(distinct) for t in self.trees], 1)[place]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits that each language's tree needs for each text."""
        out = np.zeros((len(texts), len(self.trees)))
        held, size = [], 0
        for k, raw in enumerate(texts):
            data = np.frombuffer(raw, np.uint8)
            for i in range(0, len(data), PART):
                before = data[max(0, i - ORDER) : i]
                held.append((k, Tree._codes(np.concatenate([before, data[i : i + PART]]))[len(before) :]))
                size += len(held[-1][1])
                if size >= PART:
                    self._add(out, held)
                    held, size = [], 0
        self._add(out, held)
        return out

    def _add(self, out: np.ndarray, held: list[tuple[int, np.ndarray]]) -> None:
        if held:
            distinct, place = np.unique(np.concatenate([c for _, c in held]), return_inverse=True)
            costs = self._costs(distinct)
            ends = np.cumsum([0] + [len(c) for _, c in held])
            rows = [k for k, _ in held]
            for j in range(out.shape[1]):
                np.add.at(out[:, j], rows, np.add.reduceat(costs[:, j][place], ends[:-1]))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        able = [k for k, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if able:
            raw = [texts[k].encode() for k in able]
            bits = self.lengths(raw) / np.array([len(r) for r in raw])[:, None]
            best = bits.argmin(1)
            share = 1 / np.exp2(8 * (bits.min(1)[:, None] - bits)).sum(1)
            for k, b, s in zip(able, best, share, strict=True):
                out[k] = (self.langs[b], float(s))
        return out


_latest: list[tuple[list, Scorer]] = []


def scorer(model: list[tuple[str, Tree]]) -> Scorer:
    """The worker's scorer of a model, with what it has remembered."""
    if not _latest or _latest[0][0] is not model:
        _latest[:] = [(model, Scorer(model))]
    return _latest[0][1]


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = train([(r["lang"], r["text"]) for r in sample(docs, fit_rows).collect()])  # FIT_ROWS of FIT_BYTES for each language at most
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(shared.value)
        for b in batches:
            found = own.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
