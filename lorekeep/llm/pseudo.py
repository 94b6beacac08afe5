"""Language-model scores by masked pseudo-likelihood.

The model is a bidirectional window network: the embeddings of the ``SIDE`` words before and after a masked position,
each with a weight vector of its own place, are added up and predict the word between them. The vocabulary is the most
frequent words of the whole corpus, counted over every document; other words share hashed classes by their last letters.
The output is factored: a softmax over groups of words, one over the words of the group, and for a word of a class its
share of the class, P(word | class) = occurrences of the word / occurrences of the class in the whole corpus. The corpus
that is scored is the one that was counted, so there is no unseen word, and the probabilities of the words of a class
sum to that of the class.

Words become ids once, in a written table; training and scoring read that. Training is numpy, on all documents: a hash
of id and text deals them to groups of about ``GROUP_WORDS`` words, and within a group gives their order. A group makes
a pass of stochastic gradient steps of ``STEP`` positions from the shared start, and the weights of the groups are
averaged by their numbers of positions; rounds repeat this from the average. A hash of document and position deals the
positions to the rounds, so that each position of the corpus is masked, and is a training target, in exactly one round.
Groups, order and rounds depend on the documents alone, so neither partitions nor batches change the model, beyond the
rounding of sums. The biases start from the occurrences of the whole vocabulary. Sums meet in a tree, ``FAN`` at a time,
and the driver gets one model. What is gathered follows the corpus: the occurrences of all words, and a set of weights
for each group and round. The network has a fixed size; the counts of words do not, and never come to the driver.

Scoring is one pass: the log-probability of every word of a document from both sides, less log(occurrences) of its
class, summed. log(occurrences) of the words themselves is added: of words that make up at least one in ``KNOWN`` of all
words, so no more than that many, by a table that is broadcast; of all others natively, where the occurrences are dealt
by word, counted and summed for each row. None of those is hot. Words of more than ``LONG`` bytes are counted under their
SHA-256, and stand in its class, which bounds the table's bytes.

Cases: null, empty and blank texts have no words, likelihood 0 and a null mean. Repeated rows are scored row by row, and
all train. Texts of any length are scored whole, a bounded part at a time. Extra columns are ignored. An empty table
gives no rows; without any word the model is its start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import WHITE_SPACE, cut, work_path

GROUPS = 64
VOCABULARY = GROUPS * GROUPS
#: Ids of words outside the vocabulary: classes by their last letters. Id 0 is the padding.
CLASSES = 256
WIDTH = 16
SIDE = 2
ROUNDS = 2
STEP = 2048
RATE = 0.3
#: The sum of squares that a weight starts with.
START_SIZE = 1e-4
#: Words of a group of documents that is trained on by itself, and tasks that train at most.
GROUP_WORDS = 2_000_000
TASKS = 20_000
#: A word whose occurrences are broadcast makes up at least one in so many of all words.
KNOWN = 1 << 20
LONG = 64
#: Arrays that are added up in one task.
FAN = 128
#: Positions whose probabilities are computed at once.
BLOCK = 4096
#: Words that are worked on at once.
PART = 1 << 16
#: Bytes of texts that are cut into words together.
TOGETHER_BYTES = 8 << 20


def _occurrences(docs: DataFrame, *columns: str) -> DataFrame:
    word = F.when(F.octet_length("w") > LONG, F.sha2("w", 256)).otherwise(F.col("w"))
    split = docs.select(*columns, F.explode(F.split(F.coalesce("text", F.lit("")), WHITE_SPACE)).alias("w"))
    return split.where("w <> ''").select(*columns, word.alias("w"))


def known_words(docs: DataFrame) -> list[tuple[str, int]]:
    """Words that make up at least one in KNOWN of all words, so no more than that many, with their occurrences; the most
    frequent first, ties by the word."""
    counts = cut(_occurrences(docs).groupBy("w").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= total / KNOWN).collect()
    return sorted(((r["w"], r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


def vocabulary(known: list[tuple[str, int]]) -> list[str]:
    """The most frequent words, a fixed number at most."""
    return [w for w, _ in known[: VOCABULARY - CLASSES - 1]]


def rare_counts(tokens: DataFrame) -> DataFrame:
    """_row, log_n: the logs of the corpus-wide counts of the unknown words of ``encoded``, summed over a row's words.
    Words that occur once add nothing and may leave a row out."""
    rare = tokens.select("_row", F.explode("unknown").alias("w"))
    counted = rare.withColumn("n", F.count("*").over(Window.partitionBy("w"))).where("n > 1")
    return counted.groupBy("_row").agg(F.sum(F.log("n")).alias("log_n"))


def _long(word: str) -> str:
    return hashlib.sha256(word.encode()).hexdigest()


class Words:
    """Ids of words; known: words outside the vocabulary with their occurrences."""

    def __init__(self, frequent: list[str], known: list[tuple[str, int]] = ()):
        import xxhash

        others = [w for w, _ in known]
        self.table = pa.array([*frequent, *others], pa.string())
        #: Of each word of the table, and -1 for none: dictionary lookups of unknown words give place -1.
        self.ids = np.array([*range(CLASSES + 1, CLASSES + 1 + len(frequent)), *range(VOCABULARY, VOCABULARY + len(others)), -1])
        self._hash = xxhash.xxh32_intdigest
        self.class_of = np.concatenate([np.arange(VOCABULARY), [self._class(w.encode()) for w in others]]).astype(np.int32)
        self.logs = np.concatenate([np.zeros(VOCABULARY), np.log([n for _, n in known])])
        self.hashed = {w: int(k) for w, k in zip([*frequent, *others], self.ids, strict=False) if len(w) == 64}
        self.ends: dict[int, int] = {}

    def _class(self, word: bytes) -> int:
        return 1 + self._hash(word[-3:]) % CLASSES

    def _classes(self, words: pa.Array, which: np.ndarray) -> np.ndarray:
        """The classes of the given ones of distinct words, by their last three bytes: each ending is hashed once."""
        begins = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        data, last, n = np.frombuffer(words.buffers()[2], np.uint8), begins[1:][which], np.minimum(np.diff(begins)[which], 3)
        code = n.astype(np.int64)
        for k in (3, 2, 1):
            code = code << 8 | np.where(n >= k, data[last - np.minimum(k, n)], 0)
        kinds, place = np.unique(code, return_inverse=True)
        for c in kinds.tolist():
            if c not in self.ends:
                self.ends[c] = self._class((c & 0xFFFFFF).to_bytes(3, "big")[3 - (c >> 24) :])
        return np.array([self.ends[c] for c in kinds.tolist()], np.int64)[place]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.ListArray]:
        """Of texts cut into words together, each distinct one looked up once: all ids, where each text's begin, with the
        end, the logs of the occurrences of its known words outside the vocabulary, summed, and its unknown words."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        words = cut.flatten().dictionary_encode()
        names, at = words.dictionary, np.asarray(words.indices)
        ids = self.ids[np.asarray(pc.fill_null(pc.index_in(names, value_set=self.table), -1))]
        sizes = np.asarray(pc.binary_length(names))
        for i in np.flatnonzero(sizes > LONG):  # counted under their hashes
            ids[i] = self.hashed.get(_long(names[int(i)].as_py()), -1)
        unknown = (ids < 0) & (sizes > 0)  # blanks at the ends leave an empty word
        which = np.flatnonzero(unknown)
        if len(which):
            ids[which] = self._classes(names, which)
        if (unknown & (sizes > LONG)).any():
            listed = [_long(w) if n > LONG else w for w, n in zip(names.to_pylist(), sizes, strict=True)]
            names = pa.array(listed, pa.string())
            for i in np.flatnonzero(unknown & (sizes > LONG)):
                ids[i] = self._class(listed[i].encode())
        offsets = np.asarray(cut.offsets) - cut.offsets[0].as_py()
        real, new, logs = (ids >= 0)[at], unknown[at], np.append(np.where(ids >= 0, self.logs[ids], 0.0)[at], 0.0)
        before = lambda x: np.concatenate([[0], np.cumsum(x)])[offsets]
        lists = pa.ListArray.from_arrays(pa.array(before(new).astype(np.int32)), names.take(pa.array(at[new])))
        sums = np.where(np.diff(offsets) > 0, np.add.reduceat(logs, offsets[:-1]), 0.0) if len(texts) else np.zeros(0)
        return self.class_of[ids[at[real]]], before(real), sums, lists

    def of(self, text: str | None) -> np.ndarray:
        """The ids of one text."""
        return self.batch(pa.array([text], pa.string()))[0]


SHAPES = {"embed": (VOCABULARY, WIDTH), "place": (2 * SIDE, WIDTH), "group": (WIDTH, GROUPS), "group_bias": (GROUPS,), "word": (GROUPS, WIDTH, GROUPS), "word_bias": (GROUPS, GROUPS)}
SLICE = 4096


def start(seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = {k: rng.normal(0, 0.3, s) for k, s in SHAPES.items()}
    parts["place"] = 1 + parts["place"]
    for k in ("group_bias", "word_bias"):
        parts[k] = parts[k] * 0
    return np.concatenate([p.ravel() for p in parts.values()]).astype(np.float32)


def _views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, i = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k], i = flat[i : i + n].reshape(s), i + n
    return out


OFFSETS = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])


#: Scores before a softmax are cut to this, so that their exponentials are finite without a search for the largest.
BOUND = np.float32(80)


def _exp(x: np.ndarray) -> np.ndarray:
    """Exponentials of bounded scores, in place."""
    np.clip(x, -BOUND, BOUND, out=x)
    return np.exp(x, out=x)


def log_probabilities(flat: np.ndarray, around: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each word given those about it. Words of one group are predicted together."""
    w, out = _views(flat), np.empty(len(ids))
    for i in range(0, len(ids), BLOCK):
        out[i : i + BLOCK] = _log_probabilities(w, around[i : i + BLOCK], ids[i : i + BLOCK])
    return out


def _near(w: dict[str, np.ndarray], around: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The embeddings of the words at each place, and their weighted sum."""
    near = [w["embed"][around[:, j]] for j in range(2 * SIDE)]
    h = near[0] * w["place"][0]
    for j in range(1, 2 * SIDE):
        h += near[j] * w["place"][j]
    return near, h


def _by_group(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings the words of a group together, the groups, and where each begins, with the end."""
    group = (ids // GROUPS).astype(np.int16)  # sorted by radix
    order = np.argsort(group, kind="stable")
    group = group[order]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return order, group[first], np.append(first, len(ids))


def _log_probabilities(w: dict[str, np.ndarray], around: np.ndarray, ids: np.ndarray) -> np.ndarray:
    order, groups, cuts = _by_group(ids)
    (_, h), t, at = _near(w, around[order]), ids[order], np.arange(len(ids))
    x = h @ w["group"]
    x += w["group_bias"]
    own = np.clip(x[at, t // GROUPS], -BOUND, BOUND)
    logs = own - np.log(_exp(x).sum(1))
    for g, i, j in zip(groups.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        np.matmul(h[i:j], w["word"][g], out=x[i:j])
        x[i:j] += w["word_bias"][g]
    own = np.clip(x[at, t % GROUPS], -BOUND, BOUND)
    logs += own - np.log(_exp(x).sum(1))
    out = np.empty(len(ids))
    out[order] = logs
    return out


def learn(flat: np.ndarray, around: np.ndarray, ids: np.ndarray, rate: float = RATE, sizes: np.ndarray | None = None) -> None:
    """Stochastic gradient steps over masked positions, in place. Each weight moves by its mean gradient over the
    positions that it has a part in, divided by the root of the sum of squares of all such (Adagrad), which ``sizes``,
    as long as flat, holds from call to call."""
    w, seen = _views(flat), _views(np.full(len(flat), START_SIZE, np.float32) if sizes is None else sizes)
    for i in range(0, len(ids), STEP):
        _step(w, seen, around[i : i + STEP], ids[i : i + STEP], np.float32(rate))


def _move(weights: np.ndarray, seen: np.ndarray, grads: np.ndarray, rate: np.float32, rows=...) -> None:
    """One Adagrad step of the given rows."""
    total = seen[rows] + grads * grads
    seen[rows] = total
    np.sqrt(total, out=total)
    grads /= total
    grads *= rate
    weights[rows] -= grads


def _step(w: dict[str, np.ndarray], seen: dict[str, np.ndarray], around: np.ndarray, ids: np.ndarray, rate: np.float32) -> None:
    order, groups, cuts = _by_group(ids)
    c, t, n = around[order], ids[order], len(ids)
    at, spans = np.arange(n), list(zip(groups.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    near, h = _near(w, c)
    p = h @ w["group"]
    p += w["group_bias"]
    _exp(p)
    p *= 1 / p.sum(1, keepdims=True)
    p[at, t // GROUPS] -= 1
    q = np.empty((n, GROUPS), np.float32)
    for g, i, j in spans:
        np.matmul(h[i:j], w["word"][g], out=q[i:j])
        q[i:j] += w["word_bias"][g]
    _exp(q)
    q *= 1 / q.sum(1, keepdims=True)
    q[at, t % GROUPS] -= 1
    dh = p @ w["group"].T
    grads, back = np.empty((len(groups), WIDTH, GROUPS), np.float32), np.empty((n, WIDTH), np.float32)
    for k, (g, i, j) in enumerate(spans):
        np.matmul(h[i:j].T, q[i:j], out=grads[k])
        np.matmul(q[i:j], w["word"][g].T, out=back[i:j])
    dh += back
    many = (1 / np.diff(cuts)).astype(np.float32)
    grads *= many[:, None, None]
    _move(w["word"], seen["word"], grads, rate, groups)
    _move(w["word_bias"], seen["word_bias"], np.add.reduceat(q, cuts[:-1]) * many[:, None], rate, groups)
    _move(w["group"], seen["group"], h.T @ p / np.float32(n), rate)
    _move(w["group_bias"], seen["group_bias"], p.mean(0), rate)
    words = c.T.ravel()  # place after place
    moved = np.concatenate([dh * w["place"][j] for j in range(2 * SIDE)])
    order = np.argsort(words.astype(np.uint16), kind="stable")
    words = words[order]
    first = np.flatnonzero(np.diff(words, prepend=-1))
    sums = np.add.reduceat(moved[order], first)
    sums /= np.diff(first, append=len(words)).astype(np.float32)[:, None]
    place = np.stack([np.einsum("nd,nd->d", e, dh) for e in near]) / np.float32(n)
    _move(w["embed"], seen["embed"], sums, rate, words[first])
    _move(w["place"], seen["place"], place, rate)


def _parts(words: Words, texts: Iterator[str | None]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """(text, words of it), a padded row of ids and the places of the words in it, a bounded number at a time."""
    for parts, row, own in _split(map(words.of, texts)):
        yield [(k, n) for k, _, n in parts], row, own


def _split(arrays: Iterator[np.ndarray]) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]]:
    """(array, first place, places), a padded row of ids and the places in it, a bounded number at a time; parts of one
    array overlap by the words that they need about them and count each word once."""
    held, size = [], 0
    for k, ids in enumerate(arrays):
        for i in range(0, max(len(ids), 1), PART):
            a, b = max(0, i - SIDE), min(len(ids), i + PART + SIDE)
            held.append((k, i, ids[a:b], i - a, min(len(ids), i + PART) - a))
            size += b - a
            if size >= PART:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    """Padding stands between texts, so what is about a word is a shift."""
    size = sum(len(x[2]) + SIDE for x in held) + SIDE
    row, at, places = np.zeros(size, np.int32), SIDE, []
    for _, _, ids, a, b in held:
        row[at : at + len(ids)] = ids
        places.append(np.arange(at + a, at + b))
        at += len(ids) + SIDE
    return [(x[0], x[1], x[4] - x[3]) for x in held], row, np.concatenate(places)


_words: list[tuple[tuple, Words]] = []


def ids_of(shared: tuple[list[str], list[tuple[str, int]]]) -> Words:
    """The worker's Words of a broadcast value."""
    if not _words or _words[0][0] is not shared:
        _words[:] = [(shared, Words(*shared))]
    return _words[0][1]


def encoded(docs: DataFrame, frequent: list[str], known: list[tuple[str, int]] = ()) -> DataFrame:
    """_row, doc_id, key (a hash of id and text), n_words, known_log (the logs of the occurrences of its known words
    outside the vocabulary, summed), unknown (words), ids (two bytes each): docs as a written table."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ids_of(shared.value)
        for b in batches:
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(3)), 0), np.int64))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + TOGETHER_BYTES)))
                ids, begins, logs, unknown = words.batch(b.column(3)[i:j])
                raw = [ids[k:m].astype("<u2").tobytes() for k, m in zip(begins[:-1], begins[1:], strict=True)]
                cols = [*(c[i:j] for c in b.columns[:3]), pa.array(np.diff(begins)), pa.array(logs), unknown, pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:3], "n_words", "known_log", "unknown", "ids"])
                i = j

    doc = F.col("doc_id" if "doc_id" in docs.columns else "_row").cast("long")
    rows = docs.select("_row", doc.alias("doc_id"), F.xxhash64(doc, "text").alias("key"), "text")
    path = work_path(docs.sparkSession, "ids")
    rows.mapInArrow(run, "_row long, doc_id long, key long, n_words long, known_log double, unknown array<string>, ids binary").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _ids(raw) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), "<u2").astype(np.int32)


def _sum(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("sums"))
    return pa.table({"slice": table.column("slice")[:1], "part": table.column("up")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def added(parts: DataFrame, tasks: int) -> np.ndarray | None:
    """parts (slice, part below tasks, sums: doubles) added up slice by slice, FAN at a time; the slices joined."""
    while True:
        up = F.floor(F.col("part") / FAN).cast("int").alias("up")
        parts = parts.select("slice", "part", "sums", up).groupBy("slice", "up").applyInArrow(_sum, "slice int, part int, sums binary")
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
    found = sorted((r["slice"], r["sums"]) for r in parts.collect())  # one array
    return np.concatenate([np.frombuffer(x, np.float64) for _, x in found]) if found else None


def _sliced(sums: np.ndarray) -> pa.RecordBatch:
    parts = [sums[i : i + SLICE].tobytes() for i in range(0, len(sums), SLICE)]
    n = len(parts)
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int32()), pa.array(parts, pa.binary())], ["slice", "part", "sums"])


SUMS = "slice int, part int, sums binary"


def occurrences(tokens: DataFrame) -> np.ndarray:
    """Of each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(VOCABULARY)
        for b in batches:
            for raw in b.column(0):
                seen += np.bincount(_ids(raw), minlength=VOCABULARY)
        if seen.any():
            yield _sliced(seen)

    found = added(tokens.select("ids").mapInArrow(run, SUMS), tokens.rdd.getNumPartitions())
    return np.zeros(VOCABULARY, np.int64) if found is None else found.astype(np.int64)


def targets(keys: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Whether each position is masked in round k: in one of the rounds, by a hash of its key."""
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)) % np.uint64(rounds) == k


def position_keys(keys: list[int], parts: list[tuple[int, int, int]]) -> np.ndarray:
    """A key for each place of parts, from the keys of their documents and the positions there."""
    starts = [(keys[k] + i * 0x165667B19E3779F9) % (1 << 64) for k, i, _ in parts]
    with np.errstate(over="ignore"):
        return np.concatenate([np.uint64(s) + np.arange(n, dtype=np.uint64) * np.uint64(0x165667B19E3779F9) for s, (_, _, n) in zip(starts, parts, strict=True)])


def pass_over(flat: np.ndarray, documents: Iterator[tuple[int, np.ndarray]], k: int, rounds: int) -> tuple[np.ndarray, int]:
    """Weights after a pass of gradient steps over a group's (key, ids), and the number of positions."""
    own, sizes, n, keys = flat.copy(), np.full(len(flat), START_SIZE, np.float32), 0, []

    def arrays():
        for key, ids in documents:
            keys.append(key)
            yield ids

    for parts, row, places in _split(arrays()):
        masked = targets(position_keys(keys, parts), k, rounds)
        at = places[masked]
        learn(own, row[at[:, None] + OFFSETS], row[at], RATE / (1 + k), sizes)
        n += len(at)
    return own, n


def fit(tokens: DataFrame, rounds: int = ROUNDS, group_words: int = GROUP_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights after the given number of rounds over all of ``encoded``, and the occurrences of each class."""
    sc, flat, seen = tokens.sparkSession.sparkContext, start(), occurrences(tokens)
    groups = max(1, -(-int(seen.sum()) // group_words))
    tasks = min(groups, TASKS)
    w, counts = _views(flat), seen.reshape(GROUPS, GROUPS) + 0.5
    w["group_bias"][:] = np.log(counts.sum(1) / counts.sum())
    w["word_bias"][:] = np.log(counts / counts.sum(1, keepdims=True))
    group = F.pmod("key", F.lit(groups).cast("long")).alias("group")
    dealt = tokens.where("n_words > 0").select(group, "key", "ids").repartitionById(tasks, F.pmod("group", F.lit(tasks).cast("long")).cast("int"))
    dealt = dealt.sortWithinPartitions("group", "key", "ids")
    for k in range(rounds):
        shared = sc.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            rows = ((g, key, _ids(raw)) for b in batches for g, key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True))
            sums = np.zeros(len(shared.value) + 1)
            for _, documents in groupby(rows, key=itemgetter(0)):
                own, n = pass_over(shared.value, ((key % (1 << 64), ids) for _, key, ids in documents), k, rounds)
                sums[:-1] += n * own.astype(np.float64)
                sums[-1] += n
            if sums[-1]:
                yield _sliced(sums)

        found = added(dealt.mapInArrow(run, SUMS), tasks)
        if found is not None:
            flat = (found[:-1] / found[-1]).astype(np.float32)
    return flat, seen[: CLASSES + 1]


def train(docs: DataFrame, frequent: list[str], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """fit() of documents."""
    return fit(encoded(docs, frequent), rounds)


def scores(docs: DataFrame, rounds: int = ROUNDS, group_words: int = GROUP_WORDS) -> DataFrame:
    """doc_id, n_words, log_likelihood (natural, summed over the words), mean_log_likelihood."""
    docs = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long"), "text")
    known = known_words(docs)
    frequent = vocabulary(known)
    chosen = set(frequent)
    others = [(w, n) for w, n in known if w not in chosen]
    tokens = encoded(docs, frequent, others)
    flat, totals = fit(tokens, rounds, group_words)
    spread = np.zeros(VOCABULARY)
    spread[: CLASSES + 1] = np.log(np.maximum(totals, 1))
    shared = docs.sparkSession.sparkContext.broadcast((flat, spread))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, spread = shared.value
        for b in batches:
            total = np.zeros(b.num_rows)
            for parts, row, places in _split(map(_ids, b.column(3))):
                ids, i = row[places], 0
                logs = log_probabilities(flat, row[places[:, None] + OFFSETS], ids) - spread[ids]
                for k, _, m in parts:
                    total[k] += float(logs[i : i + m].sum())
                    i += m
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pc.add(b.column(4), pa.array(total))], ["_row", "doc_id", "n_words", "in_class"])

    scored = tokens.select("_row", "doc_id", "n_words", "ids", "known_log").mapInArrow(run, "_row long, doc_id long, n_words long, in_class double")
    total = F.col("in_class") + F.coalesce("log_n", F.lit(0.0))
    out = scored.join(rare_counts(tokens), "_row", "left").select("doc_id", "n_words", total.alias("log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))
