"""SimHash near-duplicates by pigeonhole blocks.

Every text gets a 64-bit fingerprint: the majority, bit by bit, of the XXH64 hashes of its shingles. Fingerprints are
split into six blocks; of two that differ in at most three bits, three blocks are equal, so each distinct fingerprint
is joined under its 20 choices of three blocks (32 bits or so, against the quadratic buckets that one short block would
give). Within a bucket the Hamming distance is verified, and only a spanning forest of the links leaves the task: never
all pairs. A bucket of more than ``DENSE`` distinct fingerprints is split again by the pigeonhole principle on its
other bits until no part can exceed 4,096. Components come from stars over distinct fingerprints, so a group of exact
copies is one node.

Cases: null, empty and blank texts have the fingerprint 0, which is linked like any other. Texts under three words are
one shingle. Repeated rows and ids come out row by row; a component is named by its least doc_id, null only if all its
ids are. ``dedup`` keeps one row of each component: of the least id, of those the text with the least hash, and of rows
with equal id and text the one whose columns, as strings, come first. Texts are read whole, a bounded part at a time.
Extra columns are ignored, and carried by ``dedup``, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import cut, free_names, one_of_each, unique_by
from lorekeep.llm.components import components

DISTANCE = 3
DENSE = 4096
#: First bit and width of each block.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
SEGMENT = 1 << 20
_BLANK = re.compile(r"[ \t-\r]")


def _word_lists(text: str) -> Iterator[list[bytes]]:
    i = 0
    while i < len(text):
        m = _BLANK.search(text, i + SEGMENT)
        j = m.start() if m else len(text)
        yield text[i:j].encode().lower().split()  # bytes.lower() changes A-Z alone, split() the six ASCII blanks
        i = j


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint."""
    import xxhash

    digest = partial(xxhash.xxh64_digest, seed=seed)
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for words in _word_lists(text or ""):
        words = tail + words
        if len(words) >= width:
            raw = b"".join(map(digest, map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))))
            ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            total += len(words) - width + 1
        tail = words[-(width - 1) :]
    if not total:
        if not tail:
            return 0
        ones, total = np.unpackbits(np.frombuffer(digest(b" ".join(tail)), np.uint8)).astype(np.int64), 1
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        marks = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks), *b.columns[2:]], ["doc_id", "mark", *b.schema.names[2:]])


def fingerprints(docs: DataFrame, with_text_hash: bool = False) -> DataFrame:
    """doc_id, mark, the fingerprint as a signed long, and, if asked for, a hash of the text."""
    more = [_text_hash(F.col("text")).alias("text_hash")] * with_text_hash
    return docs.select(F.col("doc_id").cast("long"), "text", *more).mapInArrow(_fingerprints, "doc_id long, mark long" + ", text_hash long" * with_text_hash)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _mask(parts) -> int:
    return sum(((1 << w) - 1) << s for s, w in parts)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(marks: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join each component of close marks; breadth first, every two marks compared once at most."""
    out, left = [], marks
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            grown = []
            for m in front:
                close = np.bitwise_count(left ^ m) <= DISTANCE
                if close.any():
                    grown.append(left[close])
                    out += [(int(m), int(x)) for x in grown[-1]]
                    left = left[~close]
            front = np.concatenate(grown) if grown else front[:0]
    return out


def _bucket(marks: np.ndarray, free: list[int]) -> list[tuple[int, int]]:
    """free: the bits in which the marks of the bucket can differ."""
    if len(marks) <= DENSE:
        return _forest(marks)
    parts, out = np.array_split(np.array(free, np.uint64), 8), []
    for chosen in combinations(range(8), 8 - DISTANCE):
        mask = np.uint64(sum(1 << int(b) for k in chosen for b in parts[k]))
        order = np.argsort(marks & mask, kind="stable")
        keys = (marks & mask)[order]
        ends = np.flatnonzero(np.diff(keys)) + 1
        for run in np.split(marks[order], ends):
            if len(run) > 1:
                out += _forest(run)
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """choice, key, mark sorted by choice and key -> edges (u, v). A bucket can span batches."""
    choices = list(combinations(range(len(BLOCKS)), len(BLOCKS) - DISTANCE))

    def edges(choice: int, marks: np.ndarray) -> list[tuple[int, int]]:
        own = _mask([BLOCKS[k] for k in choices[choice]])
        return _bucket(marks, [b for b in range(64) if not own >> b & 1])

    open_key, held = None, []
    for b in batches:
        c, k, m = (np.asarray(b.column(i)) for i in range(3))
        if not len(c):
            continue
        m = m.view(np.uint64)
        ends = np.concatenate(([0], np.flatnonzero((np.diff(c) != 0) | (np.diff(k) != 0)) + 1, [len(c)]))
        sizes = np.diff(ends)
        out = []
        first = (int(c[0]), int(k[0]))
        if first == open_key:
            held.append(m[: ends[1]])
        else:
            if held and sum(map(len, held)) > 1:
                out += edges(open_key[0], np.concatenate(held))
            held = [m[: ends[1]]]
            open_key = first
        if len(sizes) > 1:
            if sum(map(len, held)) > 1:
                out += edges(open_key[0], np.concatenate(held))
            inner = np.arange(1, len(sizes) - 1)
            two = ends[inner[sizes[inner] == 2]]
            two = two[np.bitwise_count(m[two] ^ m[two + 1]) <= DISTANCE] if len(two) else two
            out += zip(m[two].tolist(), m[two + 1].tolist(), strict=True)
            for i in inner[sizes[inner] > 2]:
                out += edges(int(c[ends[i]]), m[ends[i] : ends[i + 1]])
            open_key, held = (int(c[-1]), int(k[-1])), [m[ends[-2] :]]
        if out:
            yield _edge_batch(out)
    if held and sum(map(len, held)) > 1 and (out := edges(open_key[0], np.concatenate(held))):
        yield _edge_batch(out)


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    e = np.array(edges, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])


def links(marks: DataFrame) -> DataFrame:
    """Distinct marks (mark) -> edges (u, v) that connect whatever is within the distance."""
    masks = [_signed(_mask([BLOCKS[k] for k in c])) for c in combinations(range(len(BLOCKS)), len(BLOCKS) - DISTANCE)]
    keys = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("mark").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)))
    keyed = marks.select(F.explode(keys).alias("k"), "mark").select("k.*", "mark")
    return keyed.repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(_links, "u long, v long")


def _rooted(marks: DataFrame) -> DataFrame:
    """mark and root, the component, for each distinct mark, and least_id, the least id with the mark."""
    classes = cut(unique_by(marks, ["mark"], F.min("doc_id").alias("least_id")))
    stars = components(links(classes.select("mark")))
    return classes.join(stars.select(F.col("u").alias("mark"), F.col("v").alias("root")), "mark", "left").withColumn("root", F.coalesce("root", "mark"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (its least doc_id)."""
    marks = cut(fingerprints(docs))
    rooted = _rooted(marks)
    named = unique_by(rooted, ["root"], F.min("least_id").alias("component_id"))
    of_mark = rooted.join(named, "root").select("mark", "component_id")
    return marks.join(unique_by(of_mark, ["mark"], F.min("component_id").alias("component_id")), "mark").select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one with the least id."""
    marks = cut(fingerprints(docs, with_text_hash=True))
    rooted = unique_by(_rooted(marks), ["mark"], F.min("root").alias("root"))
    rows = cut(marks.groupBy("doc_id", "text_hash").agg(F.min("mark").alias("mark"), F.count("*").alias("copies")).join(rooted, "mark"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))).alias("first")
    best = unique_by(rows, ["root"], first).select("root", "first.*")
    judged = rows.join(best, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    judged = cut(judged.select("doc_id", "text_hash", "copies", "stays"))

    id_, hash_, own = free_names(docs, "_id", "_hash", "_own_hash")
    keyed = docs.withColumn(own, _text_hash(F.col("text")))
    same = lambda found: keyed["doc_id"].cast("long").eqNullSafe(found[id_]) & (keyed[own] == found[hash_])
    found = lambda condition: judged.where(condition).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    gone, repeated = found("NOT stays"), found("stays AND copies > 1")
    kept, columns = keyed.join(gone, same(gone), "left_anti"), [F.col(f"`{c}`") for c in docs.columns]
    if repeated.isEmpty():
        return kept.select(*columns)
    once = kept.join(repeated, same(repeated), "left_anti").select(*columns)
    return once.unionByName(one_of_each(kept.join(repeated, same(repeated), "left_semi"), ["doc_id", own]).select(*columns))
