"""Term weights, latent semantics and vector neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.vectors import cosine

#: Vectors of a shard and queries of a block, about.
SHARD_ROWS, BLOCK_ROWS = 100_000, 25_000
#: Queries and vectors that are multiplied at once, vectors that set a first bar, pairs computed in double precision at once.
TILE, FIRST, CANDIDATES = (256, 8192), 2048, 65536
#: Bytes of the texts of a bucket, about.
BUCKET_BYTES = 16 << 20
#: Letters first and last, marks between; or a single letter.
TOKEN = r"(\p{L}[\p{L}\p{N}_'-]*[\p{L}\p{N}]|\p{L})"


def terms(df: DataFrame, id_: str, text: str, buckets: int, stop: tuple[str, ...] = ()) -> DataFrame:
    """id, term, tf of words over two letters, and the bucket of the id. Texts are dealt to the buckets once, by their
    ids; words, many times as large when they are rows, are counted there."""
    bucket = F.coalesce(F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int"), F.lit(0)).alias("bucket")
    dealt = df.select(F.col(id_).alias("id"), F.col(text).alias("_text"), bucket).repartitionById(buckets, "bucket")
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col("_text"), F.lit(""))), F.lit(TOKEN), F.lit(1))
    rows = dealt.select("bucket", "id", F.explode(words).alias("term")).where(F.length("term") > 2)
    if stop:
        rows = rows.where(~F.col("term").isin(*stop))
    return rows.groupBy("bucket", "id", "term").agg(F.count("*").alias("tf"))


def tfidf(docs: DataFrame, id_: str, text: str, n: int, stop: tuple[str, ...] = ()) -> DataFrame:
    """id, term, weight of n documents: sublinear, idf with one added, rows of length 1; terms in 2 to n/2 documents.
    Buckets send each term that they have once, and get its number of documents back."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    tf = terms(docs, id_, text, buckets, stop)
    had = tf.groupBy("bucket", "term").agg(F.count("*").alias("c")).withColumn("df", F.sum("c").over(Window.partitionBy("term")))
    known = had.where((F.col("df") >= 2) & (F.col("df") <= n / 2)).select("bucket", "term", "df").repartitionById(buckets, "bucket")
    w = (1 + F.log("tf")) * (F.log((1 + n) / (1 + F.col("df"))) + 1)
    rows = tf.join(known.hint("shuffle_hash"), ["bucket", "term"]).withColumn("w", w)
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("bucket", "id")))
    return rows.select("id", "term", (F.col("w") / length).alias("weight"))


def lsa(weights: DataFrame, ids: list, dims: int = 48) -> tuple[list, np.ndarray]:
    """Latent vectors of the given documents: a model over at most a few thousand rows, whose Gram matrix the tasks
    build and the driver decomposes. The largest entry of each axis is positive."""
    index = {d: i for i, d in enumerate(ids)}
    if len(ids) > 5000:
        raise ValueError("fit on at most 5,000 documents and fold the others in")
    mine = weights.where(F.col("id").isin(ids))
    pairs = mine.alias("a").join(mine.alias("b"), "term").groupBy("a.id", F.col("b.id").alias("other")).agg(F.sum(F.col("a.weight") * F.col("b.weight")).alias("g"))
    gram = np.zeros((len(ids), len(ids)))
    for r in pairs.collect():  # at most the square of the documents of the model
        gram[index[r["id"]], index[r["other"]]] = r["g"]
    values, axes = np.linalg.eigh(gram)
    values, axes = np.maximum(values[::-1][:dims], 0), axes[:, ::-1][:, :dims]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)
    vectors = axes * np.sqrt(values)
    return ids, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def _rows_of(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of length 1 as rows."""
    lists = column.combine_chunks()
    flat = np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-30)


def _best(qi: np.ndarray, q: np.ndarray, vi: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and vectors, similarity: the k best of each query, by the similarity rounded to 9 decimals and then
    by the place of the vector, without equal ids and what isn't positive. Single precision tells which pairs can be among
    them, by a margin above its error; those are computed in double precision."""
    margin = 4 * (q.shape[1] + 8) * float(np.finfo(np.float32).eps) + 1e-8
    q32, v32 = q.astype(np.float32), v.astype(np.float32)
    out = []
    for i in range(0, len(qi), TILE[0]):
        part = slice(i, i + TILE[0])
        rows, cols, exact = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        bar = np.full((len(qi[part]), 1), -margin, np.float32)
        edges = [0, *range(FIRST, len(vi), TILE[1]), len(vi)]
        for j, end in zip(edges, edges[1:], strict=False):
            s = q32[part] @ v32[j:end].T
            if j == 0 and end >= k:  # a first bar
                fit = np.where((qi[part, None] == vi[None, :end]) | np.isnan(s), np.float32(-1), s)
                bar = np.maximum(bar, np.partition(fit, end - k, axis=1)[:, end - k : end - k + 1] - np.float32(2 * margin))
            r, c = np.divmod(np.flatnonzero(s >= bar), end - j)
            c += j
            other = qi[i + r] != vi[c]
            r, c = r[other], c[other]
            if not len(r):
                continue
            e = np.concatenate([np.einsum("ij,ij->i", q[i + r[x : x + CANDIDATES]], v[c[x : x + CANDIDATES]]) for x in range(0, len(r), CANDIDATES)])
            up = e > 0
            rows, cols, exact = np.concatenate([rows, r[up]]), np.concatenate([cols, c[up]]), np.concatenate([exact, e[up]])
            order = np.lexsort((cols, -np.round(exact, 9), rows))
            place = np.arange(len(rows)) - np.searchsorted(rows[order], rows[order])
            keep, last = order[place < k], order[place == k - 1]
            bar[rows[last], 0] = np.maximum(bar[rows[last], 0], (exact[last] - 2 * margin).astype(np.float32))
            rows, cols, exact = rows[keep], cols[keep], exact[keep]
        out.append((rows + i, cols, exact))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 6, block: int = BLOCK_ROWS, shard: int = SHARD_ROWS) -> DataFrame:
    """queries and vectors (id, v) -> id, neighbour, similarity, rank from 0: exact cosine by blocks of queries times
    shards of vectors, k kept for each query and shard and then overall; positive, without the row itself. Numbers of
    blocks and shards are the least that a task can hold, so that rows are copied as few times as possible."""
    shards = max(4, -(-vectors.count() // shard))
    parts = max(16, -(-queries.count() // block))
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    # Exact search: every block of queries meets every shard of vectors once; both counts are bounded by their rows.
    mine = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("_b"), spread(shards, "_s"))
    dealt = vectors.select(F.col("id").alias("vid"), F.col("v").alias("vv"), spread(parts, "_c"), F.pmod(F.xxhash64("vid"), F.lit(shards)).cast("int").alias("_d"))

    def multiply(q: pa.Table, v: pa.Table) -> pa.Table:
        kind = {"id": pa.int64(), "neighbour": pa.int64(), "similarity": pa.float64()}
        if not q.num_rows or not v.num_rows:
            return pa.table({n: pa.array([], t) for n, t in kind.items()})
        v = v.sort_by("vid")  # of equal similarities the least ids are kept
        qi, vi = np.asarray(q.column("id")), np.asarray(v.column("vid"))
        rows, cols, s = _best(qi, _rows_of(q.column("v")), vi, _rows_of(v.column("vv")), k)
        return pa.table({"id": qi[rows], "neighbour": vi[cols], "similarity": s})

    found = mine.groupBy("_b", "_s").cogroup(dealt.groupBy("_c", "_d")).applyInArrow(multiply, "id long, neighbour long, similarity double")
    order = Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 9)), "neighbour")
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def centroids(vectors: DataFrame, group: str, vector: str, mass: str | None = None) -> DataFrame:
    """group, dim, mean: weighted by mass, dimension by dimension."""
    w = F.lit(1.0) if mass is None else F.col(mass).cast("double")
    rows = vectors.select(group, w.alias("w"), F.posexplode(vector).alias("dim", "x"))
    return rows.groupBy(group, "dim").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("mean"))


def similarity_to(vectors: DataFrame, id_: str, vector: str, query: list[float]) -> DataFrame:
    return vectors.select(F.col(id_).alias("id"), cosine(F.col(vector), F.array(*map(F.lit, query))).alias("similarity"))


def fold_in(batch: pd.DataFrame, basis: np.ndarray) -> np.ndarray:
    """Rows of weights projected on a basis and scaled to length 1."""
    v = batch.to_numpy() @ basis
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
