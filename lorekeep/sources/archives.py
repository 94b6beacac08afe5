"""Files in files: members of archives, strict text, SQLite tables, stores of sealed bytes."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKED = (".gz", ".bz2", ".xz")


def _bare(name: str) -> str:
    return next((name[: -len(p)] for p in _PACKED if name.endswith(p)), name)


def _matches(name: str, pattern: str) -> bool:
    return any(fnmatch.fnmatch(n, pattern) for n in (name, _bare(name), name.rsplit("/", 1)[-1]))


def _opened(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """(member, bytes) of an archive in its order; a plain file is its own member, uncompressed."""
    import bz2
    import gzip
    import io
    import lzma
    import tarfile
    import zipfile

    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
    elif name.endswith((".tar", ".tgz", ".tar.gz", ".tar.bz2", ".tar.xz")):
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile())
    else:
        unpack = {".gz": gzip.decompress, ".bz2": bz2.decompress, ".xz": lzma.decompress}
        yield _bare(name), next((f(content) for end, f in unpack.items() if name.endswith(end)), content)


def members(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, member, ord, content of the files at a path: archives (zip, tar and compressed tar) give their members, other
    files themselves. Files are dealt over tasks; an archive is opened in one, member after member."""
    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for where, content in zip(f["path"], f["content"], strict=True):
                file = where.rsplit("/", 1)[-1]
                for i, (name, raw) in enumerate(_opened(file, content)):
                    if _matches(name, pattern):
                        yield pd.DataFrame({"file": [file], "member": [name], "ord": [i], "content": [raw]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "file string, member string, ord int, content binary")


def one(found: DataFrame, pattern: str) -> DataFrame:
    """The only member (member) that matches a pattern; none or several are an error."""
    rows = found.where(F.col("member").rlike(fnmatch.translate(pattern).replace("(?s:", "(?s)(?:")))
    names = [r["member"] for r in rows.select("member").limit(3).collect()]
    if len(names) != 1:
        raise ValueError(f"{pattern}: {'no file' if not names else 'several files: ' + ', '.join(names)}")
    return rows


def text_lines(found: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """file, member, number, line of members (content); bytes that are not of the encoding are an error."""
    bad = F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("member"))).cast("string")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(bad) if encoding.upper() in ("UTF-8", "UTF8") else F.decode("content", encoding)
    lines = F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")
    return found.select("file", "member", F.posexplode(lines).alias("number", "line"))


def sqlite_table(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """Rows of a query on the SQLite files at a path, each opened read-only in the task that has it."""
    names = [f.split()[0] for f in schema.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for f in frames:
            for content in f["content"]:
                con = sqlite3.connect(":memory:")
                con.deserialize(content)
                cursor = con.execute(query)
                if [c[0] for c in cursor.description] != names:
                    raise ValueError(f"the query gives {[c[0] for c in cursor.description]}, not {names}")
                while rows := cursor.fetchmany(10_000):
                    yield pd.DataFrame(rows, columns=names)
                con.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)


# A store of bytes


def blobs(items: DataFrame) -> DataFrame:
    """items (name, content) -> sha, size, content, names: equal bytes are stored once. One name with two contents is an
    error."""
    keyed = items.withColumn("sha", F.sha2("content", 512))
    twice = keyed.groupBy("name").agg(F.countDistinct("sha").alias("n"))
    checked = keyed.join(twice, "name").where(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two contents of "), F.col("name"))).cast("boolean")).otherwise(True))
    return checked.groupBy("sha").agg(F.first("content").alias("content"), F.array_sort(F.collect_set("name")).alias("names")).withColumn("size", F.octet_length("content").cast("long"))


def damaged(stored: DataFrame) -> DataFrame:
    """sha, problem of stored blobs (sha, size, content) that are not what they were."""
    problem = F.when(F.octet_length("content") != F.col("size"), "size").when(F.sha2("content", 512) != F.col("sha"), "bytes")
    return stored.select("sha", problem.alias("problem")).where("problem is not null")
