"""Secret scans with corpus-wide ownership frequency [native].

Each text is scanned once; what the scan keeps of it is the list of its matches. Java's ``split`` gives the gaps
between the matches of ``regexp_extract_all``, so code-point positions are running sums over a document's matches. The
candidate values, hashed, are counted by distinct repositories (documents) and owners (sources): a value under one
owner in at most ``MAX_REPOSITORIES`` documents is a live-looking credential; one that several owners have, or that one
owner repeats in more documents, is a copied example. Base matches are always reported; of the further kinds only
live-looking values add spans, and the counts of both sorts are returned. A private key is
its whole block, whatever its line ends are: keys of one type are different values.

Counting is by partial sums, first over (value, owner); the join of matches to their counts lets adaptive execution
split a value that a third of the documents repeat. Positions are computed per document and kind.

Cases: null and empty texts have no spans. Repeated rows are documents of their own. A null source is an owner. Texts
are scanned whole, and a text with many matches only makes many rows. Extra columns are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import cut, unique_by

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A private key from its header through the END line; without one, the header and the base64 runs that follow it.
PEM = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[^-]*+(?:-{1,4}+[^-]++){0,200}+-----END [A-Z ]{0,30}PRIVATE KEY-----"
    r"|(?:(?:\s|\\[nr]){1,8}+[A-Za-z0-9+/=]{16,}+){0,400}+)"
)
#: Kinds in the order in which they are listed: pattern of a match, and of the value in it (None: the match).
KINDS = {
    "assign": (ASSIGN, 2),
    "access": (r"AKIA[A-Z0-9]{16,}", None),
    "hex": (r"[0-9a-f]{24,}", None),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", None),
    "pem": (PEM, None),
    "vendor": (r"(?:gh[pousr]_|glpat-|[sr]k_live_|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,}", None),
    "opaque": (r"[A-Za-z0-9+/_-]{32,}", None),
}
BASE = ("assign", "access", "hex")
#: Documents of one owner that may repeat a live-looking value.
MAX_REPOSITORIES = 10


def _hits(text: Column, kind: str, at: int) -> Column:
    """Matches of a kind: its number, order, gap before, length, value (null if the match fails)."""
    pattern, group = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = lambda m: F.regexp_extract(m, pattern, group) if group else F.regexp_replace(m, r"\s|\\[nr]", "") if kind == "pem" else m
    passes = {
        "assign": lambda m: F.length(value(m)) >= 6,
        "opaque": lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]"),
    }.get(kind, lambda m: F.lit(True))
    hit = lambda gap, m, k: F.struct(F.lit(at).alias("kind"), k.alias("k"), F.length(gap).alias("gap"), F.length(m).alias("len"), F.when(passes(m), F.sha2(value(m), 256)).alias("value"))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("g"), whole.alias("m"))
    found = F.transform(pairs, lambda p, k: hit(p["g"], p["m"], k))
    none = F.array().cast("array<struct<kind:int,k:int,gap:int,len:int,value:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def spans(docs: DataFrame) -> DataFrame:
    """_row, doc_id, kind (number), start, end, n_repositories, n_owners for every match that does not fail; and every
    document's _row and doc_id. Two frames."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(*(_hits(text, k, i) for i, k in enumerate(KINDS)))
    scan = cut(docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long"), F.col("source").alias("_owner"), found.alias("_hits")))
    rows = scan.select("_row", "doc_id", "_owner", F.explode("_hits").alias("h")).select("_row", "doc_id", "_owner", "h.*")
    upto = Window.partitionBy("_row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len")).where("value is not null")
    rows = cut(rows.select("_row", "doc_id", "_owner", "kind", "start", "end", "value"))
    held = rows.select("value", "_owner", "_row").distinct()
    by_owner = held.groupBy("value", "_owner").agg(F.count("*").alias("n"))
    counted = unique_by(by_owner, ["value"], F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))
    return rows.join(counted, "value").drop("value", "_owner"), scan.select("_row", "doc_id")


def report(docs: DataFrame, max_owners: int = 1, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owner_specific and n_widely_copied (all spans)."""
    rows, every = spans(docs)
    names = F.array(*map(F.lit, KINDS))
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    rows = rows.withColumn("base", F.col("kind") < len(BASE)).where(F.col("base") | live)
    item = F.struct("start", "kind", "end", "base")
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    count = lambda kind: F.sum((F.col("kind") == KEYS.index(kind)).cast("long")).alias(f"n_{kind}")
    of_doc = rows.groupBy("_row").agg(
        *(count(k) for k in BASE),
        F.array_sort(F.collect_list(item)).alias("_items"),
        F.sum(live.cast("long")).alias("n_owner_specific"),
        F.sum((~live).cast("long")).alias("n_widely_copied"),
    )
    out = every.join(of_doc, "_row", "left")
    items = F.coalesce("_items", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,base:boolean>>"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*(f"n_{k}" for k in BASE), "n_owner_specific", "n_widely_copied")]
    return out.select("doc_id", *counts, F.sha2(joined(F.filter(items, lambda x: x["base"])), 256).alias("base_sha256"), joined(items).alias("spans"))


KEYS = list(KINDS)
