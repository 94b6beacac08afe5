"""Text keys and tokens. Case-insensitive means Python's IGNORECASE over NFC text; the key reproduces it code point by
code point in generated code. Python runs only on texts that normalisation can change."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words for full-text search: runs of letters, numbers, private-use characters and marks.
WORD_BREAK = r"[^\p{L}\p{N}\p{Co}\p{M}]+"
CJK = r"[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]"
#: A change of the key's rule, and the Unicode tables behind it: an index of keys made under another is not current.
KEY_VERSION = f"1-{unicodedata.unidata_version}"


@lru_cache(1)
def fold_table() -> tuple[str, str]:
    """The characters whose key differs from them, and their keys: the least of the lower case and of what IGNORECASE
    treats as equal to it."""
    import _sre
    from re import _casefix

    source, key = [], []
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        low = _sre.unicode_tolower(c)
        least = min((low, *_casefix._EXTRA_CASES.get(low, ())))
        if least != c:
            source.append(chr(c))
            key.append(chr(least))
    return "".join(source), "".join(key)


def fold(text: str) -> str:
    return unicodedata.normalize("NFC", text).translate(_fold_map())


@lru_cache(1)
def _fold_map() -> dict[int, str]:
    return dict(zip(map(ord, fold_table()[0]), fold_table()[1], strict=True))


def _ranges(codes: list[int]) -> str:
    """A Java character class of code points."""
    out, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\x{{{codes[i]:X}}}" if i == j else f"\\x{{{codes[i]:X}}}-\\x{{{codes[j]:X}}}")
        i = j + 1
    return "[" + "".join(out) + "]"


#: Blocks of common characters: Latin, Greek, Cyrillic, Hebrew, Arabic letters, punctuation, currency, kana, CJK, Hangul.
_COMMON = ((0x1, 0x2FF), (0x38E, 0x3FF), (0x400, 0x482), (0x48A, 0x52F), (0x5D0, 0x5EA), (0x620, 0x64A), (0x2002, 0x206F), (0x20A0, 0x20CF), (0x3001, 0x3029), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def _outside(codes: list[int]) -> str:
    """A Java character class of all but these."""
    return "[^" + _ranges(codes)[1:]


@lru_cache(1)
def maybe_unstable() -> str:
    """Characters that NFC changes or can join to others, and rare ones: a text without any is in NFC. Common characters
    that NFC leaves alone are listed instead, as a class of few ranges is quick to test."""
    second = set()
    for c in range(0xC0, 0x20000):
        if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4:
            second.update(unicodedata.normalize("NFD", chr(c))[1:])
    sure = lambda c: not unicodedata.combining(chr(c)) and chr(c) not in second and unicodedata.normalize("NFC", chr(c)) == chr(c)
    return _outside([c for a, b in _COMMON for c in range(a, b + 1) if sure(c)])


def needs_nfc(text: Column) -> Column:
    """Whether normalisation could change a text; never for ASCII, told by its length in bytes."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(maybe_unstable())


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@lru_cache(1)
def _unusual() -> str:
    """Characters of which Java's lower case isn't known to be the key: those below U+0250 whose key is not their lower
    case, and all from there on but punctuation, CJK and Hangul, as the two may be of different Unicode versions."""
    low = [c for c in range(1, 0x250) if chr(c).lower() == fold(chr(c))]
    return _outside([*low, *range(0x2000, 0x2070), *range(0x3000, 0xA000), *range(0xAC00, 0xD7B0)])


def fold_key(text: Column) -> Column:
    """Key of NFC text; pass other text through ``nfc`` first. Most texts are lowered; the table of all case pairs is for
    those that have others than Latin ones."""
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike(_unusual())
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, *fold_table()))


def icontains(text: Column, needle: str) -> Column:
    """Of NFC text. Null contains nothing."""
    return F.coalesce(F.contains(fold_key(text), F.lit(fold(needle))), F.lit(False))


@lru_cache(256)
def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def regexp(text: Column, pattern: str) -> Column:
    """Python's ``re.search`` over NFC text; null matches nothing."""
    search_ = compiled(pattern).search

    @F.pandas_udf("boolean")
    def search(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x is not None and search_(unicodedata.normalize("NFC", x)) is not None)

    return search(text)


@lru_cache(1)
def _diacritics() -> tuple[str, str]:
    """Letters that are a letter with marks, and that letter; then marks of Latin writing, which stand for nothing."""
    source, base = [], []
    for c in range(0xC0, 0x2000):
        if unicodedata.category(chr(c)) not in ("Ll", "Lo", "Lu", "Lt"):
            continue
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) > 1 and all(0x300 <= ord(m) <= 0x36F for m in parts[1:]):
            source.append(chr(c))
            base.append(parts[0])
    return "".join(source + [chr(c) for c in range(0x300, 0x332)]), "".join(base)


def bare(text: str) -> str:
    """Lower case without diacritics, as words are indexed."""
    source, base = _diacritics()
    table = {ord(c): base[i] if i < len(base) else None for i, c in enumerate(source)}
    return text.lower().translate(table)


def tokens(text: Column) -> Column:
    """The words of a text, lowered and without diacritics, in their order."""
    low = F.lower(text)
    plain = F.octet_length(text) == F.length(text)
    return F.filter(F.split(F.when(plain, low).otherwise(F.translate(low, *_diacritics())), WORD_BREAK), lambda x: x != "")


def words_of(text: str) -> tuple[str, ...]:
    """What ``tokens`` makes of a text, on the driver."""
    marks = lambda c: unicodedata.category(c)[0] in "LNM" or unicodedata.category(c) == "Co"
    return tuple("".join(c if marks(c) else " " for c in bare(text)).split())


def grams(text: Column, n: int = 3) -> Column:
    """All runs of n characters; shorter texts have none."""
    size = F.length(text) - (n - 1)
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def has_cjk(text: str) -> bool:
    return re.search(CJK, text) is not None


def cjk_pairs(text: Column) -> Column:
    """Pairs of neighbours in runs of CJK characters."""
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"({CJK}+)"), F.lit(1)), lambda run: grams(run, 2)))


def cjk_runs(text: str) -> list[list[str]]:
    """For each run of two CJK characters or more in a query, its pairs in order."""
    return [[run[i : i + 2] for i in range(len(run) - 1)] for run in re.findall(f"{CJK}+", text) if len(run) > 1]


def phrase(text: str) -> str:
    """A text as a quoted phrase of the query language."""
    return '"' + text.replace('"', '""') + '"'


def gram_phrase(needle: str) -> str | None:
    """The phrase that narrows a substring search by three-character grams; None where the needle has none."""
    key = fold(needle)
    return phrase(key) if len(key) >= 3 else None


def slug(text: Column) -> Column:
    """Letters and digits of ASCII, all else as single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


@F.pandas_udf(T.StringType())
def ascii_form(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without what is not ASCII, so that ``slug`` keeps base letters."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


@F.pandas_udf(T.StringType())
def spelling(s: pd.Series) -> pd.Series:
    """NFKC, case folded, punctuation as single blanks: spellings that count as one."""
    def one(x: str) -> str:
        folded = unicodedata.normalize("NFKC", x).casefold()
        return " ".join("".join(c if c.isalnum() or unicodedata.category(c)[0] == "M" else " " for c in folded).split())

    return s.map(lambda x: None if x is None else one(x))


@F.pandas_udf(T.StringType())
def flat_html(s: pd.Series) -> pd.Series:
    """The text of HTML: no tags, references resolved, blanks single, case folded."""
    import html

    return s.map(lambda x: None if x is None else " ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()).casefold())


def norm_lang(tag: Column) -> Column:
    return F.lower(F.replace(F.trim(tag), F.lit("_"), F.lit("-")))


def hidden(tag: Column, lang: Column) -> Column:
    """A tag is the language or one of its variants."""
    return (tag == lang) | F.startswith(tag, F.concat(lang, F.lit("-")))


def scoped(scope: str, code: Column) -> Column:
    return F.concat(F.lit(scope + "/"), code.cast("string"))


def scheme_of(scoped_id: Column) -> Column:
    """What stands before the first slash; an id without one has the empty scheme."""
    return F.when(F.contains(scoped_id, F.lit("/")), F.split_part(scoped_id, F.lit("/"), F.lit(1))).otherwise("")


def valid_scoped(value: Column) -> Column:
    return value.rlike(r"^(?:doc/.+|[a-z]+/[A-Za-z0-9][A-Za-z0-9._\-]*)$")


def like_ascii(text: Column, prefix: str) -> Column:
    """Whether a text begins with a prefix, ASCII letters in any case and no other."""
    head = F.substring(text, F.lit(1), F.lit(len(prefix)))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(head, upper, lower) == prefix.translate(str.maketrans(upper, lower))


def pointer(name: Column) -> Column:
    """A name as a step of a JSON pointer."""
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    import json

    return s.map(lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def megabytes(size: Column) -> Column:
    """A number of bytes to read: one decimal from a megabyte on, thousands otherwise; null is a question mark."""
    mb = F.format_string("%.1f MB", size / 1_000_000)
    return F.when(size.isNull(), "?").when(size >= 1_000_000, mb).when(size >= 1000, F.format_string("%.0f kB", size / 1000)).otherwise(F.concat(size.cast("string"), F.lit(" B")))


def fnv1a(text: Column) -> Column:
    """FNV-1a of 32 bits over UTF-16 code units below 256 each, as browsers count ASCII: an integer fold."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    mix = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), mix)
