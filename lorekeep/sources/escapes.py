"""Escapes of RDF's text formats, by the tables of their specifications: ECHAR and UCHAR."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the specification.
ECHAR = {r"\t": "\t", r"\b": "\b", r"\n": "\n", r"\r": "\r", r"\f": "\f", r"\"": '"', r"\'": "'", r"\\": "\\"}
UCHAR = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
_ANY = re.compile(rf"{UCHAR}|\\.?", re.S)


def _character(m: re.Match) -> str:
    escape = m[0]
    if len(escape) > 2:
        return chr(int(escape[2:], 16))
    if escape not in ECHAR:
        raise ValueError(f"{escape!r} is no escape")
    return ECHAR[escape]


def decoded(text: str) -> str:
    """The text that an escaped one stands for; an unknown escape is an error."""
    return _ANY.sub(_character, text) if "\\" in text else text


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else decoded(x))
