"""The full-text query language, as its public documentation gives it:

    query  = either { OR either } ;  either = both { AND both } ;  both = unit { NOT unit }
    unit   = [ columns : ] ( "(" query ")" | NEAR "(" phrase+ [ , k ] ")" | phrase ) ; units side by side are ANDed
    phrase = string { + string } [ * ] ;  columns = [ - ] ( name | { name+ } )

A phrase that ends in * matches words with its last word as a prefix; ^ before it asks for the beginning of a column.
What doesn't parse is read as quoted words that must all occur, and a note says so."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from lorekeep.functions.text import words_of

_STRING = re.compile(r'"((?:[^"]|"")*)"|([^\s"():{}+*^,\-]+)')
_SPACE = re.compile(r"\s*")
_NUMBER = re.compile(r"\d+")


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """kind: phrase (words, prefix, first), near (parts, distance), and, or, not (the second of two). columns limits a
    phrase or near to columns; None is all."""

    kind: str
    words: tuple[str, ...] = ()
    parts: tuple[Node, ...] = ()
    distance: int = 10
    prefix: bool = False
    first: bool = False
    columns: tuple[str, ...] | None = None


class _Parser:
    def __init__(self, text: str, columns: tuple[str, ...]):
        self.text, self.columns, self.at = text, columns, 0

    def space(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()

    def sees(self, mark: str) -> bool:
        self.space()
        return self.text.startswith(mark, self.at)

    def takes(self, mark: str) -> bool:
        if self.sees(mark):
            self.at += len(mark)
            return True
        return False

    def sees_word(self, word: str) -> bool:
        self.space()
        m = _STRING.match(self.text, self.at)
        return bool(m) and m[2] == word

    def takes_word(self, word: str) -> bool:
        if self.sees_word(word):
            self.at += len(word)
            return True
        return False

    def done(self) -> bool:
        self.space()
        return self.at == len(self.text)

    def query(self) -> Node:
        out = self.either()
        while self.takes_word("OR"):
            out = Node("or", parts=(out, self.either()))
        return out

    def either(self) -> Node:
        out = self.both()
        while not (self.done() or self.sees(")") or self.sees_word("OR")):
            self.takes_word("AND")
            out = Node("and", parts=(out, self.both()))
        return out

    def both(self) -> Node:
        out = self.unit()
        while self.takes_word("NOT"):
            out = Node("not", parts=(out, self.unit()))
        return out

    def unit(self) -> Node:
        only = self.column_filter()
        if self.takes("("):
            inner = self.query()
            if not self.takes(")"):
                raise QueryError("unclosed")
        elif self.sees_word("NEAR") and self.text[self.at + 4 : self.at + 5] == "(":
            inner = self.near()
        else:
            inner = self.phrase()
        return inner if only is None else limited(inner, only)

    def column_filter(self) -> tuple[str, ...] | None:
        self.space()
        start, inverse = self.at, self.takes("-")
        names = []
        if self.takes("{"):
            while not self.takes("}"):
                names.append(self.string()[1])
        elif (m := _STRING.match(self.text, self.at)) and re.match(r"\s*:", self.text[m.end() :]):
            names.append(self.string()[1])
        if not names or not self.takes(":"):
            if inverse or names:
                raise QueryError("no column filter")
            self.at = start
            return None
        lowered = {c.lower(): c for c in self.columns}
        unknown = [n for n in names if n.lower() not in lowered]
        if unknown:
            raise QueryError(f"no such column: {unknown[0]}")
        found = tuple(lowered[n.lower()] for n in names)
        return tuple(c for c in self.columns if c not in found) if inverse else found

    def string(self) -> tuple[bool, str]:
        """Whether it was quoted, and the text."""
        self.space()
        m = _STRING.match(self.text, self.at)
        if not m:
            raise QueryError(self.text[self.at :][:20] or "end")
        self.at = m.end()
        return m[1] is not None, m[1].replace('""', '"') if m[1] is not None else m[2]

    def phrase(self) -> Node:
        first, words = self.takes("^"), []
        while True:
            quoted, text = self.string()
            if not quoted:
                if text in ("AND", "OR", "NOT"):
                    raise QueryError(text)
                if len(words_of(text)) != 1 or re.search(r"[\x00-\x7f]", re.sub(r"[A-Za-z0-9_\x1a]", "", text)):
                    raise QueryError(text)
            words += words_of(text)
            if not self.takes("+"):
                break
        prefix = self.takes("*")
        if not words:
            raise QueryError("no words")
        return Node("phrase", tuple(words), prefix=prefix, first=first)

    def near(self) -> Node:
        self.at += 5
        parts, distance = [], 10
        while not self.takes(")"):
            if self.takes(","):
                self.space()
                m = _NUMBER.match(self.text, self.at)
                if not m:
                    raise QueryError("NEAR without a number")
                distance, self.at = int(m[0]), m.end()
                continue
            parts.append(self.phrase())
        if not parts:
            raise QueryError("empty NEAR")
        return Node("near", parts=tuple(parts), distance=distance)


def limited(node: Node, columns: tuple[str, ...]) -> Node:
    """A node whose phrases look into some columns only."""
    if node.kind in ("phrase", "near"):
        own = columns if node.columns is None else tuple(c for c in node.columns if c in columns)
        return replace(node, columns=own, parts=tuple(limited(p, columns) for p in node.parts))
    return replace(node, parts=tuple(limited(p, columns) for p in node.parts))


def parse(text: str, columns: tuple[str, ...] = ()) -> tuple[Node, str | None]:
    """The query, and a note where it had to be read as plain words."""
    try:
        p = _Parser(text, columns)
        out = p.query()
        if not p.done():
            raise QueryError(text[p.at :])
        return out, None
    except QueryError:
        phrases = [Node("phrase", w) for x in text.split() if (w := words_of(x))]
        if not phrases:
            raise ValueError("the query has no words") from None
        out = phrases[0]
        for x in phrases[1:]:
            out = Node("and", parts=(out, x))
        return out, "not a query: its words are looked for"


def phrases(node: Node) -> list[Node]:
    """The phrases that count for ranking: all but those that must not occur."""
    if node.kind == "phrase":
        return [node]
    parts = node.parts[:1] if node.kind == "not" else node.parts
    return list(dict.fromkeys(x for p in parts for x in phrases(p)))
