"""Turtle by the productions of its grammar: a method for each, which reads the terminals it allows where it stands."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from lorekeep.sources.escapes import UCHAR, decoded

RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
Term = tuple[str, bool, str | None, str | None]
Triple = tuple[str, str, str, bool, str | None, str | None]

# Fixed values of the specification: the terminals that have names there, in its order.
_PN_CHARS_BASE = (
    "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02ff\u0370-\u037d\u037f-\u1fff\u200c-\u200d\u2070-\u218f"
    "\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U000effff"
)
_PN_CHARS_U = _PN_CHARS_BASE + "_"
_PN_CHARS = _PN_CHARS_U + "\\-0-9\u00b7\u0300-\u036f\u203f-\u2040"
_PLX = r"%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?#@%]"
_PN_PREFIX = f"[{_PN_CHARS_BASE}](?:[{_PN_CHARS}.]*[{_PN_CHARS}])?"
_PN_LOCAL = f"(?:[{_PN_CHARS_U}:0-9]|{_PLX})(?:(?:[{_PN_CHARS}.:]|{_PLX})*(?:[{_PN_CHARS}:]|{_PLX}))?"
_IN_STRING = rf"\\[tbnrf\"'\\]|{UCHAR}"
IRIREF = re.compile(rf"<((?:[^\x00-\x20<>\"{{}}|^`\\]|{UCHAR})*)>")
PNAME_NS = re.compile(f"({_PN_PREFIX})?:")
PNAME_LN = re.compile(f"({_PN_PREFIX})?:({_PN_LOCAL})?")
BLANK_NODE_LABEL = re.compile(f"_:([{_PN_CHARS_U}0-9](?:[{_PN_CHARS}.]*[{_PN_CHARS}])?)")
LANGTAG = re.compile("@([A-Za-z]+(?:-[A-Za-z0-9]+)*)")
NUMERIC = (
    (re.compile(r"[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)[eE][+-]?[0-9]+"), XSD + "double"),
    (re.compile(r"[+-]?[0-9]*\.[0-9]+"), XSD + "decimal"),
    (re.compile(r"[+-]?[0-9]+"), XSD + "integer"),
)
STRINGS = tuple(
    re.compile(p)
    for p in (
        rf'"""((?:"{{0,2}}(?:[^"\\]|{_IN_STRING}))*)"""',
        rf"'''((?:'{{0,2}}(?:[^'\\]|{_IN_STRING}))*)'''",
        rf'"((?:[^"\\\n\r]|{_IN_STRING})*)"',
        rf"'((?:[^'\\\n\r]|{_IN_STRING})*)'",
    )
)
BOOLEAN = re.compile(r"(true|false)(?![\w:-])")
_WS = re.compile(r"(?:[ \t\r\n]|#[^\r\n]*)*")
_DIRECTIVE = re.compile(r"@(prefix|base)\b|(prefix|base)(?=[ \t\r\n#<])", re.I)
_A = re.compile(r"a(?=[ \t\r\n#<\"'\[(_])")


class Turtle:
    """The triples of one document."""

    def __init__(self, text: str, doc: str, base: str = ""):
        self.text, self.doc, self.base, self.at = text, doc, base, 0
        self.prefixes: dict[str, str] = {}
        self.triples: list[Triple] = []
        self.made = 0

    def parse(self) -> list[Triple]:
        while not self._end():
            self._statement()
        return self.triples

    # Reading

    def _space(self) -> None:
        self.at = _WS.match(self.text, self.at).end()

    def _end(self) -> bool:
        self._space()
        return self.at == len(self.text)

    def _sees(self, mark: str) -> bool:
        self._space()
        return self.text.startswith(mark, self.at)

    def _read(self, terminal: re.Pattern) -> re.Match | None:
        self._space()
        m = terminal.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def _mark(self, mark: str) -> bool:
        if not self._sees(mark):
            return False
        self.at += len(mark)
        return True

    def _must(self, mark: str) -> None:
        if not self._mark(mark):
            self._fail(f"{mark!r}")

    def _fail(self, wanted: str):
        line = self.text.count("\n", 0, self.at) + 1
        raise ValueError(f"{self.doc}, line {line}: {wanted} expected at {self.text[self.at : self.at + 30]!r}")

    def _node(self) -> str:
        self.made += 1
        return f"_:{self.doc}:b{self.made}"

    # Productions

    def _statement(self) -> None:
        if m := self._read(_DIRECTIVE):
            self._directive((m[1] or m[2]).lower())
            if m[1]:
                self._must(".")
            return
        if self._sees("[") and not self._anon_next():
            subject = self._blank_node_property_list()
            if not self._sees("."):
                self._predicate_object_list(subject)
        else:
            self._predicate_object_list(self._subject())
        self._must(".")

    def _directive(self, word: str) -> None:
        if word == "prefix":
            name = self._read(PNAME_NS) or self._fail("a prefix")
            self.prefixes[name[1] or ""] = self._iri() or self._fail("an IRI")
        else:
            self.base = self._iri() or self._fail("an IRI")

    def _anon_next(self) -> bool:
        return bool(re.compile(r"\[(?:[ \t\r\n]|#[^\r\n]*)*\]").match(self.text, self.at))

    def _subject(self) -> str:
        found = self._iri() or self._blank_node()
        if found is None and self._sees("("):
            found = self._collection()
        return found or self._fail("a subject")

    def _predicate_object_list(self, subject: str) -> None:
        self._verb_and_objects(subject)
        while self._mark(";"):
            if not any(map(self._sees, (";", ".", "]"))):
                self._verb_and_objects(subject)

    def _verb_and_objects(self, subject: str) -> None:
        verb = RDF + "type" if self._read(_A) else self._iri()
        if verb is None:
            self._fail("a predicate")
        self.triples.append((subject, verb, *self._object()))
        while self._mark(","):
            self.triples.append((subject, verb, *self._object()))

    def _object(self) -> Term:
        if literal := self._literal():
            return literal
        node = self._iri() or self._blank_node()
        if node is None and self._sees("["):
            node = self._blank_node_property_list()
        elif node is None and self._sees("("):
            node = self._collection()
        return (node or self._fail("an object"), False, None, None)

    def _literal(self) -> Term | None:
        for terminal in STRINGS:
            if m := self._read(terminal):
                text = decoded(m[1])
                if tag := self._read(LANGTAG):
                    return text, True, tag[1].lower(), None
                if self._mark("^^"):
                    return text, True, None, self._iri() or self._fail("a datatype")
                return text, True, None, None
        for terminal, datatype in NUMERIC:
            if m := self._read(terminal):
                return m[0], True, None, datatype
        if m := self._read(BOOLEAN):
            return m[0], True, None, XSD + "boolean"
        return None

    def _blank_node_property_list(self) -> str:
        self._must("[")
        node = self._node()
        if not self._sees("]"):
            self._predicate_object_list(node)
        self._must("]")
        return node

    def _collection(self) -> str:
        self._must("(")
        first = before = RDF + "nil"
        while not self._mark(")"):
            cell, item = self._node(), self._object()
            if before == RDF + "nil":
                first = cell
            else:
                self.triples.append((before, RDF + "rest", cell, False, None, None))
            self.triples.append((cell, RDF + "first", *item))
            before = cell
        if before != RDF + "nil":
            self.triples.append((before, RDF + "rest", RDF + "nil", False, None, None))
        return first

    def _iri(self) -> str | None:
        if m := self._read(IRIREF):
            return urljoin(self.base, decoded(m[1])) if self.base else decoded(m[1])
        self._space()
        if self.text.startswith("_:", self.at):
            return None
        if m := self._read(PNAME_LN):
            if (m[1] or "") not in self.prefixes:
                raise ValueError(f"{self.doc}: unknown prefix {m[1] or ''!r}")
            return self.prefixes[m[1] or ""] + re.sub(r"\\(.)", r"\1", m[2] or "")
        return None

    def _blank_node(self) -> str | None:
        if m := self._read(BLANK_NODE_LABEL):
            return f"_:{self.doc}:{m[1]}"
        self._space()
        if self._sees("[") and self._anon_next():
            self.at = self.text.index("]", self.at) + 1
            return self._node()
        return None
