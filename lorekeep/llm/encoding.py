"""Exact tokenization with a memo: texts are cut where the tokenizer itself always cuts, and each distinct piece is
looked up once for many texts together, in a memo that a Python worker keeps. The memo is Arrow arrays: a known piece
costs its bytes and some 30 more, and is never a Python object."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces in a worker's memo, and the longest of them in code points. When it is full the half that was not asked for
#: longest is forgotten; that costs time for pieces that come back, and changes nothing.
MEMO_PIECES = 400_000
MEMO_LENGTH = 64
#: A search in the memo costs as much as tokenizing this share of its pieces: fewer pieces are tokenized without it.
MEMO_SHARE = 16
#: A piece enters the memo when it comes for the second time, as far as a table of this many marks can tell; when a
#: third of them are set, all are cleared.
MARKS = 1 << 22
#: Runs of symbols that a worker remembers.
KNOWN_SYMBOLS = 50_000
#: The name of the space in byte-level vocabularies.
_SPACE_NAME = "\u0120"
#: Characters of a text that are worked on at once.
SEGMENT = 1 << 20
#: Bytes of texts that are cut into pieces together.
TOGETHER_BYTES = 4 << 20
#: Stand at the start and the end of a text, so that its first piece is known and the end id is a piece of its own.
_FIRST, _LAST = "\x00", "\x01"
#: White space that is neither a space nor a line feed, and white space that stands together.
_OTHER_BLANKS = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
_ASCII_BLANKS = "".join(filter(str.isascii, _OTHER_BLANKS))
_TOGETHER = ("  ", " \n", "\n ", "\n\n")
#: Where any text can be cut: before one white space between two visible ASCII characters.
_CUT = re.compile(r"(?<=[!-~])[ \n](?=[!-~])")
_BLANK = re.compile(r"[ \t-\r]")
_SPACE = re.compile(" ")
#: Latin letters, and ASCII symbols that follow them: two pre-tokens for every tokenizer here.
_PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")
_END = array("I", [0]).tobytes()
_encoders: dict[tuple[str, bool, bool], Encoder] = {}


def encoder(path: str, word_level: bool, special_as_text: bool = False) -> Encoder:
    """One encoder for each file, settings and worker process."""
    key = (path, word_level, special_as_text)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def _byte_names() -> dict[int, str]:
    """The characters by which byte-level vocabularies name bytes: visible ones themselves, the others from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


def _lists(raw: list[bytes]) -> pa.Array:
    """Ids as lists."""
    ends = np.cumsum([0, *(len(r) // 4 for r in raw)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def _even(text: str) -> bool:
    if not text:
        return True
    others = _ASCII_BLANKS if text.isascii() else _OTHER_BLANKS
    return not (text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _TOGETHER) or any(x in text for x in others))


class Encoder:
    """ids(text): the ids of a text and an end id 0, as little-endian unsigned 32-bit integers.

    word_level: the tokenizer drops white space and ignores case, so the words of a text are independent. A byte-level
    tokenizer attaches one space to the word that follows, and a line feed is a token of its own: a text whose white
    space is single spaces and single line feeds splits before each. Other texts go to the tokenizer whole, or cut where
    that is safe. A piece of plain letters and symbols goes to the tokenizer's model directly.

    The special tokens of the file are recognised in a text, as the tokenizer does by default: what is before and after
    one is encoded by itself. special_as_text: their strings are ordinary text."""

    def __init__(self, path: str, word_level: bool, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.tokenize, self.names = self.tokenizer.model.tokenize, _byte_names()
        #: What byte-level vocabularies call the letters of _PLAIN.
        self.letters = {c: chr(c).encode().decode("latin-1").translate(self.names) for c in range(0xC0, 0x250)}
        self.word_level = word_level
        #: The memo: pieces, their ids, and the number of the search that last found each.
        self.keys, self.known = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))
        self.used, self.searches = np.zeros(0, np.int64), 0
        self.symbols: dict[str, bytes] = {"": b""}
        self.seen, self.n_seen = np.zeros(MARKS, bool), 0
        self.line_feed = self._encode(["\n"])[0]
        added = [] if special_as_text else [*self.tokenizer.get_added_tokens_decoder().items()]
        #: A token that takes the blanks about it, or is sought in normalised text, forbids any cut.
        self.uncut = any(t.lstrip or t.rstrip or t.single_word or t.normalized for _, t in added)
        self.special = {t.content: array("I", [i]).tobytes() for i, t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        odd = [re.escape(_FIRST), re.escape(_LAST), *map(re.escape, self.special)]
        if not word_level:
            odd += [r"^[ \n]", r"[ \n]$", r"[ \n][ \n]", f"[{re.escape(_OTHER_BLANKS)}]"]
        #: In RE2's syntax: texts that are encoded one by one.
        self.odd = "|".join(odd)
        self.special_cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, pre_token: str) -> bytes:
        if not pre_token.isascii():
            pre_token = pre_token.encode().decode("latin-1").translate(self.names)
        return array("I", [t.id for t in self.tokenize(pre_token)]).tobytes()

    def _word(self, letters: str, lead: str) -> bytes:
        """Ids of letters alone, after a space or after nothing."""
        if not letters.isascii():
            letters = letters.translate(self.letters)
        return array("I", [t.id for t in self.tokenize(_SPACE_NAME + letters if lead else letters)]).tobytes()

    def _plain(self, piece: str) -> bytes | None:
        """The ids of a piece of plain letters and symbols; None for any other piece."""
        if self.word_level:
            text, head, lead = piece.lower(), b"", ""
        elif piece[:1] == "\n":
            text, head, lead = piece[1:], self.line_feed, ""
        else:
            text, head, lead = piece, b"", " "
        m = _PLAIN.fullmatch(text)
        if m is None:
            return None
        letters, symbols = m.groups()
        if not symbols:
            return head + self._word(letters, lead)
        first = head + self._word(letters, lead)
        end = self.symbols.get(symbols)
        if end is None:
            if len(self.symbols) >= KNOWN_SYMBOLS:
                self.symbols.clear()
            end = self.symbols[symbols] = self._model(symbols)
        return first + end

    def _anew(self, names: list[str]) -> list[bytes]:
        """The ids of pieces from the tokenizer."""
        out, others = [], []
        tokenize, lead, plain = self.tokenize, "" if self.word_level else _SPACE_NAME, self._plain
        for k, name in enumerate(names):
            if name.isascii() and name.isalpha():
                out.append(array("I", [t.id for t in tokenize(lead + name)]).tobytes())
            else:
                out.append(_END if name == _LAST else plain(name))
                if out[k] is None:
                    others.append(k)
        for k, raw in zip(others, self._encode([self._as_text(names[k]) for k in others]), strict=True):
            out[k] = raw
        return out

    def _look_up(self, pieces: pa.Array) -> pa.Array:
        """The ids of distinct pieces, as lists, from the memo or anew."""
        if len(pieces) * MEMO_SHARE < len(self.keys):
            return _lists(self._anew(pieces.to_pylist()))
        at = pc.index_in(pieces, value_set=self.keys)
        self.searches += 1
        self.used[np.asarray(at.drop_null())] = self.searches
        new = np.flatnonzero(np.asarray(at.is_null()))
        names = pieces.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist()
        found = _lists(self._anew(names))
        place = np.array(at.fill_null(0))
        place[new] = np.arange(len(self.keys), len(self.keys) + len(new), dtype=np.int32)
        out = pa.concat_arrays([self.known, found]).take(pa.array(place))
        self._remember(names, found)
        return out

    def _remember(self, names: list[str], found: pa.Array) -> None:
        """Pieces that came before enter the memo."""
        marks = np.fromiter(map(hash, names), np.int64, len(names)) % MARKS
        again = self.seen[marks]
        self.seen[marks] = True
        self.n_seen += len(names) - int(again.sum())
        if self.n_seen > MARKS // 3:
            self.seen[:], self.n_seen = False, 0
        enter = np.flatnonzero(again & (np.fromiter(map(len, names), np.int64, len(names)) <= MEMO_LENGTH))[: MEMO_PIECES // 2]
        if len(self.keys) + len(enter) > MEMO_PIECES:
            keep = pa.array(np.sort(np.argsort(self.used)[len(self.used) - MEMO_PIECES // 2 :]))
            self.keys, self.known, self.used = self.keys.take(keep), self.known.take(keep), self.used[keep]
        self.keys = pa.concat_arrays([self.keys, pa.array([names[i] for i in enter], pa.string())])
        self.known = pa.concat_arrays([self.known, found.take(pa.array(enter))])
        self.used = np.concatenate([self.used, np.full(len(enter), self.searches)])

    def _as_text(self, piece: str) -> str:
        if piece[:1] == _FIRST:
            return piece[1:]
        return piece if self.word_level or piece[:1] == "\n" else " " + piece

    def _segments(self, text: str) -> Iterator[list]:
        """The pieces of a text, a bounded part of it at a time."""
        if not self.word_level:
            text = text.replace("\n", " \n")
        blank, i = _BLANK if self.word_level else _SPACE, 0
        while i < len(text):
            m = blank.search(text, i + SEGMENT)
            j = m.start() if m else len(text)
            yield [x.decode() for x in text[i:j].encode().lower().split()] if self.word_level else text[i:j].split(" ")
            i = j if self.word_level else j + 1

    def _whole(self, text: str) -> bytes:
        out, i = [], 0
        while i < len(text):
            m = _CUT.search(text, i + SEGMENT)
            j = m.start() if m else len(text)
            out += self._encode([text[i:j]])
            i = j
        return b"".join(out)

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        if self.uncut:
            return self._encode([text])[0] + _END
        if any(x in text for x in self.special):
            return b"".join(self.special.get(part) or self._ordinary(part) for part in self.special_cut.split(text)) + _END
        return self._ordinary(text) + _END

    def parts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """ids() of a bounded part of the texts at a time, one after the other, and where each begins, with the end."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        sizes = np.asarray(pc.binary_length(texts))
        i = 0
        while i < len(texts):
            j = i + max(1, int(np.searchsorted(np.cumsum(sizes[i:]), TOGETHER_BYTES, side="right")))
            part = texts[i:j]
            yield self._one_by_one(part) if self.uncut or sizes[i] > TOGETHER_BYTES else self._together(part)
            pa.default_memory_pool().release_unused()  # else workers keep the most they ever held
            i = j

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids() of all texts, one after the other, and where each begins, with the end."""
        ids, lengths = [], []
        for part, begins in self.parts(texts):
            ids.append(part)
            lengths.append(np.diff(begins))
        ends = np.cumsum(np.concatenate([[0], *lengths])).astype(np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), ends

    def _one_by_one(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = [self.ids(t.as_py()) for t in texts]
        return np.frombuffer(b"".join(raw), "<i4"), np.cumsum([0, *(len(r) // 4 for r in raw)])

    def _together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct piece of the texts is looked up once, and its ids are taken as often as it stands there."""
        odd = pc.match_substring_regex(texts, self.odd)
        apart, whole = np.flatnonzero(np.asarray(odd)), texts
        if len(apart):
            texts = pc.if_else(odd, "", texts)
        if self.word_level:
            cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.binary_join_element_wise(texts, _LAST, " ")))
        else:
            cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(_FIRST, texts, " ", _LAST, ""), "\n", " \n"), " ")
        pieces, offsets = cut.flatten().dictionary_encode(), np.array(cut.offsets)
        del cut
        taken = self._look_up(pieces.dictionary).take(pieces.indices)
        ids, begins = np.asarray(taken.values), np.asarray(taken.offsets)[offsets - offsets[0]].astype(np.int64)
        if not len(apart):
            return ids, begins
        parts, lengths, k = [], np.diff(begins), 0
        for i in apart:
            own = np.frombuffer(self.ids(whole[int(i)].as_py()), "<i4")
            parts += [ids[begins[k] : begins[i]], own]
            lengths[i], k = len(own), i + 1
        return np.concatenate([*parts, ids[begins[k] :]]), np.cumsum(np.concatenate([[0], lengths]))

    def _ordinary(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if _FIRST in text or _LAST in text or (not self.word_level and not _even(text)):
            return self._whole(text)
        out = []
        for pieces in self._segments(text):
            if not self.word_level and not out:  # nothing stands before the first word
                out += self._encode(pieces[:1])
                pieces = pieces[1:]
            each = pa.array(pieces, pa.string()).dictionary_encode()
            out.append(np.asarray(self._look_up(each.dictionary).take(each.indices).flatten()).tobytes())
        return b"".join(out)
