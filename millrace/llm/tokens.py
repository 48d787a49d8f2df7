"""Token ids from a public tokenizer file, with a bounded memo of words.

The pre-tokenizers of both vocabularies always begin a new piece at a space that is followed by anything but
white space, so a text is cut there and each piece encoded on its own; pieces repeat, and a memo answers the
repeats. What the memo lacks goes to the tokenizers library.
"""

from __future__ import annotations

import os
import re
from codecs import charmap_decode
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of the newer and of the older half of a worker's memo; some 200 MB in all. When the newer half is full it becomes
#: the older one, from which words that are met again are taken over.
MEMO_PIECES = 550_000
#: Words of a worker's memo in Arrow; some 40 MB.
MEMO_WORDS = 1_000_000
#: Pieces that both pre-tokenizers make: runs of letters, runs of marks (no apostrophe), a line's end.
_PARTS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,;:!?%&*#$()\"/=+-]+|\n").findall
_CUT = re.compile(r"(?= \S)")
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_MARKS = '.,;:!?%&*#$()"/=+-'
_ALL_LETTERS = re.compile(_LETTERS).fullmatch
_FIRST = re.compile(r"[^ \n]*").match


def _pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return pack(_FORMATS[len(ids)] if len(ids) < len(_FORMATS) else f"<{len(ids)}I", *ids)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_FORMATS = [f"<{n}I" for n in range(64)]


class _Odd(Exception):
    """A space is followed by white space, or by nothing."""


class Encoder(dict):
    """word -> the ids of a space and the word, as little-endian unsigned 32-bit integers.

    ``lower`` tells that the vocabulary is lower-case and drops white space.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.older: dict[str, bytes] = {}
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = "".join(_byte_letters()[b] for b in range(256))
        self.lower = self._ids("A") == self._ids("a") and not self._ids(" ")
        self.space = "" if self.lower else self.letters[32]
        self.inner: dict[str, bytes] = {}  # pieces that no space stands before
        self.words, self.sizes, self.flat = pa.array([], pa.large_string()), np.empty(0, "int64"), np.empty(0, "<u4")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bare(self, part: str) -> bytes:
        """The ids of one piece as the pre-tokenizer makes it: letters, marks, or a line's end, perhaps after a space."""
        if self.lower:
            part = part.strip().lower()
            if not part:
                return b""
        mapped, _ = charmap_decode(part.encode(), "strict", self.letters)
        return _pack([t.id for t in self.tokenize(mapped)])

    def _inside(self, part: str) -> bytes:
        if len(self.inner) >= MEMO_PIECES // 4:
            self.inner.clear()
        packed = self.inner[part] = self._bare(part)
        return packed

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            if word.isascii() and word.isalpha():
                packed = _pack([t.id for t in self.tokenize(self.space + (word.lower() if self.lower else word))])
            elif not word or word[0].isspace():
                raise _Odd
            else:
                packed = self._mixed(word)
        if len(self) >= MEMO_PIECES:
            self.older = dict(self)
            self.clear()
        if len(word) <= 40:
            self[word] = packed
        return packed

    def _mixed(self, word: str) -> bytes:
        parts = _PARTS(word)
        if sum(map(len, parts)) != len(word) or "\n\n" in word:
            return _pack(self._ids(" " + word))
        if len(parts) == 1:
            return self._bare(" " + word)
        return self[parts[0]] + b"".join([self.inner.get(p) or self._inside(p) for p in parts[1:]])

    def _piece(self, piece: str) -> bytes:
        return _pack(self._ids(piece))

    def packed(self, text: str | None, end: int | None = 0) -> bytes:
        """The ids of ``text`` (null: empty), then ``end``."""
        tail = b"" if end is None else _pack([end])
        if not text:
            return tail
        first, *words = text.split(" ")
        try:
            return self._piece(first) + b"".join(map(self.__getitem__, words)) + tail
        except _Odd:
            first, *words = _CUT.split(text)
            simple = [self[w[1:]] if len(w) > 1 and not any(map(str.isspace, w[1:])) else self._piece(w) for w in words]
            return self._piece(first) + b"".join(simple) + tail

    def packed_each(self, texts: list[str | None], end: int | None = 0) -> Iterator[bytes]:
        """``packed`` of each text in turn, where a word that these texts have many times is looked up once: texts are cut at spaces and
        before lines' ends, their different words numbered in Arrow, and ids gathered by those numbers."""
        tail = b"" if end is None else _pack([end])
        cut = pc.split_pattern(pc.replace_substring(pa.array([x or "" for x in texts], pa.large_string()), "\n", " \n"), " ")
        numbered = cut.flatten().dictionary_encode()
        ids, size = self._looked_up(numbered.dictionary)
        begin, number, cuts = np.cumsum(size) - size, numbered.indices.to_numpy(), cut.offsets.to_pylist()
        for text, a, b in zip(texts, cuts, cuts[1:], strict=False):
            words = number[a + 1 : b]
            each = size[words]
            first = _FIRST(text or "")[0]
            if not text or not each.all() or "\n\n" in text or first[-1:].isspace():  # white space beside white space
                yield self.packed(text, end)
                continue
            yield self._piece(first) + ids[_stretches(begin[words], each)].tobytes() + tail

    def _looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words one after the other, each with the space before it, and how many each has: none where the word
        can't be told from its neighbours. Marks that follow letters are looked up on their own."""
        bare = pc.utf8_rtrim(words, characters=_MARKS)
        units = pc.if_else(pc.match_substring_regex(bare, rf"^\n?{_LETTERS}$"), bare, words)
        marked = np.flatnonzero(pc.not_equal(pc.binary_length(units), pc.binary_length(words)).to_numpy(zero_copy_only=False))
        marks = pc.replace_substring_regex(words.take(pa.array(marked)), rf"^\n?{_LETTERS}", "").dictionary_encode()
        units = units.dictionary_encode()
        place = pc.index_in(units.dictionary, self.words)
        new = units.dictionary.filter(place.is_null())
        place = place.fill_null(-1).to_numpy().copy()
        place[place < 0] = np.arange(len(self.words), len(self.words) + len(new))
        made = [self._unit(w) for w in new.to_numpy(zero_copy_only=False).tolist()]
        self._add(new, made)
        ends = [self.inner.get(m) or self._inside(m) for m in marks.dictionary.to_pylist()]
        end_size = _sizes(ends)
        own = place[units.indices.to_numpy()]
        begins, sizes = np.zeros((len(words), 2), "int64"), np.zeros((len(words), 2), "int64")
        begins[:, 0], sizes[:, 0] = (np.cumsum(self.sizes) - self.sizes)[own], self.sizes[own]
        which = marks.indices.to_numpy()
        begins[marked, 1], sizes[marked, 1] = (len(self.flat) + np.cumsum(end_size) - end_size)[which], end_size[which]
        ids = np.concatenate([self.flat, np.frombuffer(b"".join(ends), "<u4")])[_stretches(begins.ravel(), sizes.ravel())]
        if len(self.words) > MEMO_WORDS:  # those met last stay
            flat = self.flat[_stretches((np.cumsum(self.sizes) - self.sizes)[place], self.sizes[place])]
            self.words, self.sizes, self.flat = units.dictionary, self.sizes[place], flat
        return ids, sizes.sum(1)

    def _add(self, new: pa.Array, made: list[bytes]) -> None:
        self.words = pa.concat_arrays([self.words, new])
        self.sizes = np.concatenate([self.sizes, _sizes(made)])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(made), "<u4")])

    def _unit(self, word: str) -> bytes:
        """The ids of a word after a space, or of a line's end and what follows it; none beside other white space."""
        if word == "\n":
            return self.inner.get(word) or self._inside(word)
        if not word or word[-1].isspace() or (word[0].isspace() and word[0] != "\n"):
            return b""
        if word[0] == "\n":
            return self._unit("\n") + self._bare(word[1:]) if _ALL_LETTERS(word[1:]) else self._piece(word)
        return self._bare(" " + word) if _ALL_LETTERS(word) else self._mixed(word)


def _sizes(packed: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, packed), "int64", len(packed)) // 4


def _stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of stretches, one after the other."""
    places = np.repeat(begin - np.cumsum(size) + size, size)
    places += np.arange(len(places))
    return places


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of the vocabulary file at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
