"""Token ids of whole texts by a tokenizers file, with a memory for words that recur."""

from __future__ import annotations

import functools
import operator
import os
import re
from array import array

import numpy as np

#: Characters that no token rule treats by what stands around them: a chunk that begins so can be encoded by itself.
_STARTS = "!-~¡-˿Ͱ-҂Ҋ-Ֆא-תぁ-ゖァ-ヺ一-鿿가-힣"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: The rules by which the two kinds of vocabulary part words, for texts of these letters and of ASCII.
_JOINED = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+"
_PLAIN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+"
#: Signs that make a piece of their own after a word, and of which one follows it often.
_SIGNS = frozenset(",.;:!?")
_KNOWN = re.compile(rf"[!-~{_LETTER}][\n -~{_LETTER}]*")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class _Odd(Exception):
    """A chunk whose ids may depend on what stands before it."""


class _Memo(dict):
    """Answers by key, made when first asked for and kept when asked for again: most words of a corpus never come back, and a
    bit by hash tells which may have. When it is full the answers become the former ones, of which those still asked for
    return; so at most twice the limit is held, and words that recur stay."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.former, self.seen = make, limit, {}, bytearray(1 << 22)

    def __missing__(self, key: str) -> bytes:
        value = self.former.get(key) if self.former else None
        if value is None:
            value = self.make(key)
            place = hash(key) & 4194303
            if not self.seen[place] or len(key) > 24:
                self.seen[place] = 1
                return value
        if len(self) >= self.limit:
            self.former = dict(self)
            self.clear()
            self.seen = bytearray(1 << 22)
        self[key] = value
        return value


_id = operator.attrgetter("id")


class Encoder:
    """Encodes like Tokenizer.encode(text, add_special_tokens=False): control strings of the vocabulary in a text become
    their ids. With literal they are ordinary text, as they should be where nobody may forge them.

    joined: a token may begin with the space before a word (byte-level vocabularies); otherwise case and white space
    are dropped. Either way no token crosses the gap before a space that a visible character follows, so the ids of a
    text are those of its chunks in a row. Chunks of Latin letters and ASCII go to the vocabulary's merges word by
    word, others to the whole tokenizer; texts in which a space is followed by anything unusual, and those that hold a
    control string, are encoded whole. limit bounds the words remembered.
    """

    def __init__(self, path: str, joined: bool, literal: bool = False, limit: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = literal
        added = [] if literal else list(self._tokenizer.get_added_tokens_decoder().values())
        self._controls = [t.content for t in added]
        # those that are looked for in normalised text could hide in any spelling
        self._apart = not any(t.normalized for t in added)
        self._model = self._tokenizer.model
        self._joined = joined
        self._words = re.compile(_JOINED if joined else _PLAIN).findall
        self._word = re.compile(f"[{_LETTER}]{{1,64}}$").match
        self._letters = _byte_letters()
        self._space = self._letters[32]
        self._start = re.compile(f"[{_STARTS}]").match
        self._others = _Memo(self._merged, limit)
        self._chunks = _Memo(self._chunk, limit)

    def whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _ids(self, piece: str) -> bytes:
        return array("I", map(_id, self._model.tokenize(piece))).tobytes()

    def _merged(self, piece: str) -> bytes:
        return self._ids(piece.replace(" ", self._space) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self._letters))

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() and len(chunk) <= 64:
            if chunk.isascii():
                return self._ids(self._space + chunk if self._joined else chunk.lower())
            if self._word(chunk):
                return self._merged(" " + chunk if self._joined else chunk.lower())
        if not chunk and not self._joined:
            return b""
        body, sign = chunk[:-1], chunk[-1:]
        if sign in _SIGNS and body.isascii() and body.isalpha():
            return self._chunks[body] + self._others[sign]
        if sign.isalpha() and chunk.isascii() and chunk.count("\n") == 1:
            before, after = chunk.split("\n")
            if after.isalpha() and before[:-1].isalpha() and before[-1] in _SIGNS:
                return self._chunks[before] + (self._others["\n"] + self._others[after] if self._joined else self._chunks[after])
        if not self._start(chunk):
            raise _Odd
        if len(chunk) > 64 or not _KNOWN.fullmatch(chunk):
            return self.whole(" " + chunk if self._joined else chunk)
        if not self._joined:
            return b"".join([self._chunks[p] if self._word(p) else self._others[p] for p in self._words(chunk.lower())])
        return b"".join([self._chunks[p[1:]] if p[0] == " " and self._word(p[1:]) else self._others[p] for p in self._words(" " + chunk)])

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self._apart or any(x in text for x in self._controls):
            return self.whole(text)
        first, *rest = text.split(" ")
        try:
            return self.whole(first) + b"".join(map(self._chunks.__getitem__, rest))
        except _Odd:
            return self.whole(text)


@functools.cache
def encoder(path: str, joined: bool, literal: bool = False) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, joined, literal)
