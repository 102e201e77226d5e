"""Byte-level BPE by a lazily determinised transducer, and decoding as a stream.

A text is parted by a pattern, and each piece is encoded by merges of rising rank. As a transducer: between two bytes one may
stand on a node of the trie of tokens, inside the token that was begun at an earlier border, or close that token if the
merges of both tokens leave their border alone. Every beginning of a piece has one encoding, so of all ways to close a
token at a byte one is right. What is open are the borders from which a token still goes on; they lie no further back
than the longest token.

Determinised, a state is the set of these borders: for each the node of the trie and the token that ends there. A step reads a
byte and says which token closes behind it; tokens that lie before the point in which the ways back from all open borders
meet are certain and are emitted, so output lags by a bounded number of bytes. States and their steps are made when a piece
first asks for them, and forgotten when there are too many.

Two tokens may stand side by side unless a merge across their border comes first: a pair of a node from the right edge of
the left one's tree of merges and one from the left edge of the right one's, whose rank is below that at which either is
merged on. Ranks must be in the order of merging (each token made of two of lower rank); compiling says so if not.

Decoding puts the bytes of the ids in a row and cuts them where a character ends. The state machine of UTF-8 runs over
tokens: most end as they begin, between two characters, and change nothing.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.llm.common import stored
from codegrain.llm.tokens import _Memo

#: States that a worker holds before it begins anew, pairs of tokens whose border it remembers, and pieces.
STATES, PAIRS, PIECES = 250_000, 500_000, 200_000
#: Characters that are parted, and ids that are decoded, at once; bytes of a piece after which it is looked what is certain.
CHUNK, LOOK = 65_536, 4096
_NEVER = 1 << 62
#: Bits for a token in a state.
_BITS = 24
_TOKEN = (1 << _BITS) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class _Steps(dict):
    """Steps by state and byte, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: int) -> int:
        step = self[key] = self.make(key >> 8, key & 255)
        return step


class Transducer:
    """Encodes a piece of bytes; see above."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte must be a token")
        self.ranks, self.limit = ranks, states
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.next: list[dict[int, int]] = [{}]  # the trie: node, byte, node
        self.token = [-1]
        for token, rank in ranks.items():
            at = 0
            for byte in token:
                at = self.next[at].setdefault(byte, len(self.next))
                if at == len(self.next):
                    self.next.append({})
                    self.token.append(-1)
            self.token[at] = rank
        self.depth = [0] * len(self.next)
        for at, children in enumerate(self.next):  # children come after their parents
            for child in children.values():
                self.depth[child] = self.depth[at] + 1
        self.merges = {left << _BITS | right: rank for token, rank in ranks.items() for i in range(1, len(token)) if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None}
        self._edges: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self._pairs: dict[int, bool] = {}
        self._begin()

    def _begin(self) -> None:
        self.states: list[tuple[int, ...]] = []
        self._known: dict[tuple[int, ...], int] = {}
        self.steps = _Steps(self._step)
        self._state((0,))

    def _state(self, borders: tuple[int, ...]) -> int:
        """A border: the node in the upper bits, the token that ends there plus one in the lower; 0 is the begin of a piece."""
        if (at := self._known.get(borders)) is None:
            at = self._known[borders] = len(self.states)
            self.states.append(borders)
        return at

    def parts(self, token: bytes) -> tuple[bytes, bytes]:
        """The two tokens whose merge makes a token."""
        rank, found = self.ranks[token], [bytes([b]) for b in token]
        while len(found) > 2:
            best, at = min((self.ranks.get(found[i] + found[i + 1], _NEVER), i) for i in range(len(found) - 1))
            if best >= rank:
                break
            found[at : at + 2] = [found[at] + found[at + 1]]
        if len(found) != 2 or max(self.ranks[p] for p in found) >= rank:
            raise ValueError(f"token {rank} is not merged from two of lower rank")
        return found[0], found[1]

    def _edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """Tokens at an edge of a token's tree, each with the rank at which it is merged on."""
        if (out := self._edges.get((token, right))) is None:
            part, out = self.bytes[token], [(token, _NEVER)]
            while len(part) > 1:
                until, part = self.ranks[part], self.parts(part)[right]
                out.append((self.ranks[part], until))
            self._edges[token, right] = out
        return out

    def beside(self, left: int, right: int) -> bool:
        """Whether the merges of the two tokens in a row leave their border alone."""
        if (out := self._pairs.get(left << _BITS | right)) is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            out, theirs = True, self._edge(right, False)
            for a, until_a in self._edge(left, True):
                for b, until_b in theirs:
                    # of equal ranks the pair further left goes first
                    if (rank := self.merges.get(a << _BITS | b)) is not None and rank < until_a and rank <= until_b:
                        out = False
            self._pairs[left << _BITS | right] = out
        return out

    def _step(self, state: int, byte: int) -> int:
        """The state after one more byte, and in the lower bits the token that closes behind it."""
        moved, closed = [], -1
        for border in self.states[state]:
            child = self.next[border >> _BITS].get(byte)
            if child is None:
                continue
            before, token = (border & _TOKEN) - 1, self.token[child]
            if closed < 0 <= token and (before < 0 or self.beside(before, token)):
                closed = token
            if self.next[child]:
                moved.append(child << _BITS | border & _TOKEN)
        moved.append(closed + 1)
        return self._state(tuple(moved)) << _BITS | closed

    def _back(self, taken: list[int], at: int) -> list[int]:
        """The tokens up to border at, by the steps taken."""
        out, size = [], self.size
        while at > 0:
            token = taken[at - 1] & _TOKEN
            out.append(token)
            at -= size[token]
        out.reverse()
        return out

    def _certain(self, taken: list[int], state: int) -> int:
        """The border in which the ways back from all open borders meet."""
        open_ = {len(taken) - self.depth[b >> _BITS] for b in self.states[state]}
        while len(open_) > 1:
            last = max(open_)
            open_.remove(last)
            open_.add(last - self.size[taken[last - 1] & _TOKEN])
        return open_.pop()

    def __call__(self, piece: bytes) -> list[int]:
        out: list[int] = []
        taken: list[int] = []  # a step for each byte since what is certain
        state, steps, add = 0, self.steps, taken.append
        for at in range(0, len(piece), LOOK):
            if len(self.states) > self.limit:
                here = self.states[state]
                self._begin()
                state, steps = self._state(here), self.steps
            for byte in piece[at : at + LOOK]:
                step = steps[state << 8 | byte]
                add(step)
                state = step >> _BITS
            if at + LOOK < len(piece):
                sure = self._certain(taken, state)
                out += self._back(taken, sure)
                del taken[:sure]
        return out + self._back(taken, len(taken)) if out else self._back(taken, len(taken))


@functools.cache
def patterns(pattern: str):
    """(usual, odd, strict): the pattern compiled; the characters that the two libraries' tables judge differently, if any,
    and the pattern for texts that have some. Tables of letters and numbers grow with Unicode; the ones that count are those
    of the tokenizer library, which is asked about characters that are new to Python's."""
    import regex
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    odd = {}
    for name in ("L", "N"):
        ours = regex.compile(rf"\p{{{name}}}")
        theirs = tiktoken.Encoding(name, pat_str=rf"\p{{{name}}}", mergeable_ranks=single, special_tokens={})
        new = (chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
        odd[name] = [c for c in new if ours.match(c) and not theirs.encode_ordinary(c)]
    usual = regex.compile(pattern)
    if not any(odd.values()):
        return usual, None, usual
    ranges = lambda chars: "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in _ranges(sorted(map(ord, chars))))
    strict = pattern
    for name, chars in odd.items():
        if chars:
            strict = strict.replace(rf"\p{{{name}}}", rf"[\p{{{name}}}--[{ranges(chars)}]]")
    return usual, frozenset(chain.from_iterable(odd.values())), regex.compile(strict, regex.V1)


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b) for a, b in out]


class Encoder:
    """Encodes texts of any length, piece by piece; pieces that come back are remembered with their ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.run = ranks, Transducer(ranks)
        self.usual, self.odd, self.strict = patterns(pattern)
        self.pieces = _Memo(self._piece, PIECES)

    def _piece(self, piece: str) -> tuple[int, ...]:
        whole = piece.encode()
        # a piece that is a token is that token
        return (rank,) if (rank := self.ranks.get(whole)) is not None else tuple(self.run(whole))

    def __call__(self, text: str) -> Iterator[list[int]]:
        """Ids of some pieces at a time."""
        pattern = self.usual if text.isascii() or self.odd is None or self.odd.isdisjoint(text) else self.strict
        if len(text) <= CHUNK:
            yield list(chain.from_iterable(map(self.pieces.__getitem__, pattern.findall(text))))
            return
        found = (m.group() for m in pattern.finditer(text))
        while some := list(islice(found, CHUNK // 4)):
            yield list(chain.from_iterable(map(self.pieces.__getitem__, some)))


def _next_state(state: int, byte: int) -> int:
    """The state of UTF-8 after a byte. 0: between characters, 1 to 3: so many bytes must follow, 4 to 7: the same, and the
    next byte is bounded (after E0, ED, F0, F4); 8: the byte cannot stand here."""
    if state == 0:
        if byte < 0x80:
            return 0
        if 0xC2 <= byte <= 0xDF:
            return 1
        if 0xE0 <= byte <= 0xEF:
            return {0xE0: 4, 0xED: 5}.get(byte, 2)
        return {0xF0: 6, 0xF4: 7}.get(byte, 3) if 0xF0 <= byte <= 0xF4 else 8
    low, high = {4: (0xA0, 0xBF), 5: (0x80, 0x9F), 6: (0x90, 0xBF), 7: (0x80, 0x8F)}.get(state, (0x80, 0xBF))
    if not low <= byte <= high:
        return 8
    return {1: 0, 2: 1, 3: 2, 4: 1, 5: 1, 6: 2, 7: 2}[state]


def _whole(text: bytes) -> bool:
    """Whether bytes are whole characters: from between two characters the state machine gets back there."""
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


class Decoder:
    """Turns ids into bytes as they come. feed() returns whole characters only and keeps what is begun; finish() returns
    what was begun and never ended. A byte that cannot stand where it does is handed on as it is, and the machine goes on
    behind it; text() replaces such bytes."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        size = max(tokens, default=-1) + 1
        self.plain = np.zeros(size, bool)
        for rank, token in tokens.items():
            self.plain[rank] = self._run(0, token) == (0, 0)
        self.state, self.kept = 0, b""

    @staticmethod
    def _run(state: int, token: bytes) -> tuple[int, int]:
        """(state after a token, how many of its last bytes belong to a character that is begun; all that was kept too, if more
        than the token has)."""
        begun = 0
        for i, byte in enumerate(token):
            was, state = state, _next_state(state, byte)
            if state == 8 and was:  # what was begun is broken off, the byte may begin anew
                was, state = 0, _next_state(0, byte)
                begun = 0
            if state == 8:
                state = 0
            begun = 0 if not state else begun + 1 if was else 1
            if was and state and begun == i + 1:
                begun = len(token) + 1  # since before this token
        return state, begun

    def feed(self, ids: list[int]) -> bytes:
        out = self.kept + b"".join(map(self.tokens.__getitem__, ids))
        if not self.state and _whole(out):
            return out
        state, tail = self.state, len(self.kept)
        at, n = 0, len(ids)
        special = np.flatnonzero(~self.plain[np.array(ids, np.int64)]).tolist() if n else []
        nth = 0
        while True:
            if not state:  # between characters: on to the next token that is not whole in itself
                while nth < len(special) and special[nth] < at:
                    nth += 1
                if nth == len(special):
                    tail = 0 if n > at else tail
                    break
                at, tail = special[nth], 0
            if at == n:
                break
            token = ids[at]
            if (step := self.steps.get((state, token))) is None:
                step = self.steps[state, token] = self._run(state, self.tokens[token])
            state, begun = step
            size = len(self.tokens[token])
            tail = 0 if not state else tail + size if begun > size else begun
            at += 1
        self.state = state
        whole = len(out) - tail if state else len(out)
        self.kept = out[whole:]
        return out[:whole]

    def finish(self) -> bytes:
        out, self.kept, self.state = self.kept, b"", 0
        return out

    def text(self, chunks: Iterable[list[int]]) -> Iterator[str]:
        """The text of ids that come in chunks, however characters are cut by them; bytes that are none become U+FFFD."""
        for ids in chunks:
            yield self.feed(ids).decode(errors="replace")
        yield self.finish().decode(errors="replace")


@functools.cache
def coder(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """One of each for a Python worker."""
    ranks = read_ranks(path)
    return Encoder(ranks, pattern), Decoder({rank: token for token, rank in ranks.items()})


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of documents (doc_id, text), without special tokens. A null text is empty and has no ids;
    rows are encoded one by one, repeated ones and null doc_ids alike; other columns are ignored; no rows, no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = coder(path, pattern)
        for batch in batches:
            ids = [np.fromiter((i for part in encode(text.as_py() or "") for i in part), np.int32) for text in batch.column(1)]
            offsets = np.cumsum([0, *map(len, ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))], names=["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, docs.select("doc_id", F.lit(None).cast("array<int>").alias("ids")).schema)


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids). Null ids are none; bytes that are no text become U+FFFD; an id that is no token
    is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = coder(path, pattern)
        for batch in batches:
            lists = (x.as_py() or [] for x in batch.column(1))
            texts = ["".join(decoder.text(ids[at : at + CHUNK] for at in range(0, len(ids), CHUNK))) for ids in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, rows.select("doc_id", F.lit(None).cast("string").alias("text")).schema)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of documents (doc_id, text), stored: the ids in decimal joined by a
    space, and the bytes that decoding these ids gives. A text goes through encoder and decoder in chunks, so what is held of
    it besides itself is small. Rows as in encoded()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decoder = coder(path, pattern)
        shown = {rank: str(rank) for rank in decoder.tokens}
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, listed, back = 0, hashlib.sha256(), hashlib.sha256()
                for ids in encode(text.as_py() or ""):
                    listed.update((" " if n else "").encode() + " ".join(map(shown.__getitem__, ids)).encode())
                    back.update(decoder.feed(ids))
                    n += len(ids)
                back.update(decoder.finish())
                rows.append((n, listed.hexdigest(), back.hexdigest()))
            n, listed, back = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
