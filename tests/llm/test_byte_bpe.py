"""Operator 11 held against the tiktoken library, and its decoder against Python's."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from codegrain.llm import byte_bpe

NAMES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module", params=NAMES)
def both(request):
    ranks = byte_bpe.read_ranks(public_tokenizers.path(request.param))
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.Encoder(ranks, PATTERN), byte_bpe.Decoder({r: t for t, r in ranks.items()}), library


def ids_of(encode, text):
    return [i for part in encode(text) for i in part]


def some_text(rng):
    kind = rng.random()
    if kind < 0.3:
        return "".join(rng.choice("aabcdehllo  ets'.\n0123") for _ in range(rng.randint(0, 60)))
    if kind < 0.5:
        return rng.choice("ab -=*.é中한") * rng.randint(1, 300)
    if kind < 0.8:
        return "".join(chr(rng.choice((rng.randint(0, 0x250), rng.randint(0x370, 0x1000), rng.randint(0x3000, 0x9FFF), rng.randint(0x1F300, 0x1FAFF), rng.randint(0x20000, 0x3FFFF)))) for _ in range(rng.randint(0, 40)))
    return "".join(rng.choice((" the", "ing", "tion", "Über", " été", " ", "===", "  ", "\t", "<|endoftext|>")) for _ in range(rng.randint(0, 50)))


def test_ids_are_the_librarys(both):
    encode, decoder, library = both
    rng = random.Random(3)
    for _ in range(3000):
        text = some_text(rng)
        ids = ids_of(encode, text)
        assert ids == library.encode_ordinary(text)
        cuts = sorted(rng.choices(range(len(ids) + 1), k=3))
        chunks = [ids[a:b] for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True)]
        assert b"".join([*map(decoder.feed, chunks), decoder.finish()]) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeino rst'é1\n"), max_size=80))
def test_ids_of_words(text):
    encode, _, library = _first()
    assert ids_of(encode, text) == library.encode_ordinary(text)


def _first(held={}):  # noqa: B006
    if not held:
        ranks = byte_bpe.read_ranks(public_tokenizers.path(NAMES[0]))
        held[0] = byte_bpe.Encoder(ranks, PATTERN), byte_bpe.Decoder({r: t for t, r in ranks.items()}), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return held[0]


def test_every_character_is_parted_as_by_the_library():
    encode, _, library = _first()
    for at in range(0, 0x110000, 64):
        text = "".join(f"{chr(c)}a {chr(c)}1" for c in range(at, at + 64) if not 0xD800 <= c < 0xE000)
        assert ids_of(encode, text) == library.encode_ordinary(text), hex(at)


def test_long_pieces_come_out_in_parts_and_states_are_forgotten():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(NAMES[0]))
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    small = byte_bpe.Transducer(ranks, states=50)
    rng = random.Random(5)
    for text in ("x" * 50_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)), "ab" * 9000 + "c"):
        assert small(text.encode()) == library.encode_ordinary(text)
        assert len(small.states) < 50 + 2 * byte_bpe.LOOK


def test_ranks_out_of_order_are_refused():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"zz": 258}
    broken = byte_bpe.Transducer(ranks)
    assert broken(b"zzz") == [258, 122]
    with pytest.raises(ValueError):
        broken.beside(256, 100)
    with pytest.raises(ValueError):
        byte_bpe.Transducer({b"a": 0})


def test_bytes_that_are_no_text_are_replaced_as_python_does():
    _, decoder, _ = _first()
    rng = random.Random(9)
    for _ in range(3000):
        ids = [rng.randrange(50_256) if rng.random() < 0.3 else rng.randrange(94, 256) for _ in range(rng.randint(0, 30))]
        raw = b"".join(decoder.tokens[i] for i in ids)
        chunks, at = [], 0
        while at < len(ids):
            size = rng.randint(1, 5)
            chunks.append(ids[at : at + size])
            at += size
        assert "".join(decoder.text(chunks)) == raw.decode(errors="replace")


def test_documents(spark):
    library = _first()[2]
    texts = [None, "", " ", "Hello world, hello  world\n\n", "naïve café 中文 \U0001f600", "a" * 200_000, "word " * 40_000, "Hello world, hello  world\n\n"]
    rows = [(i if i != 3 else None, t, "x", 1, b"y") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int, ids_sha256 binary").repartition(2)
    path = public_tokenizers.path(NAMES[0])
    got = sorted(map(tuple, byte_bpe.digest(frame, path, PATTERN).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want, key=repr)
    back = byte_bpe.decoded(byte_bpe.encoded(frame, path, PATTERN), path, PATTERN)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((i, t or "") for i, t, *_ in rows), key=repr)
    assert byte_bpe.digest(frame.limit(0), path, PATTERN).collect() == []


def test_chunks_of_whole_characters_need_no_state_machine(monkeypatch):
    tokens = {b: bytes([b]) for b in range(256)} | {256: b"\xc3\xa9", 257: b"a\xf0\x9f"}
    decoder = byte_bpe.Decoder(tokens)
    cut = [decoder.feed([97, 257]), decoder.feed([0x98]), decoder.feed([0x80, 98])]
    assert b"".join(cut) == "aa😀b".encode() and decoder.finish() == b""
    assert decoder.feed([0xFF, 97]) == b"\xffa"
    monkeypatch.setattr(byte_bpe.np, "flatnonzero", None)  # whole characters don't ask for it
    assert decoder.feed([97, 256]) == "aé".encode() and decoder.feed([]) == b""
