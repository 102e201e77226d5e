import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codegrain.llm import packing, token_output
from codegrain.llm.common import table
from codegrain.llm.queries import tokenizer_path
from codegrain.llm.tokens import _Memo, encoder

FILES = (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False))


@functools.cache
def library(name, literal):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    if literal:
        t.encode_special_tokens = True
    return t


def whole(name, text, literal=False):
    return library(name, literal).encode(text, add_special_tokens=False).ids


def agree(text):
    for name, joined in FILES:
        for literal in (False, True):
            assert np.frombuffer(encoder(tokenizer_path(name), joined, literal)(text), "<u4").tolist() == whole(name, text, literal)


TEXTS = ["", " ", "a  b", "a\n b", "\n\n x ", "don't 's", "a ́b", "x \tb\ty", "<|endoftext|> a", "x<|ENDOFTEXT|>y <|startoftext|>", "é Ü ß.", "日本 語", "ΑΣ ΑΣ.", " x  y", "THE The the, the.\nThe", "It. Is? so;\nNow a.\n\nb c,\nd 's,", "a" * 500, "İ ı ſ K Å", "e\u0301 \u1100\u1161", "1 22 333,444.5"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_whole_text(text):
    agree(text)


def test_control_strings_become_their_ids_unless_literal():
    assert whole("byte_bpe_50k.json", "<|endoftext|> a")[0] == 50256
    assert 50256 not in whole("byte_bpe_50k.json", "<|endoftext|> a", True)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab'sé ÉΣ\n\t.,|!1 ́ 中<>"), max_size=60))
def test_ids_of_mixed_text(text):
    agree(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=12), max_size=8), st.sampled_from([" ", "\n", ". ", "  "]))
def test_ids_of_text_in_any_script(parts, gap):
    agree(gap.join(parts))


def test_ids_of_all_documents(spark):
    for r in table(spark, "/root/testdata/sf0.01", "documents").collect():
        for name, joined in FILES:
            assert np.frombuffer(encoder(tokenizer_path(name), joined)(r["text"] or ""), "<u4").tolist() == whole(name, r["text"] or "")


def test_memory_of_words_is_bounded_and_forgets_nothing_asked_for():
    made = []
    memo = _Memo(lambda k: made.append(k) or k.encode(), 10)
    for i in range(200):
        assert memo[f"w{i % 37}"] == f"w{i % 37}".encode() and memo["often"] == b"often"
        assert len(memo) + len(memo.former) <= 20
    assert made.count("often") <= 2  # kept from the second time on
    assert memo["x" * 30] and "x" * 30 not in memo


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(1, 100), st.sampled_from([token_output.BIT, token_output.BYTE]))
def test_planes_round_trip(ids, block, kind):
    a = np.array(ids, "<u4")
    content = token_output.encode_shard(a, block, kind)
    assert (token_output.decode_shard(content) == a).all()
    if len(ids) > block:
        assert (token_output.decode_shard(content, 1, 2) == a[block : 2 * block]).all()


ODD = [(3, "b c", "x"), (1, None, "y"), (2, "", None), (None, "n", "z"), (3, "b c", "x"), (3, "a", "x"), (7, "word " * 5000, "w")]
SCHEMA = "doc_id long, text string, n_tokens string"


def test_token_output_of_odd_rows(spark):
    got = sorted(map(tuple, token_output.token_output(spark.createDataFrame(ODD, SCHEMA).repartition(3), tokenizer_path("byte_bpe_50k.json"), shard_ids=4, block=3).collect()), key=lambda r: r[1])
    ids = {(d, t): np.array([*whole("byte_bpe_50k.json", t or ""), 0], "<u4") for d, t, _ in ODD}
    assert [r[0] for r in got] == [None, 1, 2, 3, 3, 3, 7]
    ends = np.cumsum([r[2] for r in got])
    assert [r[1] for r in got] == [0, *ends[:-1].tolist()]
    assert sorted((r[0] or 0, r[2], r[3]) for r in got) == sorted((d or 0, len(ids[d, t]), zlib.crc32(ids[d, t].tobytes())) for d, t, _ in ODD)
    assert token_output.token_output(spark.createDataFrame([], SCHEMA), tokenizer_path("byte_bpe_50k.json")).count() == 0


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    rooms, seen = {}, {}
    for length, rank, n, each, first, offset in packing.plan(counts, 20):
        assert rank == seen.get(length, 0)
        seen[length] = rank + n
        for i in range(n):
            bin_ = first + i // each
            assert rooms.setdefault(bin_, 20) == 20 - (offset + i % each * length)
            rooms[bin_] -= length
    assert seen == counts
    assert sorted(rooms.values()) == best_fit_decreasing(lengths, 20)


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 100)), st.integers(0, 100))
def test_tightest(rooms, length):
    tree = packing.RoomTree(100)
    for r in rooms:
        tree.add(r, 1)
    assert tree.tightest(length) == min((r for r in rooms if r >= length), default=None)


def test_packing_of_odd_rows(spark):
    rows = [*ODD, *((100 + i, "word " * (i % 9), None) for i in range(100))]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(4), tokenizer_path("word_bpe_49k.json"), capacity=16).collect()
    ids = [np.array([*whole("word_bpe_49k.json", t or ""), 0], "<u4") for _, t, _ in rows]
    assert sum(r["length"] for r in got) == sum(map(len, ids))
    assert len(got) == sum(-(-len(i) // 16) for i in ids)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        ends = 0
        for offset, length in sorted(b):
            assert offset == ends
            ends += length
        assert ends <= 16
    assert len(bins) == len(best_fit_decreasing([r["length"] for r in got], 16))
    long_ = {(r["piece"], r["start"], r["ids_crc32"]) for r in got if r["doc_id"] == 7}
    assert long_ == {(k, 16 * k, zlib.crc32(ids[6][16 * k : 16 * k + 16].tobytes())) for k in range(-(-len(ids[6]) // 16))}
    assert packing.pack(spark.createDataFrame([], SCHEMA), tokenizer_path("word_bpe_49k.json")).count() == 0
