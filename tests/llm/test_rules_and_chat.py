import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codegrain.llm import chat, license_scan, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = list(zip(w, w[1:], w[2:]))
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t", "a", "a b", "a a a", "a a a a", "a b c a b c", "x a b c y a b c z", "l\nl\n\nl \nl", "# | <>é &", "中 文 中 文 中 文", "a\x1fb c\xa0d e", "w " * 3000, "\n".join(["one two three"] * 40), " ".join(f"v{i % 97}" for i in range(5000))]
SCHEMA = "doc_id long, text string, n_words string, words int, kept string, lang string"


def test_metrics_and_verdicts(spark):
    docs = spark.createDataFrame([(i, t, "x", 1, "y", "en") for i, t in enumerate(TEXTS)] + [(None, "a b", None, None, None, None)], SCHEMA)
    got = {r["doc_id"]: r for r in quality_rules.score(docs).collect()}
    for i, t in enumerate(TEXTS):
        n, chars, symbols, lines, repeats = want = measures(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["kept"] == (not (n < 50 or 100 * repeats > 50 * n or 10 * symbols > n or chars < 2 * n or chars > 14 * n or 4 * lines > n))
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["kept"]}
    assert quality_rules.score(docs.limit(0)).count() == 0


def test_random_texts(spark):
    import random

    rng = random.Random(6)
    texts = [rng.choice(["", " ", "\n"]).join([]) + "".join(rng.choice(["a", "b", "é", "#"]) * rng.randint(1, 2) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = quality_rules.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == measures(texts[r["doc_id"]])


def test_rules_run_by_rejection_per_cost():
    rules = [quality_rules.Rule(n, None) for n in "abcd"]
    got = quality_rules.order(rules, [("a", 0.1, 1.0), ("b", 0.1, 0.1), ("c", 0.0, 2.0), ("d", 0.0, 1.0)])
    assert [r.name for r in got] == ["b", "a", "d", "c"]


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a\\b <|im_end|> \\<| <\\|"), (1, 2, "assistant", "again\n"), (2, 0, "assistant", None), (3, 5, None, "x"), (3, None, "us\ner", "y <|"),
    (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "assistant", "é中"), (None, 0, "user", "z"), (5, 0, "user", "q" * 200_000), (6, 0, "", ""),
]


def test_conversations_read_back(spark):
    rows = spark.createDataFrame([(*t, "n", 1) for t in TURNS], "conv_id long, turn long, role string, text string, node string, seq int")
    made = chat.format_conversations(rows.repartition(3))
    got = {r["conv_id"]: r for r in chat.digest(made).collect()}
    shown = {r["tree"]: r["formatted"] for r in made.collect()}
    order = lambda t: (t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] is not None, t[3] or "")
    for conv in {t[0] for t in TURNS}:
        turns = [(t[2] or "", t[3] or "") for t in sorted((t for t in TURNS if t[0] == conv), key=order)]
        said, trained = "".join(f"{r}\n{x}\n" for r, x in turns), "".join(x for r, x in turns if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(trained), hashlib.sha256(trained.encode()).hexdigest())
        assert r["formatted_chars"] == len(shown[conv]) and shown[conv].count(chat.END) == len(turns)
    assert chat.format_conversations(rows.limit(0)).count() == 0


def test_estimate_tells_shares_and_costs(spark):
    texts = ["", None, "word " * 60, "plain words of a text " * 20, "# " * 80 + "some words", "one two three four five six " * 3, *(" ".join(f"w{i}x{j}" for j in range(80)) for i in range(14))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {name: (share, cost) for name, share, cost in quality_rules.estimate(docs, sample_rows=1_000)}
    told = [measures(t) for t in texts]
    assert found["too_short"][0] == sum(n < 50 for n, *_ in told) / len(texts)
    assert found["repeats"][0] == sum(100 * rep > 50 * n for n, _, _, _, rep in told) / len(texts)
    assert found["symbols"][0] == sum(10 * sym > n for n, _, sym, _, _ in told) / len(texts)
    assert all(0 <= cost < 1 for _, cost in found.values())
    assert [s for _, s, _ in quality_rules.estimate(docs.limit(0))] == [0.0] * len(quality_rules.RULES)
    worth = [("a", 0.5, 1.0), ("b", 0.1, 0.01), ("c", 0.0, 0.5), ("d", 0.0, 0.1)]
    rules = tuple(quality_rules.Rule(n, lambda m: m("n_words") < 0) for n, _, _ in worth)
    assert [r.name for r in quality_rules.order(rules, worth)] == ["b", "a", "d", "c"]
    kept = quality_rules.keep_good(docs, quality_rules.SHORT_TOO)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(6, 20))


def test_branches_of_a_tree(spark):
    #      1 - 2 - 4 - 5     tree t; 9's parent is not there, so it is a root of its own
    #        \ 3     \ 6
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 9.0), ("t", 4, 2, "user", "c", 0.0), ("t", 5, 4, "assistant", "d", 5.0), ("t", 6, 4, "assistant", "e", None), ("u", 9, 77, "user", "z", 1.0)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    walked = {}
    for r in chat.paths(messages).collect():
        walked.setdefault(r["leaf"], {})[r["up"]] = r["node"]
    assert walked == {3: {0: 3, 1: 1}, 5: {0: 5, 1: 4, 2: 2, 3: 1}, 6: {0: 6, 1: 4, 2: 2, 3: 1}, 9: {0: 9}}
    made = chat.format_trees(messages, top=2).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    assert sorted((r["tree"], r["branch"], [t["text"] for t in r["turns"]]) for r in made) == [("t", 1, ["q", "b"]), ("t", 2, ["q", "a", "c", "d"]), ("u", 1, ["z"])]


def test_circles_of_parents_end(spark):
    rows = [(1, 2), (2, 1), (3, 1), (4, 4), (5, 4), (6, None), (7, 6), (8, 8), (9, 3)]
    messages = spark.createDataFrame(rows, "node long, parent long")
    assert {(r["leaf"], r["node"], r["up"]) for r in chat.paths(messages).collect()} == {(5, 5, 0), (5, 4, 1), (7, 7, 0), (7, 6, 1), (8, 8, 0)}
    assert {r["node"] for r in chat.endless(messages).collect()} == {1, 2, 3, 9}
    assert chat.endless(messages.where("node > 3")).count() == 0 and chat.paths(messages.limit(0)).count() == 0


def test_messages_that_share_a_node_count_once(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "b", 1.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", None, 1, "user", "x", 1.0)]
    made = chat.format_trees(spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double"), top=9)
    assert [[t["text"] for t in r["turns"]] for r in made.select(chat.read_turns(F.col("formatted")).alias("turns")).collect()] == [["q", "a"]]


def test_long_thread(spark):
    rows = spark.range(300).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    assert chat.digest(chat.format_conversations(rows)).first()["n_turns"] == 300


def plain_matches(text, templates, threshold):
    """Every part compared with every template."""
    words = re.findall("[a-z0-9]+", text.lower())
    grams = list(zip(words, words[1:], strict=False))
    close = set()
    spans = [(0, len(words))]
    for pieces in (text.split("\n"), re.split(r"\n[ \t\r]*\n", text)):
        at = 0
        for piece in pieces:
            n = len(re.findall("[a-z0-9]+", piece.lower()))
            spans.append((at, at + n))
            at += n
    for name, some in templates.items():
        for body in some:
            asked = re.findall("[a-z0-9]+", body.lower())
            want = set(zip(asked, asked[1:], strict=False))
            for s, e in [*spans, *((i, min(i + len(asked), len(words))) for i, g in enumerate(grams) if g in want)]:
                have = set(grams[s : e - 1])
                if have and 2 * len(have & want) / (len(have) + len(want)) >= threshold:
                    close.add((-2 * len(have & want) / (len(have) + len(want)), name, s, e))
    better = lambda x: any(y < x and y[2] < x[3] and x[2] < y[3] for y in close)
    return [(-d, n, s, e) for d, n, s, e in sorted(close) if not better((d, n, s, e))]


SMALL = {k: license_scan.TEMPLATES[k] for k in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MIT", "GPL-3.0", "LGPL-3.0")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([t for some in SMALL.values() for t in some] + ["", "plain words and the license of it", "the mit license " * 3]), st.integers(0, 60), st.sampled_from(["", "x", "License", "the"]), st.sampled_from(["\n", "\n \n", " "])), min_size=1, max_size=4), st.sampled_from([0.5, 0.8]))
def test_bounds_lose_no_match(pieces, threshold):
    text = ""
    for body, at, word, gap in pieces:
        words = body.split() or [""]
        words[at % len(words)] = word
        text += " ".join(words).upper() + gap
    assert license_scan.Matcher(SMALL, threshold).find(text) == plain_matches(text, SMALL, threshold)


BSD_CLAUSES = next(t for t in license_scan.TEMPLATES["BSD-3-Clause"] if "endorse" in t and "AS IS" not in t)
GPL_HEADER = next(t for t in license_scan.TEMPLATES["GPL-3.0"] if "redistribute it" in t)


@pytest.mark.parametrize(
    ("text", "licenses"),
    [
        (f"/* Copyright 2020\n{BSD_CLAUSES} */ int x;", "BSD-3-Clause"),
        ("\n".join(f"# {line}" for line in GPL_HEADER.replace(". ", ".\n").split("\n")) + "\nimport os", "GPL-3.0"),
        ("This project is licensed under the MIT License.", "MIT"),
        ("Some tool. Released under the MIT License. See the file for details, or ask.", "MIT"),
        ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache-2.0"),
        ("The MIT License (MIT)\n\nCopyright (c) 2020 A\n\n" + license_scan.TEMPLATES["MIT"][-1], "MIT"),
        ("the end of the file and the license plate of the car under the bridge", ""),
    ],
)
def test_licences_are_found_where_they_stand(text, licenses):
    found = license_scan.Matcher(license_scan.TEMPLATES, 0.8).find("before all of this\n" + text + "\nafter it")
    assert ",".join(sorted({n for _, n, _, _ in found})) == licenses


def test_a_licence_is_not_taken_for_its_kin():
    for name, some in license_scan.TEMPLATES.items():
        for body in some:
            found = license_scan.Matcher(license_scan.TEMPLATES, 0.8).find("some words before it " + body + " and some after it")
            assert found[0][:2] == (1.0, name) and {n for _, n, _, _ in found} == {name}


def test_scan_of_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "x\nReleased under the MIT License.\ny", 0), (3, "x\nReleased under the MIT License.\ny", 0), (4, "Permission to use, copy, modify, and/or distribute this software for any purpose with or\nwithout fee is hereby granted, provided that the above copyright notice and this\npermission notice appear in all copies.\n\nReleased under the BSD 2 Clause License", 0), (None, "word " * 100_000, 0), (5, "of the license " * 30_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses int")
    got = [(r["doc_id"], r["licenses"], r["n_licenses"]) for r in license_scan.scan(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, "", 0), (2, "", 0), (3, "MIT", 1), (3, "MIT", 1), (4, "BSD-2-Clause,ISC", 2), (None, "", 0), (5, "", 0)], key=str)
    assert license_scan.matches(docs.where("doc_id = 3")).first()["matches"][0].asDict() == {"license": "MIT", "dice": 1.0, "first_word": 1, "n_words": 5}
    assert license_scan.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a\\b", "<|x|>", "\\<|", "<\\|", "\\\\", "\n\\n", ""])
def test_escapes_are_reversible(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).first()
    assert r["u"] == text and "<|" not in r["e"]
