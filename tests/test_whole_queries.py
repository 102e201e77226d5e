"""Queries on texts of any script and length against plain versions."""

import re
from collections import Counter
from difflib import SequenceMatcher

import pytest

from codegrain.functions import comments
from codegrain.plans.catalogue import QUERIES

TEXTS = ["a" * 700 + "b" * 5, "日本語のテキスト é😀 # x\n# y\nz", "😀😀é", "", "plain words, no sign", "# only\n#! kept\nrare Rare _x1"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{base}/documents.parquet")
    turns = ["x" * 300 + "é" * 200, "x" * 300 + "ü" * 200, "日本語", "日本"]
    spark.createDataFrame([(i // 2, i % 2, t) for i, t in enumerate(turns)], "conv_id long, turn long, text string").write.parquet(f"{base}/conversations.parquet")
    return base, turns


def test_fuzzy_ratio_of_whole_texts(spark, made):
    base, turns = made
    want = {i: float(round(100 * SequenceMatcher(None, turns[2 * i], turns[2 * i + 1], autojunk=False).ratio())) for i in range(2)}
    assert {r["conv_id"]: r["mean_ratio"] for r in QUERIES["fuzzy_ratio"](spark, base).collect()} == want
    assert want[0] == 60


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def percent(a, b):
    return round((1 - distance(a, b) / max(len(a), len(b))) * 100, 4)


def test_edit_similarity_of_whole_turns(spark, tmp_path):
    turns = ["a b c " * 40 + "é ü, 中文", "a c b " * 37 + "é; ü 文", "", "x" * 500, "x" * 400 + "y" * 100, "\n"]
    rows = [(c, t, turns[(c * 3 + t) % len(turns)]) for c in range(6) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    said = {(c, t): x for c, t, x in rows}
    pairs = {(c, t): (said[c, t - 1], x) for (c, t), x in said.items() if t and said[c, t - 1] + x}
    got = {(r["conv_id"], r["turn"]): r["score"] for r in QUERIES["edit_similarity_char"](spark, str(tmp_path)).collect()}
    assert got == {k: percent(a, b) for k, (a, b) in pairs.items()}
    words = lambda x: re.findall(r"\w+|[^\w\s]", x)
    got = {(r["conv_id"], r["turn"]): r["score"] for r in QUERIES["edit_similarity_token"](spark, str(tmp_path)).collect()}
    assert got == {k: percent(words(a), words(b)) for k, (a, b) in pairs.items() if words(a) and words(b)}
    scored = {(r["conv_id"], r["turn"]): r["similarity"] for r in QUERIES["scored_answers"](spark, str(tmp_path)).collect()}
    given = lambda turn, b: b if turn % 4 == 3 else b.strip()
    assert scored == {k: percent(words(a), words(b)) for k, (a, b) in pairs.items() if a and given(k[1], b) and words(a) + words(b)}


def test_masks_fall_on_character_borders(spark, made):
    got = {r["doc_id"]: (r["prefix"], r["middle"], r["suffix"]) for r in QUERIES["fim_mask"](spark, made[0]).collect()}
    for i, t in enumerate(TEXTS):
        raw = t.encode()
        cuts = []
        for at in (len(raw) // 3, 2 * len(raw) // 3):
            while at < len(raw) and raw[at] & 0xC0 == 0x80:
                at -= 1
            cuts.append(at)
        assert got[i] == (raw[: cuts[0]].decode(), raw[cuts[0] : cuts[1]].decode(), raw[cuts[1] :].decode())


def test_every_term_is_counted(spark, made):
    words = [re.findall(r"\w+", t.lower()) for t in TEXTS]
    df, tf = Counter(w for ws in words for w in set(ws)), Counter(w for ws in words for w in ws)
    got = {r["term"]: (r["df"], r["tf"]) for r in QUERIES["document_frequency"](spark, made[0]).collect()}
    assert got == {w: (df[w], tf[w]) for w in df}


def test_comments_go_from_every_document(spark, made):
    got = {r["doc_id"]: r["code"] for r in QUERIES["strip_hash_comments"](spark, made[0]).collect()}
    for i, t in enumerate(TEXTS):
        for name in comments.OF_LANGUAGE["r"]:
            t = re.sub(comments.FORMS[name], "", t, flags=re.M | re.S)
        assert got[i] == t


def test_bands_are_those_of_the_whole_distance(spark):
    import random

    from pyspark.sql import functions as F

    from codegrain.functions import similarity

    rng = random.Random(6)
    texts = ["", "a", "ab" * 20, "é中😀" * 5, "x" * 40] + ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 60))) for _ in range(25)]
    texts += [t[: len(t) // k] + "z" * (len(t) // 9) for t in texts[5:15] for k in (2, 3, 10)] + ["q" * 10, "q" * 5 + "r" * 5, "q" + "r" * 9]
    pairs = [(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts) if (i + j) % 3 == 0] + [(-1, 0, None, "a"), (-2, 0, "a", None)]
    frame = spark.createDataFrame(pairs, "i int, j int, a string, b string").repartition(4)
    for low, high in ((10, 50), (0, 100), (30, 31)):
        got = {(r["i"], r["j"]): r["t"] for r in frame.select("i", "j", similarity.band_by_bounds(F.col("a"), F.col("b"), low, high).alias("t")).collect()}
        for i, j, a, b in pairs:
            if a is None or b is None or not a + b:
                assert got[i, j] is None
                continue
            score = percent(a, b)
            assert got[i, j]["band"] == ("hard" if score <= low else "kept" if score < high else "easy"), (a, b, low, high)
        assert len({t["how"] for t in got.values() if t}) >= 3


def test_a_report_of_scored_answers(spark, tmp_path):
    """By hand: what the report of the catalogue makes of its answers."""
    turns = ["a b c d " * 3, "a b c x " * 3, "def f ( x ) :", "def g ( x ) :", "q", "a b c d " * 3]
    rows = [(c, t, turns[(c + 2 * t) % len(turns)]) for c in range(8) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    said = {(c, t): x for c, t, x in rows}
    words = lambda x: re.findall(r"\w+|[^\w\s]", x)
    scores = {}
    for (c, t), b in said.items():
        if t:
            kind = ("class", "function", "block", "line")[c % 4]
            scores.setdefault(("python" if c % 2 == 0 else "java", kind), []).append(percent(words(said[c, t - 1]), words(b)))
    want = {lang: {k: int(sum(x) / len(x)) if (x := scores.get((lang, k))) else 0 for k in ("class", "function", "block", "line")} for lang in ("python", "java")}
    got = {r["language"]: {k: r[k] for k in ("class", "function", "block", "line")} for r in QUERIES["scored_report"](spark, str(tmp_path)).collect()}
    assert got == want
