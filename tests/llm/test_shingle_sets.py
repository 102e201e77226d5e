from itertools import combinations

import numpy as np

import corpus_pipeline
from codegrain.llm import shingle_sets, simhash
from tests.llm.test_near_duplicates import classes


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def rows():
    rng = np.random.default_rng(8)
    shared = " ".join(f"common{i}" for i in range(30))
    out = []
    for b in range(8):
        base = [f"w{x}" for x in rng.integers(0, 5000, 60 + 60 * b)]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.integers(0, 4 + b)):
                words[rng.integers(0, len(words))] = f"c{rng.integers(0, 99)}"
            out.append(" ".join(words) + (" " + shared if rng.random() < 0.5 else ""))
    return [(1000 - i, t) for i, t in enumerate(out + ["", None, "one two", "One two", "a b c d e", "a b c d e f"])]


def test_stage_finds_all_pairs_of_similar_sets(spark):
    data = rows()
    held = {i: plain_set(t) for i, t in data}
    near = [(a, b) for a, b in combinations(held, 2) if 9 * len(held[a] & held[b]) >= 4 * (len(held[a]) + len(held[b]))]
    want = classes(held, near)
    prints = {i: simhash.fingerprint(t) for i, t in data}
    assert any((prints[a] ^ prints[b]).bit_count() > 4 for a, b in near)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in shingle_sets.near_duplicates(docs).collect()}
    assert got == want
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert shingle_sets.near_duplicates(docs.limit(0)).count() == 0


def test_order_of_shingles_loses_no_pair():
    data = [shingle_sets.shingles(t, 5) for _, t in rows()]
    names = np.unique(np.concatenate(data))
    for counts in (np.zeros(len(names), np.int64), np.arange(len(names)) % 7):
        prefixes = [set(shingle_sets.prefix(x, (names, counts), (4, 5)).tolist()) for x in data]
        for (a, x), (b, y) in combinations(enumerate(map(set, (x.tolist() for x in data))), 2):
            assert not x or 9 * len(x & y) < 4 * (len(x) + len(y)) or prefixes[a] & prefixes[b]


def test_blocks_of_a_list_leave_no_pair_out(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 40)
    found = {}
    for i in range(90):
        own = base.copy()
        own[: rng.integers(0, 12)] = rng.integers(0, 1 << 62)
        found[i] = np.unique(np.concatenate([own, rng.integers(0, 1 << 62, rng.integers(1, 9))]))
    maps = spark.createDataFrame([(i, len(x), bytearray(shingle_sets.bitmap(x))) for i, x in found.items()], "node long, size int, bits binary")
    rows = []
    for name, members in ((7, range(90)), (-3, range(0, 90, 4)), (1, (5, 6))):
        members = list(members)
        for i in members:
            rows.append((name, i, len(found[i]), len(found[i]) - i % 5, i % 3 if name != 1 else i, len(members), 0, 0 if name != 1 else 5))
    frame = spark.createDataFrame(rows, "list long, node long, size int, rest int, c long, n long, others long, main long").repartition(5)
    want = set()
    for name in (7, -3, 1):
        for x, y in combinations(sorted((r for r in rows if r[0] == name), key=lambda r: r[1]), 2):
            total = x[2] + y[2]
            differ = np.bitwise_count(np.frombuffer(shingle_sets.bitmap(found[x[1]]), np.uint64) ^ np.frombuffer(shingle_sets.bitmap(found[y[1]]), np.uint64)).sum()
            if x[4] != y[4] and min(x[3], y[3]) * 9 >= total * 4 and differ * 9 <= total:
                want.add((x[1], y[1]))
    assert len(want) > 100
    for block in (8, 40, 512):
        got = [(r["a"], r["b"]) for r in shingle_sets.crossing(frame, maps, (4, 5), block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_links_between_fingerprints_come_first(spark, monkeypatch):
    data = rows() + [(i, "one two three four five six seven " + "x y z " * 30 + f"end{i % 3}") for i in range(2000, 2008)]
    found = {i: shingle_sets.shingles(t, 5) for i, t in data}
    node = {i: int(np.uint64(shingle_sets._node(x)).astype(np.int64)) for i, x in found.items()}
    prints = {i: simhash.fingerprint(t, 5) for i, t in data}
    near = [(node[a], node[b]) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = classes(set(node.values()), near)
    asked, plain = [], shingle_sets.verified

    def verified(pairs, *rest):
        asked.append([(r["a"], r["b"]) for r in pairs.collect()])
        return plain(pairs, *rest)

    monkeypatch.setattr(shingle_sets, "verified", verified)
    monkeypatch.setattr(shingle_sets, "STAR", 3)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    pairs = [(r["a"], r["b"]) for r in shingle_sets.alike(shingle_sets.indexed(docs, 5, (4, 5)).select("node", "print").distinct(), shingle_sets.Stored(spark)).collect()]
    assert classes(set(node.values()), pairs) == want
    assert len(set(pairs)) == len(pairs) < len(want)
    got = {r["doc_id"]: r["component_id"] for r in shingle_sets.near_duplicates(docs).collect()}
    assert asked[0] and set(asked[0]) <= set(pairs)
    held = {i: set(x.tolist()) for i, x in found.items()}
    assert got == classes(held, [(a, b) for a, b in combinations(held, 2) if 9 * len(held[a] & held[b]) >= 4 * (len(held[a]) + len(held[b]))])
