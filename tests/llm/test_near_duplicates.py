import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from codegrain.llm import embedding_dedup, shingle_sets, simhash
from codegrain.llm.components import components


def classes(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 1), (3, 3)], [(i, i + 1) for i in range(60)], [(60 - i, 59 - i) for i in range(50)], [(0, i) for i in range(1, 80)], [(i * 7 % 101, i * 11 % 101) for i in range(90)], [(-5, 4), (4, 9), (9, -8)]])
def test_components(spark, edges):
    links = [e for e in edges if e[0] != e[1]]
    want = classes({x for e in links for x in e}, links)
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert {r["id"]: r["component"] for r in got} == want and len(got) == len(want)


def test_any_four_positions_hold_a_set():
    sets = simhash.position_sets()
    assert len(sets) == 20
    assert all(any(set(s) <= set(four) for s in sets) for four in combinations(range(8), 4))


def plain_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \n", "A", "a", "É x y\x1fz", "one two three", "one two three four", "One two  three\tFOUR five", "w " * 300, "x y z " * 70_000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_pieces_of_a_text_lose_no_shingle(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    for text in [*TEXTS[:-1], "a\tbb  ccc\nD e f " * 9, " lead and trail "]:
        assert simhash.fingerprint(text) == plain_print(text)


KEPT = [
    ([(None, "a b c d e f"), (None, "u v w x y z")], 2),  # null ids are no group
    ([(3, "c c1 c2 c3 c4"), (5, "a a1 a2 a3 a4"), (5, "c c1 c2 c3 c4")], 2),  # one id, two texts: the copy of 3 goes
    ([(1, "same words all over again"), (1, "same words all over again")], 1),  # a row twice
    ([(None, "same words all over again"), (2, "same words all over again"), (None, "same words all over again")], 1),
    ([], 0),
]


@pytest.mark.parametrize("keep", [simhash.keep_one, shingle_sets.keep_one])
@pytest.mark.parametrize(("rows", "n"), KEPT)
def test_groups_are_made_of_rows(spark, keep, rows, n):
    docs = spark.createDataFrame([(i, t, {"k": "v"}, 1.5) for i, t in rows], "doc_id long, text string, row map<string,string>, component_id double")
    got = keep(docs.repartition(3))
    assert got.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(left) == n and {t for _, t in left} == {t for _, t in rows}
    best = {t: min((i is None, i or 0) for i, u in rows if u == t) for _, t in rows}
    assert all((i is None, i or 0) == best[t] for i, t in left)


def test_near_duplicates_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 400)) for _ in range(6)]
    rows = []
    for i in range(240):
        words = base[i % 6].split()
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(0, 400)] = "changed"
        rows.append((1000 - i, " ".join(words), 1, 2))
    rows += [(2000 + i, t, 1, 2) for i, t in enumerate(TEXTS[:-1])] + [(5, "one two three", 1, 2)] * 2 + [(None, "one two three", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, fingerprint int")
    got = simhash.near_duplicates(docs.repartition(4)).collect()
    prints = {i: simhash.fingerprint(r[1]) for i, r in enumerate(rows)}
    found = classes(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    least = {}
    for i, c in found.items():
        if rows[i][0] is not None:
            least[c] = min(least.get(c, 1 << 60), rows[i][0])
    key = lambda t: (t[0] is None, t[0] or 0, t[1])
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=key) == sorted(((rows[i][0], f"{prints[i]:016x}", least[c]) for i, c in found.items()), key=key)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_long_lists_are_cut_into_blocks_without_loss(spark):
    rng = np.random.default_rng(3)
    prints = {int(0x0123456789ABCDEF)}
    while len(prints) < 300:
        x = int(0x0123456789ABCDEF)
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            x ^= 1 << int(b)
        prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    edges = simhash.links(spark.createDataFrame([(x, x) for x in signed], "node long, id long"), 4, block=16)
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    want = classes(signed, [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4])
    assert {i: got.get(i, i) for i in signed} == want


def test_embeddings_are_linked_as_all_pairs(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 24))
    rows = [(500 - i, (centres[i % 5] + rng.normal(size=24) * (0.05 + 0.3 * (i % 4))).astype(np.float32).tolist()) for i in range(160)]
    rows += [(1000 + i, rows[0][1]) for i in range(4)] + [(1100, [1e-30] * 24), (1101, [1e30] * 24), (1102, [1.0] * 24)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] * 24), (2004, [None, 1.0]), (2005, [float("inf")] * 24)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<float>, node string, n int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(frame.repartition(3)).collect()}
    x = np.array([np.array(v, np.float32).astype(float) for _, v in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [i for i, _ in rows]
    found = classes(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    assert got == {i: (int(n), found[i], found[i] == i) for i, n in zip(ids, near.sum(axis=1), strict=True)} | {i: (0, i, True) for i, _ in odd}
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def exact(x):
    size = np.linalg.norm(x, axis=1)
    return x @ x.T / (size[:, None] * size)


def test_links_at_the_threshold_are_found(spark):
    rows = [(1, [10.0, 0.0, 0.0, 0.0]), (2, [9.0, 3.0, 3.0, 1.0]), (3, [0.0, 0.0, 7.0, 0.0]), (4, [0.0, 3.0, 9.0, 3.9]), (4, [0.0, -5.0, 0.0, 0.0])]
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)}


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_tiles_stop_without_loss(threshold):
    rng = np.random.default_rng(5)
    raw = rng.normal(size=(300, 32)) * np.geomspace(1, 0.05, 32)
    raw[150:] = raw[:150] + rng.normal(size=(150, 32)) * 0.1
    x = (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)
    assert (embedding_dedup.compare(x[:100], x[50:], (raw[:100], raw[50:]), threshold, (8, 16, 32)) == (exact(raw)[:100, 50:] >= threshold)).all()


@pytest.mark.parametrize("blocks", [1, 2, 5, 16])
def test_boxes_leave_no_link_out(blocks):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 12)) * np.geomspace(1, 0.1, 12)
    x[300:] = x[:300] + rng.normal(size=(300, 12)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    of = embedding_dedup.leaf(x[:, :4], embedding_dedup.layout(x[::3, :4], blocks))
    assert 0 <= of.min() and of.max() < max(1, 2 * blocks)
    used = np.unique(of)
    ends = [np.array([f(x[of == b, :4], axis=0) for b in used]) for f in (np.min, np.max)]
    rest = np.array([np.linalg.norm(x[of == b, 4:], axis=1).max() for b in used])
    close = {(used[i], used[j]) for i, j in embedding_dedup.close_boxes(*ends, rest, 0.95)}
    linked = {tuple(sorted((of[a], of[b]))) for a, b in zip(*np.nonzero(exact(x) >= 0.95), strict=True)}
    assert linked <= close
    if blocks == 16:
        assert len(close) < len(used) * (len(used) + 1) // 2
