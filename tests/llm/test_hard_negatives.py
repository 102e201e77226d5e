"""Operator 13 held against all products."""

import numpy as np
import pytest

from codegrain.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, row string, codes int, score double"


def plain(rows, every, positives=5, negatives=3, scale=256):
    """The contract over rows (vec_id, embedding, label) in memory."""
    good = [(i, v, c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max((len(v) for _, v, _ in good), default=0)
    x = np.array([np.floor(scale * np.array([*v, *[0.0] * (dims - len(v))])) for _, v, _ in good]).astype(object).reshape(len(good), dims)
    x = np.vectorize(int, otypes=[object])(x) if x.size else x
    out = []
    for a, (anchor, _, label) in enumerate(good):
        if anchor % every:
            continue
        score = [int(x[i] @ x[a]) for i in range(len(good))]
        order = sorted(range(len(good)), key=lambda i: (-score[i], good[i][0]))
        for p in [i for i in order if good[i][2] == label and i != a][:positives]:
            ok = [i for i in order if good[i][2] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:negatives]
            out += [(anchor, good[p][0], n + 1, good[i][0], score[p], score[i]) for n, i in enumerate(ok)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA).repartition(3)


def got(spark, rows, every, **options):
    return sorted(map(tuple, hn.mined(frame(spark, rows), f"vec_id % {every} = 0", **options).collect()))


def some_rows():
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(4, 10)) / 3
    rows = [(i, (centre[i % 4] + rng.normal(size=10) * 0.1 * (1 + i % 5)).tolist(), int(rng.integers(3))) for i in range(240)]
    rows += [(300 + i, rows[0][1], i % 3) for i in range(60)]  # a third of equal vectors: ties by vec_id
    rows += [(330, rows[5][1], 1), (330, rows[6][1], 2), (300, rows[0][1], 0)]  # a vec_id of several rows
    odd = [(400, None, 1), (405, [1.0, None], 1), (410, [float("nan")] * 10, 1), (415, [float("inf")] * 10, 1), (420, rows[3][1], None), (None, rows[3][1], 1), (425, [], 1), (430, [0.5, 0.5], 2), (435, [0.0] * 10, 0)]
    return rows + odd


@pytest.mark.parametrize("block", [16_384, 100])
def test_negatives_are_those_of_all_products(spark, block):
    rows = some_rows()
    want = plain(rows, 5)
    assert len(want) > 300
    assert got(spark, rows, 5, block=block) == want


def test_few_rows_and_other_numbers(spark):
    rows = some_rows()
    assert got(spark, rows[:7], 2, positives=2, negatives=4) == plain(rows[:7], 2, positives=2, negatives=4)
    assert got(spark, [], 2) == [] == got(spark, [(0, [1.0], 1)], 2) == got(spark, [(0, None, 1)], 2)


def test_intervals_hold_the_scores_and_leave_few():
    rng = np.random.default_rng(9)
    x = np.floor(rng.normal(size=(3000, 64)) * 32).astype(np.int64)
    centres = hn.fit(x[:2000])
    codes, left = hn.quantised(x, centres)
    anchors = x[:40]
    near = hn.looked_up(hn.tables(anchors, centres), codes)
    off = left[:, None] * np.linalg.norm(anchors, axis=1) * (1 + hn.SLACK)
    assert (np.abs(near - x @ anchors.T) <= off + 1e-6).all()
    kept = hn.best_in(near - off, near + off, np.ones(near.shape, bool), 5, np.full(40, -np.inf), np.full(40, np.inf))
    assert kept.mean() < 0.1  # of noise, on which codes are worst
    assert all(kept[np.argsort(-(x @ a), kind="stable")[:5], i].all() for i, a in enumerate(anchors))


def test_large_components_count_as_the_bound(spark):
    rows = [(0, [1e300, 1.0], 1), (2, [1e30, 2.0], 1), (3, [9e15, 0.0], 2), (5, [6e4, 0.0], 2)]
    found = got(spark, rows, 2)
    assert [r[4] for r in found if r[0] == 0][0] == hn.MOST**2 + 256 * 512
