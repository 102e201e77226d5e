import math

import pytest

from codegrain.llm.mixing import mix, mix_plan, targets


def reshared(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Share by weight, cut at the caps, hand the excess to the others, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(full.values())
        goal = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if goal[s] > most * sizes[s]]
        if not over:
            return full | goal
        full |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500, None: 300}, {"x": 7}, {"a": 1, "B": 1, "é": 1, "z": 1, "": 5}, {f"s{i}": 100 + 50 * i for i in range(20)}, {"a": 0, "b": 10}])
def test_targets_are_those_of_resharing(spark, sizes):
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 1.5, 2.0).collect()}
    want = reshared(sizes)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)
    assert math.isclose(sum(got.values()), 1.5 * sum(sizes.values()), rel_tol=1e-9)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, mix_source int"


def test_plan_holds_on_odd_rows(spark):
    rows = [(i, "w " * (i % 7), "en", ["a", "b", None, ""][i % 4], 1, "x", 0) for i in range(400)] + [(None, None, None, None, None, None, None)] * 2 + [(1, "w " * 1, "en", "b", 1, "x", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mix_plan(docs).collect()
    assert len(plan) == len(rows)
    assert all(0 <= r["copies"] <= 2 for r in plan)
    assert {(r["doc_id"], r["source"], r["copies"]) for r in plan} == {(r["doc_id"], r["source"], r["copies"]) for r in mix_plan(docs.repartition(3)).collect()}
    by = {}
    for r in plan:
        by.setdefault(r["source"], [r["target"], 0])[1] += r["size"] * r["copies"]
    for target, taken in by.values():
        assert abs(taken - target) < 0.25 * target + 30
    out = mix(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in plan)
    assert {r["size"] for r in out.where("size is not null").collect()} == {"x"}


def test_no_documents(spark):
    assert mix_plan(spark.createDataFrame([], SCHEMA)).count() == 0
