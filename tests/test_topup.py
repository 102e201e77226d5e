"""Successes drawn in rounds, against drawing all attempts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from codegrain.functions.text import uniform
from codegrain.operators import topup
from codegrain.plans.catalogue import QUERIES, _MOST, _WANTED

SF = "/root/testdata/sf0.001"


def u(*keys):
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:8], 16) / (1 << 32)


@pytest.mark.parametrize(("wanted", "most"), [(3, 9), (5, 100), (1, 1), (4, 2)])
def test_the_first_successes_and_fewer_draws(spark, wanted, most):
    rates = {f"g{i}": r for i, r in enumerate((0.0, 0.02, 0.1, 0.3, 0.5, 0.9, 1.0, 0.7))}
    groups = spark.createDataFrame([(g, 1) for g in rates] * 2, "name string, half int")
    rate = F.element_at(F.create_map(*(F.lit(x) for kv in rates.items() for x in kv)), F.col("name"))
    asked_of = []

    def draw(asked):
        asked_of.append(asked.count())
        return asked.where(uniform(F.col("name"), F.col("attempt")) < rate).withColumn("payload", F.concat_ws("-", "name", "attempt"))

    kept, report = topup.top_up(groups, draw, wanted, most)
    want = {}
    for g, r in rates.items():
        hits = [a for a in range(most) if u(g, a) < r]
        want |= {(g, k + 1): (a, f"{g}-{a}") for k, a in enumerate(hits[:wanted])}
    assert {(r["name"], r["rank"]): (r["attempt"], r["payload"]) for r in kept.collect()} == want
    rows = {r["name"]: r for r in report.collect()}
    assert set(rows) == set(rates)
    for g, r in rows.items():
        assert r["kept"] == sum(1 for k in want if k[0] == g)
        last = max([want[k][0] for k in want if k[0] == g], default=-1)
        assert last < r["drawn"] <= most and (r["kept"] == wanted or r["drawn"] == most)
    assert sum(asked_of) == sum(r["drawn"] for r in rows.values())
    if most == 100:
        assert rows["g6"]["drawn"] == wanted and sum(asked_of) < 0.6 * most * len(rates)


def test_no_groups(spark):
    kept, report = topup.top_up(spark.createDataFrame([], "name string"), lambda asked: asked, 2, 5)
    assert kept.collect() == [] == report.collect()


def test_picks_point_at_members(spark):
    members = spark.createDataFrame([("a", i) for i in (5, 3, 9)] + [("b", 1)], "g string, m int")
    placed = topup.numbered(members, ["g"], ["m"])
    asked = spark.createDataFrame([("a", 0.0), ("a", 0.34), ("a", 0.99999), ("b", 0.5), ("none", 0.1)], "g string, u double")
    got = {(r["g"], r["u"]): r["m"] for r in topup.picked(asked, placed, ["g"], F.col("u")).collect()}
    assert got == {("a", 0.0): 3, ("a", 0.34): 5, ("a", 0.99999): 9, ("b", 0.5): 1}


def test_sites_draw_less_than_the_fixed_plan(spark):
    rows = QUERIES["top_up_report"](spark, SF).collect()
    assert 0 < sum(r["drawn"] for r in rows) < sum(r["fixed"] for r in rows) == _MOST * len(rows)
    samples = QUERIES["top_up_samples"](spark, SF).groupBy("site").agg(F.count("*").alias("n"), F.max("attempt").alias("last")).collect()
    kept = {r["site"]: (r["n"], r["last"]) for r in samples}
    for r in rows:
        n, last = kept.get(r["site"], (0, -1))
        assert r["kept"] == n <= _WANTED and last < r["drawn"] and (n == _WANTED or r["drawn"] == _MOST) and r["rounds"] >= 1


def test_equal_successes_count_once(spark):
    groups = spark.createDataFrame([("a",), ("b",)], "name string")
    draw = lambda asked: asked.withColumn("like", F.floor(F.col("attempt") / 3))
    kept, report = topup.top_up(groups, draw, 3, 12, unlike="like")
    assert {(r["name"], r["attempt"], r["like"]) for r in kept.collect()} == {(n, 3 * i, i) for n in "ab" for i in range(3)}
    assert all(r["kept"] == 3 and 7 <= r["drawn"] <= 12 and r["rounds"] > 1 for r in report.collect())


def test_weighted_samples_of_strata(spark):
    import math

    from codegrain.operators.quality import weighted_sample

    rows = [(s, i, w) for s, n in (("a", 400), ("b", 3), ("c", 1)) for i, w in ((i, [1.0, 5.0, 0.0, None, -1.0][i % 5]) for i in range(n))]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "s string, id int, w double, _at string").repartition(5)
    want = set()
    for s in "abc":
        drawn = sorted((-math.log(1 - u(s, i, 7)) / w, i) for t, i, w in rows if t == s and w and w > 0)
        want |= {(s, i, k + 1) for k, (_, i) in enumerate(drawn[:60])}
    got = {(r["s"], r["id"], r["rank"]) for r in weighted_sample(frame, ["s"], F.col("w"), ["id"], 60).collect()}
    assert got == want
    assert sum(i % 5 == 1 for s, i, _ in got if s == "a") > 40  # five times the weight
