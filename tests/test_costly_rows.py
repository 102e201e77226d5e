"""Rows that cost much more than they weigh: even shares of them, few of them in Python at a time."""

import random
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from codegrain.functions import similarity
from codegrain.operators import nodes
from codegrain.plans import catalogue


def test_runs_match_what_difflib_matches(monkeypatch):
    rng = random.Random(4)
    pairs = [("", ""), ("", "a"), ("abc", "xabcx"), ("a" * 70, "a" * 3), ("x" * 40_000, "xyx" * 30)]
    pairs += [tuple("".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in "ab") for letters in ("ab", "abcdé😀 \ud800") for _ in range(200)]
    want = [sum(b.size for b in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) for a, b in pairs]
    assert [similarity.matched(a, b) for a, b in pairs] == want
    monkeypatch.setattr(similarity, "RUNS", 100)
    assert [similarity.matched(a, b) for a, b in pairs] == want


def test_more_rows_are_more_tasks(spark, monkeypatch, tmp_path):
    spark.range(300).selectExpr("id % 150 AS conv_id", "cast(id div 150 AS int) AS turn", "'t' AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.range(90).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(catalogue, "_COSTLY", 20)
    assert catalogue._pairs(spark, str(tmp_path)).rdd.getNumPartitions() == 15
    assert catalogue._code(spark, str(tmp_path)).rdd.getNumPartitions() == 5
    assert catalogue._pairs(spark, str(tmp_path)).count() == 150 and catalogue._code(spark, str(tmp_path)).count() == 630


def test_texts_are_parsed_a_few_at_a_time(spark):
    texts = [None, "", "no tag", "<div>", *(f"<div id='{i}'><p>é</p></div>" for i in range(150))]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file int, code string").coalesce(1)
    made = nodes.with_nodes(got.withColumn("language", F.lit("html")))
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()
    rows = {r["file"]: [tuple(n) for n in r["nodes"]] for r in made.collect()}
    assert rows == {i: nodes.parse(t, "html") for i, t in enumerate(texts)}
    some = nodes._as_list([None, "<a>x</a>"], ["html", "html"])
    assert isinstance(some, pa.ListArray) and some.value_lengths().to_pylist() == [0, 1]


def test_tokens_are_compared_a_few_at_a_time(spark):
    rows = [(None, ["a"]), (["a"], None), ([], ["a"]), (["a", None], ["a", "b"]), *(([f"t{i % 3}", "x"], ["x", "t1"]) for i in range(140))]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").coalesce(1)
    got = [r["s"] for r in df.select(similarity.token_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[:4] == [None, None, 0.0, 50.0] and got[5] == 0.0 and len(got) == 144
    ratio = similarity.fuzzy_ratio().func
    assert ratio(pd.Series([" ab ", "", None]), pd.Series(["ab", " ", "x"])).fillna(-1).tolist() == [100.0, 100.0, -1.0]
