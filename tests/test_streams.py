"""Streams that are stopped, killed and started again."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codegrain.streaming import budget, infer
from codegrain.streaming.score import stream

SCHEMA = "sample_id string, model string, messages array<struct<role:string,content:string>>"


def calls(folder):
    """How often each sample was asked, from files that calls leave behind."""
    out = {}
    for name in os.listdir(folder):
        out.setdefault(name.split("-")[0], []).append(name)
    return {k: len(v) for k, v in out.items()}


def client_of(folder):
    def client(messages, model, attempt):
        import time
        import uuid

        said = messages[-1]["content"]
        open(f"{folder}/{said}-{attempt}-{uuid.uuid4().hex}", "w").close()
        if said.startswith("slow"):
            time.sleep(30)
        if said.startswith("bad") or said.startswith("twice") and attempt < 2:
            raise ValueError("no")
        return f"<think>x</think>{said}!"

    return client


@pytest.fixture
def tasks(spark, tmp_path):
    said = [f"good{i}" for i in range(8)] + [f"twice{i}" for i in range(4)] + ["bad0", "slow0"]
    for part in range(7):  # a file each, so that a batch takes one
        rows = [(s, "m", [("system", "x"), ("user", s)]) for s in said[2 * part : 2 * part + 2]]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/tasks")
    os.mkdir(f"{tmp_path}/calls")
    return said


def test_each_sample_is_answered_once_over_a_stop(spark, tmp_path, tasks):
    out, checkpoint, client = f"{tmp_path}/out", f"{tmp_path}/checkpoint", client_of(f"{tmp_path}/calls")
    own = infer.session(spark)
    options = {"tries": 3, "wait_ms": 300, "seconds": 3, "every": "200 milliseconds"}
    rows = own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/tasks")
    query = infer.start(rows, client, out, checkpoint, **options)
    while infer.finished(own, out) < 3:
        assert query.exception() is None
        query.awaitTermination(0.2)
    query.stop()
    first = {r["sample_id"] for r in own.read.schema(infer.ANSWERS).parquet(out).collect()}
    asked = calls(f"{tmp_path}/calls")
    assert 3 <= len(first) < len(tasks)
    got = infer.answer_all(spark, f"{tmp_path}/tasks", client, out, checkpoint, files_at_once=1, limit_s=120, **options).collect()
    assert sorted(r["sample_id"] for r in got) == sorted(tasks)  # each once
    for r in got:
        kind = r["sample_id"].rstrip("0123456789")
        want = {"good": ("!", None, 1), "twice": ("!", None, 3), "bad": ("", "ValueError: no", 3), "slow": ("", "TimeoutError: no answer within 3 s", 3)}[kind]
        assert (r["answer"], r["error"], r["tries"]) == (r["sample_id"] + want[0] if want[0] else "", *want[1:])
    after = calls(f"{tmp_path}/calls")
    assert all(after[s] == asked[s] for s in first)  # what was answered before the stop was not asked again
    assert infer.answer_all(spark, f"{tmp_path}/tasks", client, out, checkpoint, limit_s=60, **options).count() == len(tasks)
    assert calls(f"{tmp_path}/calls") == after


def test_a_budget_stops_the_stream(spark, tmp_path):
    for k in range(6):
        spark.createDataFrame([(10 * k + i, i < 3) for i in range(10)], "id long, bad boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/fed")
    rows = stream(spark, f"{tmp_path}/fed", "id long, bad boolean", 1)
    kept, spent = budget.run_within(rows, F.col("bad"), 7, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert spent.over and (spent.rows, spent.failed, spent.batch) == (30, 9, 2)
    assert sorted((r["id"], r["batch"]) for r in kept.collect()) == [(i, i // 10) for i in range(30)]
    every, spent = budget.run_within(stream(spark, f"{tmp_path}/fed", "id long, bad boolean", 2), F.col("bad"), 1000, f"{tmp_path}/out2", f"{tmp_path}/checkpoint2")
    assert not spent.over and (spent.rows, spent.failed) == (60, 18) and every.count() == 60


def test_calls_that_take_too_long_are_left_behind():
    import time

    assert infer.asked(lambda m, model, attempt: time.sleep(1) or "late", [], "m", 0, 0.05)[1].startswith("TimeoutError")
    assert infer.asked(lambda m, model, attempt: json.dumps([model, attempt]), [], "m", 4, None) == ('["m", 4]', None)


def test_answers_scored_as_they_arrive_are_those_of_the_batch(spark):
    from codegrain.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    got, want = (sorted(map(tuple, QUERIES[name](spark, sf).collect())) for name in ("scored_stream", "scored_answers"))
    assert got == want and len(got) > 20


class Held:
    """The state of one key, which counts its calls."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, [], 0

    def getMapState(self, *_):
        return self

    def containsKey(self, key):
        self.calls += 1
        return key in self.values

    def updateValue(self, key, value):
        self.calls += 1
        self.values[key] = value

    def getValue(self, key):
        self.calls += 1
        return self.values[key]

    def removeKey(self, key):
        self.calls += 1
        del self.values[key]

    def registerTimer(self, due):
        self.calls += 1
        self.timers.append(due)


def test_state_is_called_by_parts_and_not_by_samples():
    from types import SimpleNamespace

    import pandas as pd

    def client(messages, model, attempt):
        if attempt < int(messages[0]["content"]) % 4:
            raise ValueError("no")
        return model

    held, n = Held(), 2600
    samples = infer.Samples(client, 3, 100, None)
    samples.init(held)
    at = lambda now: SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now)
    rows = [(0, f"s{i}", "m", json.dumps([{"content": str(i)}])) for i in range(n)]
    frames = [pd.DataFrame(rows[k : k + 1000], columns=["part", "sample_id", "model", "messages"]) for k in range(0, n, 1000)]
    got, now = list(samples.handleInputRows((0,), iter(frames), at(1000))), 1000
    while held.timers:
        due = min(held.timers)
        held.timers = [t for t in held.timers if t != due]
        now = due + 7
        got += samples.handleExpiredTimer((0,), at(now), SimpleNamespace(getExpiryTimeInMs=lambda due=due: due))
    assert not held.values and held.calls < 100 and len(got) < 20
    answers = {r.sample_id: (r.answer, r.error, r.tries) for frame in got for r in frame.itertuples()}
    assert sum(map(len, got)) == n == len(answers)
    for i in range(n):
        answer, error, tries = answers[f"s{i}"]
        assert tries == min(i % 4 + 1, 3) and answer == ("m" if i % 4 < 3 else "") and (error == "ValueError: no") == (i % 4 == 3)
