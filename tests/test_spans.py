"""Byte ranges against plain versions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from codegrain.operators import nodes, spans
from codegrain.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def cut(text, ranges):
    raw = text.encode()
    gone = set()
    for s, e in ranges:
        at = [max(s, 0), min(e, len(raw))]
        for i in (0, 1):
            while 0 < at[i] < len(raw) and raw[at[i]] & 0xC0 == 0x80:
                at[i] -= 1
        gone |= set(range(*at))
    return bytes(b for i, b in enumerate(raw) if i not in gone).decode()


def test_texts_without_their_ranges(spark):
    rng = random.Random(1)
    texts = {i: "".join(rng.choice("aé中😀 \n") for _ in range(rng.randint(0, 60))) for i in range(40)} | {100: None, 101: "", 102: "whole"}
    ranges = [(i, s, s + rng.randint(-2, 12)) for i in range(30) for s in (rng.randint(-3, 90) for _ in range(rng.randint(0, 9)))]
    ranges += [(102, -5, 99), (100, 0, 3), (101, 0, 3), (7, None, 3), (7, 3, None), (999, 0, 1), (8, 2, 6), (8, 2, 6), (8, 3, 4)]
    files = spark.createDataFrame([(i, t, i) for i, t in texts.items()], "key long, text string, start_byte int").repartition(3)
    frame = spark.createDataFrame(ranges, "key long, start_byte long, end_byte long")
    got = spans.without(files, frame, "key", "text")
    assert got.columns == files.columns
    held = {i: [(s, e) for k, s, e in ranges if k == i and s is not None and e is not None and s < e] for i in texts}
    assert {r["key"]: r["text"] for r in got.collect()} == {i: None if t is None else cut(t, held[i]) for i, t in texts.items()}
    islands = {i: [] for i in held}
    for i, x in held.items():
        for s, e in sorted(x):
            if islands[i] and s <= islands[i][-1][1]:
                islands[i][-1][1] = max(islands[i][-1][1], e)
            else:
                islands[i].append([s, e])
    joined = {}
    for r in spans.union(frame, "key").where("key <> 999").collect():
        joined.setdefault(r["key"], []).append([r["start_byte"], r["end_byte"]])
    assert {k: sorted(v) for k, v in joined.items()} == {k: v for k, v in islands.items() if v}


def test_patterns_are_found_where_they_lie(spark):
    texts = {0: "a<!--é-->b<!-- x --><script>1<!--2--></script>", 1: "", 2: None, 3: "<!--open", 4: "中<!---->中"}
    patterns = {"comment": r"(?s)<!--.*?-->", "script": r"(?s)<script\b.*?</script>"}
    frame = spark.createDataFrame(list(texts.items()), "key long, text string")
    want = {(i, n, len(t[: m.start()].encode()), len(t[: m.end()].encode())) for i, t in texts.items() if t for n, p in patterns.items() for m in re.finditer(p, t)}
    assert {tuple(r) for r in spans.found(frame, "key", "text", patterns).collect()} == want and len(want) == 5


@pytest.mark.parametrize("parts", [1, 7])
def test_ranges_inside_others(spark, parts):
    rng = random.Random(parts)
    def some(n, first):
        return [(first + i, k, s, s + rng.randint(0, 40)) for i, (k, s) in enumerate((rng.choice("aaab"), rng.randint(0, 200)) for _ in range(n))]

    outer, inner = some(60, 0) + [(900, "a", 0, 1000), (901, "a", 5, 5), (902, None, 0, 9), (903, "a", 9, None)], some(300, 1000) + [(2000, "a", 5, 5), (2001, "a", 0, 1000), (2002, "c", 1, 2)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, file string, start_byte long, end_byte long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that one file is dealt to several tasks
    try:
        got = [tuple(r) for r in spans.inside(frame(outer), frame(inner), "file").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {(k, o, i, s, e) for o, k, a, b in outer for i, k2, s, e in inner if k is not None and k == k2 and b is not None and s >= a and e <= b}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_drawn_parts_are_those_of_all_pairs(spark):
    """The query over pages against a draw over all pairs of nodes, made in memory."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(F.col("page_id").alias("file"), F.col("html").alias("code"), F.lit("html").alias("language"))
    of, label = nodes.grain(F.col("category"), F.col("tag"))
    every = nodes.classify(nodes.exploded(nodes.with_nodes(pages))).withColumns({"grain": of, "sub_task": label}).where("grain is not null").select("file", "grain", "id", "start_byte", "end_byte").collect()
    u = lambda *keys: int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:8], 16) / (1 << 32)
    groups, files = {}, {}
    for r in every:
        groups.setdefault((r["file"], r["grain"]), []).append(r)
        files.setdefault(r["file"], []).append(r)
    want = set()
    for (file, grain), rows in groups.items():
        r = min(rows, key=lambda x: (u(file, grain, x["id"], 7), x["id"]))
        s, e = r["start_byte"], r["end_byte"]
        if grain not in ("class", "function") and u(file, r["id"], 7) >= 0.8:
            p = min((x for x in files[file] if x["start_byte"] >= s and x["end_byte"] <= e), key=lambda x: (u(file, r["id"], x["id"], 7), x["id"]))
            s, e = p["start_byte"], p["end_byte"]
        want.add((file, grain, r["id"], s, e))
    got = {(r["file"], r["grain"], r["id"], r["start_byte"], r["end_byte"]) for r in QUERIES["subpart_perturb"](spark, SF).collect()}
    assert got == want
