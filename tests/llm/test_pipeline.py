"""The whole pipeline against a plain version of each stage's decision."""

import hashlib
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codegrain.llm.common import stored, table
from codegrain.llm.queries import ORACLES, QUERIES, tokenizer_path
from codegrain.llm.tokens import encoder
from tests.llm.test_mixing import reshared
from tests.llm.test_near_duplicates import classes
from tests.llm.test_rules_and_chat import measures
from tests.llm.test_shingle_sets import plain_set

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        out.append(docs)
    return out


def good(text):
    n, chars, symbols, lines, repeats = measures(text)
    return not (n < 1 or 100 * repeats > 50 * n or 10 * symbols > n or chars < 2 * n or chars > 14 * n or 4 * lines > n)


def test_stages_decide_as_plain_versions(spark, stages):
    columns = table(spark, SF, "documents").columns
    assert all(s.columns == columns for s in stages[:-1])
    rows = table(spark, SF, "documents").collect()
    kept = {r["doc_id"] for r in stages[0].collect()}
    assert kept == {r["doc_id"] for r in rows if any(ch.isalpha() for ch in r["text"] or "")}
    rows = [r for r in rows if r["doc_id"] in kept and good(r["text"])]
    assert {r["doc_id"] for r in stages[1].collect()} == {r["doc_id"] for r in rows}
    held = {r["doc_id"]: plain_set(r["text"]) for r in rows}
    first = classes(held, [(a, b) for a, b in combinations(sorted(held), 2) if 9 * len(held[a] & held[b]) >= 4 * (len(held[a]) + len(held[b]))])
    rows = [r for r in rows if first[r["doc_id"]] == r["doc_id"]]
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(r["doc_id"] for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += measures(r["text"])[0]
    goal = reshared(sizes)
    copies = {}
    for r in rows:
        rate = goal[r["source"]] / sizes[r["source"]]
        u = int(hashlib.md5(f"17:{r['doc_id']}:{r['source']}".encode()).hexdigest()[:13], 16) / 2**52
        copies[r["doc_id"]] = int(rate + 1e-9) + (u < rate - int(rate + 1e-9))
    assert Counter(r["doc_id"] for r in stages[3].collect()) == Counter({d: n for d, n in copies.items() if n})
    encode = encoder(tokenizer_path("word_bpe_49k.json"), False)
    lengths = {r["doc_id"]: len(encode(r["text"])) // 4 + 1 for r in rows}
    packed = stages[4].collect()
    assert sum(r["length"] for r in packed) == sum(lengths[d] * n for d, n in copies.items())
    bins = Counter()
    for r in packed:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 2048


def test_run_is_the_stages_in_a_row(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[-1].columns and got.count() == stages[-1].count()


def test_pipeline_of_odd_documents(spark, tmp_path):
    docs = table(spark, SF, "documents")
    odd = [(None, None, None, None), (None, "", "en", "a"), (5, "1234 !!", None, "a"), (6, "word " * 30_000, "en", None), (7, "x" * 200_000, None, "b"), (7, "a short clean text of some words", "en", "b"), (7, "a short clean text of some words", "en", "b"), (None, "another short clean text of words", "en", None)]
    more = spark.createDataFrame([(*r, None, "n", 1, 0.5) for r in odd], "doc_id long, text string, lang string, source string, n_chars long, node string, words int, target double")
    few = docs.limit(60).withColumns({"node": F.lit("x"), "words": F.lit(2), "target": F.lit(0.1)})
    few.unionByName(more).write.parquet(f"{tmp_path}/some/documents.parquet")
    few.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    docs = table(spark, f"{tmp_path}/some", "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        done = stored(stage(spark, docs, f"{tmp_path}/some"))
        assert done.columns == docs.columns
        assert {r["doc_id"] for r in done.collect()} <= {r["doc_id"] for r in docs.collect()}
        docs = done
    texts = [r["text"] for r in docs.where("doc_id = 7 or doc_id is null").collect()]
    assert all(t and any(c.isalpha() for c in t) for t in texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len({(r["doc_id"], r["sequence_id"], r["offset"]) for r in packed}) == len(packed) >= docs.count()
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    names = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(n) for n in names]
    got = QUERIES[name](spark, SF).select(*names).collect()
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(show, r)) for r in got) == sorted(tuple(show(r[i]) for i in order) for r in want.fetchall())
