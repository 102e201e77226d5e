"""Edge cases of expressions, against Python's own behaviour where there is one."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codegrain.functions import comments, similarity, text
from codegrain.operators import nodes, quality, relevance, skeletons
from codegrain.plans import metrics, prompt, score


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, (list, int)) else 'array<string>' if isinstance(v, list) else 'int'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("language", sorted(comments.OF_LANGUAGE))
@pytest.mark.parametrize("code", ["a # b\n# c\n#! d\n  # e\nx", "x // y\r\nz /* a\nb */ w", 'p\n"""d\nd"""\nq', "u -- v\n--[[ w\nx ]] y", "a\u2028# b\u00a0c\n\u00a0\u00a0# d", "=begin\nx\n=end\n<!-- y\n-->z", "/// a\n//! b\nhttp://c"])
def test_comments_as_python_would(spark, language, code):
    want = code
    for name in comments.OF_LANGUAGE[language]:
        want = re.sub(comments.FORMS[name], "", want, flags=re.M | re.S)
    assert one(spark, comments.strip_comments(F.col("c"), language, blank_lines=False), c=code) == want


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_token_similarity(spark):
    rng = random.Random(1)
    pairs = [([rng.choice("abcdé") * rng.randint(1, 3) for _ in range(rng.randint(0, 30))], [rng.choice("abcdé") for _ in range(rng.randint(1, 30))]) for _ in range(50)] + [(["a"], ["a"]), (["a"], ["b"]), ([], [])]
    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", similarity.token_similarity(F.col("a"), F.col("b")).alias("s"), similarity.similarity_bound(F.size("a"), F.size("b")).alias("m")).collect()
    for r in rows:
        n = max(len(r["a"]), len(r["b"]))
        assert r["s"] == (None if not n else pytest.approx((1 - lev(r["a"], r["b"]) / n) * 100, abs=1e-4))
        assert n == 0 or r["s"] <= r["m"] + 1e-4


@pytest.mark.parametrize(("answer", "want"), [("```py\n[TASK_BEGIN] a [TASK_END]\n```", "a"), ("x [TASK_BEGIN]\nb\n[TASK_END]", "b"), ("```py\nc\n```", "c"), ("none", None), ("", ""), (None, ""), ("```c++\nd```", None)])
def test_extraction(spark, answer, want):
    assert one(spark, text.extract_code(F.col("c"), F.lit("py")), c=answer) == want


def test_extraction_quotes_the_language(spark):
    assert one(spark, text.extract_code(F.col("c"), F.lit("c++")), c="```c++\nd\n```") == "d"


@pytest.mark.parametrize(("kind", "lines", "passes"), [("block", 9, False), ("block", 10, True), ("class", 9, False), ("line", 4, False), ("line", 5, True)])
def test_gates(spark, kind, lines, passes):
    assert one(spark, quality.passes_gate(F.col("c"), F.lit(kind)), c="\n".join(["xx"] * lines)) is passes


def test_band_is_open(spark):
    rows = spark.createDataFrame([(10.0,), (10.0001,), (49.9999,), (50.0,)], "s double").select(quality.in_band(F.col("s")).alias("k")).collect()
    assert [r["k"] for r in rows] == [False, True, True, False]


def test_shown_score(spark):
    rows = spark.createDataFrame([(99.9,), (None,), (-3.0,), (120.0,)], "s double").select(text.shown_score(F.col("s")).alias("k")).collect()
    assert [r["k"] for r in rows] == [99, 0, 0, 100]


def test_mask_is_lossless_in_bytes(spark):
    code = "é中x\n" * 5
    r = one(spark, text.masked(F.col("c"), F.lit(5), F.lit(12)), c=code)
    assert r["prefix"] + r["middle"] + r["suffix"] == code and r["middle"].encode() == code.encode()[5:12]


def test_bm25(spark):
    import math

    docs, query = [["a", "b"], ["c"], ["a", "a", "d", "e"]], ["a", "a", "c"]
    corpus = spark.createDataFrame([("r", i, d) for i, d in enumerate(docs)] + [("other", 0, ["a"])], "repo string, path long, tokens array<string>")
    asked = spark.createDataFrame([("s", "r", None, query), ("t", "r", 2, query), ("u", "none", None, query), ("v", "r", None, [])], "sample_id string, repo string, path long, tokens array<string>")
    got = {(r["sample_id"], r["path"]): r["bm25"] for r in relevance.bm25(corpus, asked).collect()}
    assert set(got) == {(s, i) for s, own in (("s", None), ("t", 2), ("v", None)) for i in range(3) if i != own}
    for s, own, words in (("s", None, query), ("t", 2, query), ("v", None, [])):
        every = [words, *(d for i, d in enumerate(docs) if i != own)]
        n, mean = len(every), sum(map(len, every)) / len(every)
        for i, d in enumerate(docs):
            if i != own:
                want = sum(math.log((n - df + 0.5) / (df + 0.5) + 1) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in words if (df := sum(t in x for x in every)))
                assert got[s, i] == pytest.approx(want)


def test_rank_ties_and_nan(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0), ("a", 3, 5.0), ("b", 1, 0.0), ("b", 2, 0.0)], "sample_id string, path long, bm25 double")
    got = [(r["sample_id"], r["path"]) for r in relevance.ranked(rows).orderBy("sample_id", "rank").collect()]
    assert got == [("a", 3), ("a", 2), ("a", 1), ("b", 2), ("b", 1)]


def test_scores_and_report(spark):
    rows = [("1", "m", "python", "CLASS_TYPE", "a b", "```python\na b # c\n```"), ("2", "m", "python", "LINE_TYPE", "a", "nothing"), ("3", "m", "python", "LINE_TYPE", "", "x"), ("4", "m", "java", "odd", "x", "```java\nx\n```")]
    done = score.scored(spark.createDataFrame(rows, "sample_id string, model string, language string, fill_type string, true_code string, answer string"))
    assert {r["sample_id"]: r["similarity"] for r in done.collect()} == {"1": 100.0, "4": 100.0}
    assert [tuple(r) for r in score.report(done).collect()] == [("python", 100, 0, 0, 0)]


def test_failed_row_carries_its_error(spark):
    def client(messages, model):
        raise TimeoutError("late")

    tasks = spark.createDataFrame([("1", "m", [("user", "x")])], "sample_id string, model string, messages array<struct<role:string,content:string>>")
    assert [tuple(r) for r in prompt.infer(tasks, client).collect()] == [("1", "m", "", "TimeoutError: late")]


def test_counts_of_a_run(spark):
    rows = spark.createDataFrame([("a", None), ("", None), (None, "E: x"), ("", "E: y")], "answer string, error string").repartition(2)
    kept, seen = metrics.counted(rows)
    assert kept.count() == 4 and seen.get == {"n": 4, "failed": 2, "empty": 1}
    assert metrics.within_budget(rows, 2) and not metrics.within_budget(rows, 1)
    assert sum(r["n"] for r in metrics.by_worker(rows).collect()) == 4


def test_parsers_never_fail():
    assert nodes.parse(None, "html") == [] and nodes.parse("def (", "python") == []
    found = nodes.parse("<div>é<b>x</b><br/></div>", "html")
    assert [(n[4], n[1]) for n in found] == [("div", None), ("b", 0)] and found[1][5:] == (7, 15)
    kinds = [n[3] for n in nodes.parse('import a.B;\nclass A {\n int f(int x) { if (x > 0) { return 1; } return "}{"; }\n}', "java")]
    assert kinds[:4] == ["import_declaration", "class_declaration", "function_declaration", "if_statement"] and kinds.count("return_statement") == 2


def test_skeletons_of_odd_code():
    assert skeletons.class_skeleton("class A:\n  x = 1", "python") is None
    assert skeletons.class_skeleton("x", "html") is None
    assert skeletons.function_skeleton("fn f(x: i32) -> i32 {\n x\n}", "rust") == "fn f(x: i32) -> i32 {}"
    assert skeletons.function_skeleton("func f() -> Int {\n 1 }", "swift") == "func f() -> Int { }"
