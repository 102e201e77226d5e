"""From files to kept tasks, against plain versions of each step."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codegrain.operators import nodes, paths, ranking, skeletons
from codegrain.plans import construct
from codegrain.sources import jsonl
from tests.test_whole_queries import percent


def body(i, n):
    lines = "\n".join(f"    value_{i}_{k} = helper_{k % 3}({k})  # note" for k in range(n))
    return f"import util{i % 2}\nfrom pkg import tool\n\n\ndef work_{i}(x):\n{lines}\n    return x\n"


@pytest.fixture(scope="module")
def files(spark):
    rows = [(f"r{i % 2}", f"src/util{i}.py", "python", body(i, 9 + i)) for i in range(6)] + [("r0", "empty.py", "python", ""), ("r0", "null.py", "python", None), ("r1", "bad.py", "python", "def (")]
    return spark.createDataFrame(rows, "repo_name string, path string, language string, code string")


@pytest.fixture(scope="module")
def made(files):
    return construct.tasks(files, per_repo=None)


def test_tasks_join_to_their_files(made, files):
    code = {r["path"]: r["code"] for r in files.collect()}
    rows = made.collect()
    assert {r["grain"] for r in rows} >= {"function"}
    for r in rows:
        whole = code[r["path"]]
        assert whole.startswith(r["prefix"]) and whole.endswith(r["suffix"])
        raw = whole[len(r["prefix"]) : len(whole) - len(r["suffix"])]
        assert r["middle"] == "\n".join(x for x in re.sub("(?m)(?<!^)#.*$", "", raw).split("\n") if x.strip())
        assert len(r["middle"].split("\n")) >= (5 if r["grain"] == "line" else 10)
        assert r["grain"] != "function" or r["skeleton"].strip().startswith("def work_")
    assert len({r["sample_id"] for r in rows}) == len(rows)
    assert len({(r["repo_name"], r["grain"], r["middle"]) for r in rows}) == len(rows)


def test_levels_choose_the_grain(files):
    assert {r["grain"] for r in construct.tasks(files, levels=("function",)).collect()} == {"function"}
    assert construct.tasks(files, levels=("nothing",)).count() == 0
    assert paths.ratios("Block") == {"class": 0.0, "function": 0.0, "block": 1.0, "line": 0.0}


def test_context_ranks_the_other_files(made, files):
    held = {(r["repo_name"], r["path"]): re.findall(r"\w+|[^\w\s]", r["code"] or "") for r in files.collect()}
    asked = {r["sample_id"]: r for r in made.collect()}
    got = {}
    for r in construct.task_context(made, files, installed=("pkg",)).collect():
        got.setdefault(r["sample_id"], []).append((r["rank"], r["path"], r["relevance"]))
    assert set(got) == set(asked)
    for sample, ranks in got.items():
        task = asked[sample]
        text = task["prefix"] + task["middle"] + task["suffix"]
        query = re.findall(r"\w+|[^\w\s]", text)
        others = {p: t for (repo, p), t in held.items() if repo == task["repo_name"] and p != task["path"] and t is not None}
        corpus = [query, *others.values()]
        mean = sum(map(len, corpus)) / len(corpus)
        df = Counter(t for d in corpus for t in set(d))
        idf = {t: math.log((len(corpus) - n + 0.5) / (n + 0.5) + 1) for t, n in df.items()}
        score = {p: sum(idf[t] * Counter(d)[t] * 2.5 / (Counter(d)[t] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in query) for p, d in others.items()}
        modules = [m for m in nodes.imports_of(text) if m.split(".")[0] != "pkg"]
        want = {p: sum(f"{m}.py" in p for m in modules) + s / sum(score.values()) for p, s in score.items()}
        assert [x[0] for x in sorted(ranks)] == list(range(1, len(want) + 1))
        assert {p: round(v, 9) for _, p, v in ranks} == {p: round(v, 9) for p, v in want.items()}
        found = [round(want[p], 9) for _, p, _ in sorted(ranks)]
        assert found == sorted(found, reverse=True)


def test_the_band_keeps_what_is_neither_lost_nor_solved(spark, made, tmp_path):
    rows = made.collect()
    answers = []
    for i, r in enumerate(rows):
        lines = r["middle"].split("\n")
        cut = "\n".join(lines[: max(1, len(lines) * (i % 4 + 1) // 5)])
        answers += [(r["sample_id"], "m", 0, ""), (r["sample_id"], "m", 1, f"```python\n{cut}\n```"), (r["sample_id"], "m", 2, f"```python\n{r['middle']}\n```"), (r["sample_id"], "n", 0, None)]
    kept = construct.kept_tasks(made, spark.createDataFrame(answers, "sample_id string, model string, try int, answer string"), per_repo=None)
    words = lambda x: re.findall(r"\w+|[^\w\s]", x)
    want = {}
    for r, (_, _, _, a) in zip(rows, answers[1::4], strict=True):
        s = percent(words(r["middle"]), words(a[10:-4]))
        if 10 < s < 50:
            want[r["sample_id"]] = s
    assert want and {r["sample_id"]: r["similarity"] for r in kept.collect()} == want
    contexts = spark.createDataFrame([(s, [("p.py", "x = 1")]) for s in want], "sample_id string, context_code array<struct<path:string,code:string>>")
    jsonl.write_scored(construct.records(kept, contexts), f"{tmp_path}/out")
    back = spark.read.schema(jsonl.RECORD).json(f"{tmp_path}/out/*/*")
    assert {round(r["editdistance_info"]["edit_distance"], 4) for r in back.collect()} == set(want.values())
    assert back.first()["context_code"] == [["p.py", "x = 1"]] and back.first()["task_instance_info"]["created_time"]


def test_commands(spark, tmp_path):
    import json

    from codegrain.__main__ import main

    (tmp_path / "repos/a/src").mkdir(parents=True)
    for i in range(3):
        (tmp_path / f"repos/a/src/m{i}.py").write_text(body(i, 12 + i))
    main(["construct", "--repos", str(tmp_path / "repos"), "--language", "python", "--levels", "function", "--out", str(tmp_path / "tasks")], spark)
    made = spark.read.parquet(str(tmp_path / "tasks")).collect()
    assert {r["grain"] for r in made} == {"function"} and len(made) == 3
    (tmp_path / "answers.jsonl").write_text("\n".join(json.dumps({"sample_id": r["sample_id"], "model": "m", "try": 0, "answer": "```python\n" + "\n".join(r["middle"].split("\n")[:5]) + "\n```"}) for r in made))
    main(["keep", "--tasks", str(tmp_path / "tasks"), "--answers", str(tmp_path / "answers.jsonl"), "--out", str(tmp_path / "kept")], spark)
    main(["report", "--scored", str(tmp_path / "kept"), "--out", str(tmp_path / "report")], spark)
    records = spark.read.schema(jsonl.RECORD).option("recursiveFileLookup", True).json(str(tmp_path / "kept")).collect()
    for r in records:  # every task has the two other files
        assert sorted(p for p, _ in r["context_code"]) == sorted(f"src/m{i}.py" for i in range(3) if not r["file_name"].endswith(f"m{i}.py"))
        assert all(code == body(int(p[-4]), 12 + int(p[-4])) for p, code in r["context_code"])
    shown = spark.read.json(str(tmp_path / "report")).first()
    assert shown["language"] == "python" and 10 < shown["function"] < 50 and shown["class"] == 0


def test_construct_of_several_languages_in_rounds(spark, tmp_path):
    from codegrain.__main__ import main

    (tmp_path / "repos/a").mkdir(parents=True)
    for i in range(3):
        (tmp_path / f"repos/a/m{i}.py").write_text(body(i, 12 + i))
    lines = "\n".join(f"    int v{k} = {k};" for k in range(14))
    (tmp_path / "repos/a/M.java").write_text(f"class M {{\n  int f(int x) {{\n{lines}\n    return x;\n  }}\n}}\n")
    main(["construct", "--repos", str(tmp_path / "repos"), "--language", "python", "java", "--levels", "function", "--top-up", "--per-repo", "4", "--attempts", "10", "--context", "1", "--out", str(tmp_path / "tasks")], spark)
    made = spark.read.parquet(str(tmp_path / "tasks")).collect()
    assert len(made) == 4 and {r["language"] for r in made} == {"python", "java"} and {r["grain"] for r in made} == {"function"}
    assert all(len(r["context_code"]) == 1 for r in made)


RUBY = "class A\n  def f(x)\n    if x\n      y = 1\n    else\n      y = 2\n    end\n    return y\n  end\nend\n"
LUA = "local m = require('m')\nfunction f(a)\n  for i = 1, 3 do\n    a = a + i\n  end\n  return a\nend\n"
VERILOG = "module m(input a);\n  always @(posedge a) begin\n    if (a) begin\n      b <= 1;\n    end\n  end\nendmodule\n"
GO = "import \"fmt\"\nfunc f(a int) int {\n  for i := 0; i < 3; i++ {\n    fmt.Println(i)\n  }\n  return a\n}\n"


@pytest.mark.parametrize(
    ("language", "code", "kinds"),
    [
        ("ruby", RUBY, ["class", "method", "if", "assignment_statement", "assignment_statement", "return_statement"]),
        ("lua", LUA, ["import_declaration", "function_declaration", "for_statement", "assignment_statement", "return_statement"]),
        ("verilog", VERILOG, ["module_declaration", "block", "if_statement", "assignment_statement"]),
        ("go", GO, ["import_declaration", "function_declaration", "for_statement", "expression_statement", "return_statement"]),
        ("swift", "func f(a: Int) -> Int {\n  let b = a\n  return b\n}\n", ["function_declaration", "assignment_statement", "return_statement"]),
        ("r", "f <- function(x) {\n  y = x + 1\n  return(y)\n}\n", ["function_declaration", "assignment_statement", "return_statement"]),
    ],
)
def test_languages_without_semicolons_have_nodes(language, code, kinds):
    found = nodes.parse(code, language)
    assert [n[3] for n in found] == kinds
    raw = code.encode()
    assert all(0 <= n[5] < n[6] <= len(raw) for n in found)
    assert all(found[n[1]][5] <= n[5] and n[6] <= found[n[1]][6] for n in found if n[1] is not None)


def test_names_and_signatures():
    assert nodes.definition_name(RUBY, "ruby") == "A" and nodes.definition_name(GO, "go") == "f" and nodes.definition_name("x = 1", "python") is None
    assert skeletons.signature("int A::f(int x, g(y)) const { }") == ("A::f", "int x, g(y)") and skeletons.signature(None) is None


SKELETONS = {
    "java": ("class A {\n  int n;\n  int f(int x) { return x; }\n}", "class A\n{\nint n;\nint f(int x) {}\n}", "int f(int x) { return x; }", "int f(int x) {}"),
    "c_sharp": ("class A : B {\n  int F(int x) { return x; }\n}", "class A : B\n{\nint F(int x) {}\n}", "int F(int x) { return x; }", "int F(int x) {}"),
    "typescript": ("class A {\n  f(x: number): number { return x; }\n}", "class A\n{\nf(x: number): number {}\n}", "function f(x: number) { return x; }", "function f(x: number) {}"),
    "javascript": ("class A {\n  f(x) { return x; }\n}", "class A\n{\nf(x) {}\n}", "function f(x) { return x; }", "function f(x) {}"),
    "php": ("class A {\n  function f($x) { return $x; }\n}", "class A\n{\nfunction f($x) {}\n}", "function f($x) { return $x; }", "function f($x) {}"),
    "cpp": ("class A {\npublic:\n  int f(int x) { return x; }\n};", "class A\n{\npublic: int f(int x) {}\n};", "int f(int x) { return x; }", "int f(int x) {}"),
    "c": ("struct a { int n; };", None, "int f(int x) { return x; }", "int f(int x) {}"),
    "go": ("type A struct {\n n int;\n}", "type A struct\n{\nn int;\n}", "func f(x int) int { return x }", "func f(x int) int {}"),
    "rust": ("impl A { fn f(x: i32) -> i32 { x } }", "impl A {}", "fn f(x: i32) -> i32 { x }", "fn f(x: i32) -> i32 {}"),
    "kotlin": ("class A(val x: Int) { fun f() = x }", "class A(val x: Int) {}", "fun f(x: Int): Int { return x }", "fun f(x: Int): Int {}"),
    "scala": ("class A(x: Int) { def f = x }", "class A(x: Int) {}", "def f(x: Int): Int = { x }", "def f(x: Int): Int = {}"),
    "swift": ("class A { func f() { } }", "class A { }", "func f(x: Int) -> Int { return x }", "func f(x: Int) -> Int { }"),
    "zig": ("const A = struct { n: i32 };", "const A = struct { }", "fn f(x: i32) i32 { return x; }", "fn f(x: i32) i32 { }"),
    "perl": ("package A { sub f { 1 } }", "package A { }", "sub f { my $x = 1; }", "sub f { }"),
    "r": ("A <- function(x) { x }", "A <- function(x) {}", "f <- function(x) { x }", "f <- function(x) {}"),
    "ruby": ("class A\n  def f(x)\n    x\n  end\nend", "class A\n  def f(x)\n  end\nend", "def f(x)\n  x\nend", "def f(x) end"),
    "lua": ("A = {}", "A = end", "function f(x)\n  return x\nend", "function f(x) end"),
    "verilog": ("module m;\nendmodule", None, "function f;\n f = 1;\nendfunction", "function f; endfunction"),
    "python": ("class A:\n    def f(self):\n        return 1\n", "class A:\n    def f(self):\n        pass", "def f(x):\n    return x\n", "def f(x):\n    pass"),
    "html": ("<div></div>", None, "<a></a>", None),
}


@pytest.mark.parametrize("language", sorted(SKELETONS))
def test_skeletons(language):
    of_class, class_, of_function, function = SKELETONS[language]
    assert skeletons.class_skeleton(of_class, language) == class_
    assert skeletons.function_skeleton(of_function, language) == function


def test_ranks_in_groups_of_any_size(spark):
    rows = [("big", i * 7 % 1000) for i in range(1000)] + [(None, i) for i in range(5)] + [(f"g{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(5)
    got = ranking.ranked_in(df, ["g"], [F.desc("v")])
    assert got.columns == ["g", "v", "rank"]
    want = {("big", v): 1000 - v for v in range(1000)} | {(None, v): 5 - v for v in range(5)} | {(f"g{i}", i): 1 for i in range(300)}
    assert {(r["g"], r["v"]): r["rank"] for r in got.collect()} == want
    assert ranking.ranked_in(df.limit(0), ["g"], [F.col("v")]).count() == 0


def test_closest_vectors_are_those_of_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:60] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 8), (901, None), (902, [None] * 8)]
    every = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = every.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in ranking.closest(asked, every, 5, block=64).collect():
        got.setdefault(r["query_id"], []).append((-r["cosine"], r["vec_id"]))
    d = x.astype(float)
    size = np.linalg.norm(d, axis=1)
    for q in range(0, 300, 20):
        c = [(-round(float((d[q] * d[v]).sum() / (size[q] * size[v])), 9), v) for v in range(300) if v != q]
        assert sorted(got.pop(q)) == sorted(c)[:5]
    assert not got


def test_tasks_are_topped_up(spark, files):
    """The same tasks whether attempts come in rounds or all at once, and whole files around each middle."""
    weights = {"function": 3.0, "line": 1.0}
    some, report = construct.topped_up_tasks(files, per_repo=2, factor=6, weights=weights)
    every, _ = construct.topped_up_tasks(files, per_repo=12, factor=1, weights=weights)
    rows, all_rows = some.collect(), sorted(every.collect(), key=lambda r: r["attempt"])
    want = {r["sample_id"] for repo in ("r0", "r1") for r in [x for x in all_rows if x["repo_name"] == repo][:2]}
    assert {r["sample_id"] for r in rows} == want and len(want) == len(rows)
    assert {r["grain"] for r in rows} <= set(weights)
    code = {(r["repo_name"], r["path"]): r["code"] for r in files.collect()}
    for r in rows:
        whole = code[r["repo_name"], r["path"]]
        assert whole.startswith(r["prefix"]) and whole.endswith(r["suffix"])
    drawn = {r["repo_name"]: (r["kept"], r["drawn"]) for r in report.collect()}
    assert set(drawn) == {"r0", "r1"} and all(k == 2 and d <= 12 for k, d in drawn.values()) and sum(d for _, d in drawn.values()) < 24


def test_the_tasks_of_every_page_ask(spark):
    from codegrain.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    sites = Counter(r["url"].split("/")[2] for r in spark.read.parquet(f"{sf}/pages.parquet").select("url").collect())
    asked = {r["sample_id"]: sites[r["repo_name"]] - 1 for r in QUERIES["construct_tasks"](spark, sf).select("sample_id", "repo_name").collect()}
    got = Counter(r["sample_id"] for r in QUERIES["construct_context"](spark, sf).select("sample_id").collect())
    assert got == {s: n for s, n in asked.items() if n} and len(got) > 10
