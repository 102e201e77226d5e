import json

import pytest

from codegrain.operators.paths import is_source
from codegrain.sources import jsonl


def test_jsonl_skips_what_is_broken(spark, tmp_path):
    file = tmp_path / "a.jsonl"
    file.write_text('{"repo_name": "r", "context_code": [["p", "c"]]}\n\n{"repo_name": \n{"file_name": "f", "other": 1}\n')
    (tmp_path / "b.txt").write_text("x")
    rows = jsonl.read_jsonl(spark, str(tmp_path)).where("repo_name is not null or file_name is not null").collect()
    assert {(r["repo_name"], r["file_name"]) for r in rows} == {("r", None), (None, "f")} and len(rows) == 2
    assert jsonl.malformed(spark, str(file)).count() == 1
    assert jsonl.read_jsonl(spark, str(file), most=1).count() == 1
    with pytest.raises(Exception):  # noqa: B017
        jsonl.read_jsonl(spark, str(file), strict=True).collect()


def test_write_and_read_again(spark, tmp_path):
    df = spark.createDataFrame([("r", "é"), ("s", None)], "repo_name string, file_name string")
    jsonl.write_jsonl(df, str(tmp_path / "out"), one_file=True)
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(lines, key=str) == [{"repo_name": "r", "file_name": "é"}, {"repo_name": "s"}]


def test_source_tree(spark, tmp_path):
    for path, content in {"r1/src/a.py": b"x = 1", "r1/tests/b.py": b"y", "r1/c.java": b"z", "build/d.py": b"w", ".git/e.py": b"v", "r2/bad.py": b"\xff\xfe", "r2/f.py": "é".encode()}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    rows = jsonl.read_sources(spark, str(tmp_path), "python").collect()
    assert sorted((r["repo_name"], r["path"], r["code"]) for r in rows) == [("r1", "src/a.py", "x = 1"), ("r2", "f.py", "é")]


@pytest.mark.parametrize(("path", "language", "kept"), [("a.d.ts", "typescript", False), ("index.d.ts", "typescript", True), (".x.js", "javascript", False), ("lib/a_test.lua", "lua", False), ("src/a.go", "go", True), ("a.xyz", "go", False), ("a.sql", "sql", False)])
def test_paths(spark, path, language, kept):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(path,)], "p string").select(is_source(F.col("p"), language).alias("k")).first()["k"] is kept
