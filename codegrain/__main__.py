"""python -m codegrain COMMAND: the plans on files. Each command reads and writes folders that Spark can reach."""

from __future__ import annotations

import argparse
import functools

from pyspark.sql import DataFrame, SparkSession

from codegrain.plans import construct, score
from codegrain.sources import jsonl


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="codegrain")
    commands = parser.add_subparsers(dest="command", required=True)
    make = commands.add_parser("construct", help="tasks from a folder of repositories, as Parquet")
    make.add_argument("--repos", required=True)
    make.add_argument("--language", required=True, nargs="+", help="one or more, all in one plan")
    make.add_argument("--levels", nargs="*", default=[], help="class, function, block, line; all if none is given")
    make.add_argument("--per-repo", type=int, default=5)
    make.add_argument("--attempts", type=int, default=3)
    make.add_argument("--top-up", action="store_true", help="draw attempts of a repository in rounds, up to per-repo times attempts, until it has enough tasks of any level")
    make.add_argument("--context", type=int, default=5, help="other files that each task gets, the most relevant first")
    make.add_argument("--out", required=True)
    keep = commands.add_parser("keep", help="tasks that answers neither fail nor solve, as records")
    keep.add_argument("--tasks", required=True)
    keep.add_argument("--answers", required=True, help="JSON Lines of sample_id, model, try, answer")
    keep.add_argument("--per-repo", type=int, default=5)
    keep.add_argument("--low", type=float, default=10)
    keep.add_argument("--high", type=float, default=50)
    keep.add_argument("--out", required=True)
    report = commands.add_parser("report", help="a row for each language from scored records, as JSON")
    report.add_argument("--scored", required=True)
    report.add_argument("--out", required=True)
    return parser


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    asked = _parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("codegrain").getOrCreate()
    if asked.command == "construct":
        files = functools.reduce(DataFrame.unionByName, (jsonl.read_sources(spark, asked.repos, language) for language in asked.language))
        if asked.top_up:
            made, _ = construct.topped_up_tasks(files, asked.per_repo, asked.attempts, weights=dict.fromkeys(asked.levels, 1.0) or None)
        else:
            made = construct.tasks(files, asked.per_repo, asked.attempts, levels=tuple(asked.levels))
        made = construct.stored(made)
        made.join(construct.best_context(made, files, asked.context), "sample_id", "left").write.mode("overwrite").parquet(asked.out)
    elif asked.command == "keep":
        answers = jsonl.read_jsonl(spark, asked.answers, "sample_id string, model string, try int, answer string")
        tasks = spark.read.parquet(asked.tasks)
        kept = construct.kept_tasks(tasks.drop("context_code"), answers, asked.per_repo, asked.low, asked.high)
        jsonl.write_scored(construct.records(kept, tasks.select("sample_id", "context_code")), asked.out)
    else:
        rows = spark.read.schema(jsonl.RECORD).option("recursiveFileLookup", True).json(asked.scored)
        score.report(rows.selectExpr("inference_info.language_type AS language", "inference_info.fill_type AS fill_type", "editdistance_info.edit_distance AS similarity")).write.mode("overwrite").json(asked.out)


if __name__ == "__main__":
    main()
