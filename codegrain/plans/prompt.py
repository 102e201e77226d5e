"""Prompts for code completion and the connector through which models answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrain.functions.text import after_thinking

NO_SKELETON = "no skeleton"


def system_text(language: Column) -> Column:
    return F.concat(F.lit("You are an expert in "), language, F.lit(". From the code before and after a gap and a description, write the missing code only, in a fenced "), language, F.lit(" block between [TASK_BEGIN] and [TASK_END]. For classes and functions follow the skeleton."))


def user_text(language: Column, grain: Column, prefix: Column, suffix: Column, description: Column, skeleton: Column) -> Column:
    empty = lambda c, other: F.coalesce(c, F.lit(other))
    return F.concat(
        F.lit("Complete the "), grain, F.lit(".\n```"), language, F.lit("\n"), empty(prefix, ""), F.lit("[TASK_START]\n[TASK_DESCRIPTION "), empty(description, "none"), F.lit("]\n[SKELETON "), empty(skeleton, NO_SKELETON), F.lit("]\n[TASK_END]"), empty(suffix, ""), F.lit("\n```"),
    )


def messages(model: Column, system: Column, user: Column) -> Column:
    """array<struct<role, content>>; models of the o1 kind get one merged message, chat models of the Qwen3 kind are told
    not to think."""
    user = F.when(model.rlike(r"Qwen3-[0-9.]+B-Chat"), F.concat(user, F.lit(" /no_think"))).otherwise(user)
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.when(model.contains("o1"), F.array(one("user", F.concat(system, F.lit("\n"), user)))).otherwise(F.array(one("system", system), one("user", user)))


def replay(tasks: DataFrame, completions: DataFrame) -> DataFrame:
    """tasks with the answers of a table completions (sample_id, model, text, error) instead of a network."""
    answers = completions.select("sample_id", "model", after_thinking(F.col("text")).alias("answer"), "error")
    return tasks.join(answers, ["sample_id", "model"], "left")


def infer(tasks: DataFrame, client: Callable[[list[dict], str], str], at_once: int = 8) -> DataFrame:
    """(sample_id, model, answer, error): client(messages, model) for each row, at_once tasks at a time. A failure becomes
    a row with an empty answer and its error, so one bad row stops nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples():
                try:
                    rows.append((row.sample_id, row.model, client([dict(role=m["role"], content=m["content"]) for m in row.messages], row.model), None))
                except Exception as e:  # the row says what failed
                    rows.append((row.sample_id, row.model, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["sample_id", "model", "answer", "error"])

    asked = tasks.select("sample_id", "model", "messages").repartition(at_once)
    return asked.mapInPandas(run, "sample_id string, model string, answer string, error string").withColumn("answer", after_thinking(F.col("answer")))


def split_solved(tasks: DataFrame, created_by: str = "created_task_model", model: str = "model") -> tuple[DataFrame, DataFrame]:
    """(rows made by the model itself, which pass through unscored; the others)."""
    same = F.coalesce(F.lower(created_by) == F.lower(model), F.lit(False))
    return tasks.where(same), tasks.where(~same)
