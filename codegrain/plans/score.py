"""Scoring answers and reporting by language and grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.functions.comments import strip_comments_by
from codegrain.functions.similarity import token_similarity
from codegrain.functions.text import code_tokens, extract_code, fill_type, shown_score

GRAINS = ("class", "function", "block", "line")


def scored(answers: DataFrame, raw_models: tuple[str, ...] = ()) -> DataFrame:
    """(sample_id, model, language, fill_type, true_code, answer) with true_clean, predicted_clean and similarity.

    Code is taken out of the answer (of raw_models the answer is the code), comments go, and tokens are compared. Rows
    without code on either side are dropped, and so are those of which nothing is left.
    """
    code = F.when(F.col("model").isin(*raw_models), F.col("answer")).otherwise(extract_code(F.col("answer"), F.col("language"))) if raw_models else extract_code(F.col("answer"), F.col("language"))
    both = answers.withColumn("predicted", code).where("length(true_code) > 0 and length(predicted) > 0")
    clean = both.withColumns({"true_clean": strip_comments_by(F.col("true_code"), F.col("language")), "predicted_clean": strip_comments_by(F.col("predicted"), F.col("language"))})
    tokens = clean.withColumns({"_a": code_tokens(F.col("true_clean")), "_b": code_tokens(F.col("predicted_clean"))})
    return tokens.withColumn("similarity", token_similarity(F.col("_a"), F.col("_b"))).where("similarity is not null").drop("_a", "_b", "predicted")


def by_grain(scores: DataFrame) -> DataFrame:
    """(language, grain, mean_score, n); rows of no known grain or without a score don't count."""
    known = scores.select("language", fill_type(F.col("fill_type")).alias("grain"), "similarity").where("grain is not null and similarity is not null")
    return known.groupBy("language", "grain").agg(F.round(F.avg("similarity"), 6).alias("mean_score"), F.count("*").alias("n"))


def report(scores: DataFrame) -> DataFrame:
    """One row a language with the shown percent of each grain, 0 where there is none."""
    known = scores.select("language", fill_type(F.col("fill_type")).alias("grain"), "similarity").where("grain is not null and similarity is not null")
    wide = known.groupBy("language").pivot("grain", list(GRAINS)).agg(F.avg("similarity"))
    return wide.select("language", *(shown_score(F.col(g)).alias(g) for g in GRAINS))
