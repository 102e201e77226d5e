"""Which models are known, with what settings, and how often a task is tried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SETTINGS = ("url", "api_key", "model_name", "if_inference", "temperature")


def allowed(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Rows whose model is in the list, upper and lower case told apart."""
    return rows.join(models.select("model"), "model", "left_semi")


def resolve(names: DataFrame, external: DataFrame, default: DataFrame, strict: bool = False) -> DataFrame:
    """names (model) with each setting from external, else from default. Unknown models get an empty url and no
    inference, or if strict fail."""
    side = lambda df, p: df.select("model", *(F.col(c).alias(f"{p}_{c}") for c in SETTINGS), F.lit(True).alias(f"{p}_known"))
    both = names.join(side(external, "x"), "model", "left").join(side(default, "d"), "model", "left")
    known = F.coalesce("x_known", "d_known", F.lit(False))
    if strict:
        both = both.where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("no settings for model "), "model")).cast("boolean")))
    picked = {c: F.coalesce(f"x_{c}", f"d_{c}") for c in SETTINGS} | {"url": F.coalesce("x_url", "d_url", F.lit("")), "if_inference": F.coalesce("x_if_inference", "d_if_inference", F.lit(False))}
    return both.select("model", *(v.alias(k) for k, v in picked.items()))


def attempts(tasks: DataFrame, wanted: int, factor: int = 3, retries: int = 3) -> DataFrame:
    """Each task once for every attempt (wanted times factor) and every try of it."""
    return tasks.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(wanted * factor - 1)))).withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(retries - 1))))


def first_success(tried: DataFrame, keys: list[str], success: str) -> DataFrame:
    """The first try of each attempt that succeeded."""
    return tried.where(success).groupBy(*keys, "attempt").agg(F.min("try").alias("try"))
