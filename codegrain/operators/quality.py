"""Gates, bands, keep-first deduplication and bounded picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegrain.functions.text import let, strip, uniform


def passes_gate(middle: Column, grain: Column) -> Column:
    """At least ten lines, or five lines and ten characters for a line sample."""
    lines = F.size(F.split(middle, "\n"))
    return F.when(F.length(middle) == 0, False).when(grain == "line", (lines >= 5) & (F.length(middle) >= 10)).otherwise(lines >= 10)


def in_band(similarity: Column, low: float = 10, high: float = 50) -> Column:
    """Strictly between: neither too hard nor already solved."""
    return (similarity > low) & (similarity < high)


def good_code(text: Column) -> Column:
    """Plausible code: average line under 50 and longest under 100 characters, letters and digits between a tenth and all
    of it, 11 to 1023 words; all bounds open. Cheap conditions come first and each text is cut into lines once."""
    inside = lambda x, a, b: (x > a) & (x < b)
    lengths = F.transform(F.split(strip(text), "\n"), lambda x: F.length(x))
    mean = lambda n: F.try_divide(F.aggregate(n, F.lit(0).cast("long"), lambda s, x: s + x).cast("double"), F.size(n).cast("double"))
    lines = let(lengths, lambda n: inside(F.array_max(n), 1, 100) & inside(mean(n), 1, 50))
    share = lambda c: inside(F.try_divide(F.length(c).cast("double"), F.length(text).cast("double")), 0.1, 1)
    letters = let(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""), lambda c: share(c) & share(F.regexp_replace(c, r"\p{N}+", "")))
    words = inside(F.regexp_count(text, F.lit(r"(?U)\S+")), 10, 1024)
    return F.when(lines & words, F.coalesce(letters, F.lit(False))).otherwise(F.lit(False))


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """One row for each key, the first by order: a minimum combined before the shuffle finds it, then a semi join."""
    first = df.groupBy(key.alias("_key")).agg(F.min(order).alias("_first"))
    return df.join(first, (key == F.col("_key")) & (F.col(order) == F.col("_first")), "left_semi")


def first_n(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; tasks keep n of a group before anything is shuffled."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def weighted_choice(weights: dict[str, float], counts: dict[str, Column], *keys: Column) -> Column:
    """A name drawn by weight among those with a count above 0, by a hash of the keys; null if none is left."""
    live = {k: F.when(counts[k] > 0, F.lit(float(w))).otherwise(0.0) for k, w in weights.items()}
    total = sum(live.values(), F.lit(0.0))
    u, out, at = uniform(*keys) * total, F.lit(None).cast("string"), F.lit(0.0)
    edges = []
    for k, w in live.items():
        at = at + w
        edges.append((k, w, at))
    for k, w, edge in reversed(edges):
        out = F.when((w > 0) & (u < edge), k).otherwise(out)
    return F.when(total > 0, out)


def weighted_sample(df: DataFrame, strata: list[str], weight: Column, keys: list[str], k: int, seed: int = 7) -> DataFrame:
    """df with rank, from 1: k rows of each stratum without replacement, a row drawn next with a chance of its weight among those
    that are left. Each row gets an exponential of its weight's rate by a hash of its keys, and the k smallest stay, so tasks keep k
    of a stratum before anything is shuffled, whatever its size. Rows without a weight above 0 are never drawn; rows with equal
    keys have equal draws."""
    arrival = -F.log(1 - uniform(*map(F.col, [*strata, *keys]), F.lit(seed))) / weight
    drawn = df.withColumn("_arrival", F.when(weight > 0, arrival)).where("_arrival is not null")
    return first_n(drawn, strata, ["_arrival", *keys], k).drop("_arrival")
