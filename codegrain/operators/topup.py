"""A number of successes for each group without drawing all attempts first.

Attempts of a group are numbered; an attempt succeeds or not, and the first `wanted` successes are what is asked for. Drawing
all attempts at once pays for many that nobody needs. Here they are drawn in rounds: a table holds what each group still
lacks, groups that have enough or no attempt left leave it, and the others draw the next attempts, as many as their own rate of
success so far says. Attempts are drawn in order and without gaps, so the result is that of drawing all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrain.operators.quality import first_n
from codegrain.sources.shared import discard, scratch

#: Rounds after which a group draws all it has left; each draws at least twice what the last did, so few come near.
ROUNDS = 12


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def next_draws(state: DataFrame, wanted: int, most: int) -> DataFrame:
    """state (group..., drawn, kept, last) with `more`: how many attempts each group draws next, 0 where it is done.

    What is lacking over the rate so far, which counts one attempt as half a success; at least what is lacking and twice the
    last draw if that found too little, never beyond `most` attempts.
    """
    lacking = F.lit(wanted) - F.col("kept")
    rate = (F.col("kept") + 0.5) / (F.col("drawn") + 1)
    asked = F.when(F.col("drawn") == 0, lacking).otherwise(F.greatest(lacking, 2 * F.col("last"), F.ceil(lacking / rate)))
    return state.withColumn("more", F.greatest(F.lit(0), F.when(lacking > 0, F.least(asked, F.lit(most) - F.col("drawn"))).otherwise(0)).cast("int"))


def top_up(groups: DataFrame, draw: Callable[[DataFrame], DataFrame], wanted: int, most: int, unlike: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(successes, report): the first `wanted` successes of each group by attempt, of the attempts 0 to most - 1. unlike: a
    column in which successes of a group must differ; of equal ones the first attempt counts.

    groups: one row for each group, all columns its key (no nulls). draw(asked) gets rows (group..., attempt int) and returns
    those that succeed, each attempt once at most, with any further columns; what it returns for an attempt must not depend on
    what else is asked. successes has rank, from 1. report: (group..., kept, drawn, rounds), groups without success too. Both
    are stored tables; a round costs one draw and sums by group that are combined before the shuffle.
    """
    spark, keys = groups.sparkSession, groups.columns
    state, at = _written(groups.dropDuplicates().select(*keys, *(F.lit(0).alias(c) for c in ("drawn", "kept", "last", "rounds"))))
    found = None
    for turn in range(ROUNDS):
        planned = next_draws(state, wanted, most)
        if turn == ROUNDS - 1:
            planned = planned.withColumn("more", F.when(F.col("more") > 0, most - F.col("drawn")).otherwise(0))
        open_ = planned.where("more > 0")
        if open_.isEmpty():
            break
        asked = open_.select(*keys, F.explode(F.sequence(F.col("drawn"), F.col("drawn") + F.col("more") - 1)).alias("attempt"))
        got = draw(asked)
        found, _ = _written(_unlike(got if found is None else found.unionByName(got), keys, unlike))
        now = found.groupBy(*keys).agg(F.count("*").cast("int").alias("_now"))
        after, path = _written(
            planned.drop("kept").join(now, keys, "left").select(
                *keys, (F.col("drawn") + F.col("more")).alias("drawn"), F.coalesce("_now", F.lit(0)).alias("kept"),
                F.when(F.col("more") > 0, F.col("more")).otherwise(F.col("last")).alias("last"), (F.col("rounds") + F.when(F.col("more") > 0, 1).otherwise(0)).alias("rounds"),
            )
        )
        discard(spark, at)
        state, at = after, path
    if found is None:
        found = draw(groups.select(*keys, F.lit(0).alias("attempt")).limit(0))
    return first_n(found, keys, ["attempt"], wanted), state.select(*keys, F.least("kept", F.lit(wanted)).alias("kept"), "drawn", "rounds")


def _unlike(found: DataFrame, keys: list[str], column: str | None) -> DataFrame:
    if column is None:
        return found
    rest = [c for c in found.columns if c not in (*keys, column)]
    first = found.groupBy(*keys, column).agg(F.min_by(F.struct(*rest), "attempt").alias("_first"))
    return first.select(*keys, column, "_first.*").select(found.columns)


def numbered(members: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """members with `place`, from 1, and `size` in their group, stored: what hashed draws pick from by a join on a number. A
    group may have any size."""
    from codegrain.operators.ranking import ranked_in

    placed, _ = _written(ranked_in(members, group, [F.col(c) for c in order], "place"))
    return placed.join(placed.groupBy(*group).agg(F.count("*").alias("size")), group)


def picked(asked: DataFrame, placed: DataFrame, group: list[str], u) -> DataFrame:
    """asked (group..., further columns) with one member each, the one at which a number u in [0, 1) points; groups without
    members drop out. placed comes from numbered()."""
    sizes = placed.where("place = 1").select(*group, "size")
    pointed = asked.join(sizes, group).withColumn("place", F.least(F.floor(u * F.col("size")) + 1, F.col("size")).cast("long")).drop("size")
    return pointed.join(placed.drop("size"), [*group, "place"]).drop("place")
