"""Similarity of texts, token sequences and vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(distance: Column, longest: Column) -> Column:
    """Edit distance as similarity in percent, four decimals; null if both sides are empty."""
    return F.round((F.lit(1.0) - F.try_divide(distance.cast("double"), longest.cast("double"))) * 100, 4)


def char_similarity(a: Column, b: Column) -> Column:
    return percent(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b)))


def token_distance(a: list | None, b: list | None) -> int | None:
    """Levenshtein distance of two sequences, by bit vectors: a row of the table is two integers with a bit for each
    element of a, so a step costs what the length of a over the word size says."""
    if a is None or b is None:
        return None
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    ones = (1 << len(a)) - 1
    last, up, down, distance = 1 << len(a) - 1, ones, 0, len(a)
    for x in b:
        same = where.get(x, 0)
        carried = (((same & up) + up) ^ up) | same | down
        rises, falls = down | (ones & ~(carried | up)), up & carried
        distance += bool(rises & last) - bool(falls & last)
        rises = rises << 1 | 1
        up, down = (falls << 1 | ones & ~(carried | rises)) & ones, rises & carried & ones
    return distance


def token_similarity(a: Column, b: Column) -> Column:
    """Levenshtein distance over whole tokens as percent of the longer array, whole arrays however long."""

    @F.arrow_udf("long")
    def distance(x: pa.Array, y: pa.Array) -> pa.Array:
        """Tokens of a few rows at a time are Python's."""
        some = ((x.slice(at, 64).to_pylist(), y.slice(at, 64).to_pylist()) for at in range(0, len(x), 64))
        return pa.array([token_distance(s, t) for left, right in some for s, t in zip(left, right, strict=True)], pa.int64())

    return percent(distance(a, b), F.greatest(F.size(a), F.size(b)))


def similarity_bound(a: Column, b: Column) -> Column:
    """No pair of sequences of these sizes can be more similar: prunes before distances are computed."""
    return F.try_divide(F.least(a, b).cast("double"), F.greatest(a, b).cast("double")) * 100


def bag_distance(a: Column, b: Column) -> Column:
    """No edit distance of two texts is below this: the length of the longer one less the characters they share, places aside."""
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.least(count(a, c), count(b, c)))
    return F.greatest(F.length(a), F.length(b)) - F.when(F.length(a) == 0, 0).otherwise(shared)


def band_by_bounds(a: Column, b: Column, low: float = 10, high: float = 50) -> Column:
    """struct(band, how): which side of a band of similarity, open at both ends, two texts are on: 'hard' up to low, 'easy' from
    high on, 'kept' between; null if a side is null or both are empty. As with percent(), rounded to four decimals.

    The whole distance is never computed: lengths (how 'length') or characters in common ('bag') may rule out that it is small
    enough for the band, else a banded distance that gives up beyond a bound tells easy pairs, and a wider one kept from hard
    ones ('narrow', 'wide').
    """
    longest = F.greatest(F.length(a), F.length(b))
    # the largest distances of easy and of kept pairs, with what rounding adds
    most_easy = F.floor(longest * ((100 - high) / 100 + 5e-7) + 1e-9).cast("int")
    most_kept = F.floor(longest * ((100 - low) / 100 - 5e-7) - 1e-9).cast("int")
    told = lambda band, how: F.struct(F.lit(band).alias("band"), F.lit(how).alias("how"))
    within = lambda most: F.call_function("levenshtein", a, b, most) >= 0
    bound = bag_distance(a, b)
    wide = F.when(bound > most_kept, told("hard", "bag")).when(within(most_kept), told("kept", "wide")).otherwise(told("hard", "wide"))
    tell = F.when(F.abs(F.length(a) - F.length(b)) > most_kept, told("hard", "length")).when(bound > most_easy, wide).when(within(most_easy), told("easy", "narrow")).when(within(most_kept), told("kept", "wide")).otherwise(told("hard", "wide"))
    return F.when(a.isNotNull() & b.isNotNull() & (longest > 0), tell)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Cells of a table of runs, above which matches are sought without one.
RUNS = 1 << 24


def matched(a: str, b: str) -> int:
    """How many characters difflib's matching blocks have: the longest run in common, of equal ones the first in a and then in b,
    and so on to both sides of it. The table of runs (for each pair of places the length of the common run that ends there) is
    made once, by rows; a part of the texts takes a part of it, in which no run is longer than the part."""
    if not a or not b:
        return 0
    if len(a) * len(b) > RUNS or min(len(a), len(b)) >= 1 << 15:
        from difflib import SequenceMatcher

        return sum(block.size for block in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    left, right = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b))
    masks = {c: (right == c).astype(np.int16) for c in np.unique(left).tolist()}
    runs = np.zeros((len(a) + 1, len(b) + 1), np.int16)
    for i, c in enumerate(left.tolist()):
        np.add(runs[i, :-1], 1, out=runs[i + 1, 1:])
        runs[i + 1, 1:] *= masks[c]
    upto = np.minimum(np.arange(1, max(len(a), len(b)) + 1), (1 << 15) - 1).astype(np.int16)  # no run is longer
    total, parts = 0, [(0, len(a), 0, len(b))]
    while parts:
        a0, a1, b0, b1 = parts.pop()
        within = np.minimum(runs[a0 + 1 : a1 + 1, b0 + 1 : b1 + 1], upto[: b1 - b0])
        np.minimum(within, upto[: a1 - a0, None], out=within)
        i, j = divmod(int(within.argmax()), b1 - b0)
        size = int(within[i, j])
        if size:
            total += size
            i, j = a0 + i + 1 - size, b0 + j + 1 - size
            parts += [p for p in ((a0, i, b0, j), (i + size, a1, j + size, b1)) if p[0] < p[1] and p[2] < p[3]]
    return total


def fuzzy_ratio():
    """Pandas UDF (a, b) -> whole percent: twice the matched characters over all, by matching blocks."""

    def percent_of(a: str, b: str) -> int:
        return round(100 * (2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0))

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else percent_of(x.strip(), y.strip()) for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio
