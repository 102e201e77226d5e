"""Rule-based quality filtering as a short-circuit cascade. DataFrame operations only.

Each rule is a condition over lazily computed metrics of a text. A bounded sample tells what share of documents a rule
rejects and what it costs to evaluate; the rules then run in the order of rejection per cost, and a document that one
rejects is not shown to the later ones. The order never changes which documents stay, only what it costs to know.
"""

from __future__ import annotations

import functools
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrain.llm.common import SPACE, WORD, fresh, stored

#: Rows that the estimate looks at, about, drawn by hash from the whole table.
SAMPLE_ROWS = 2_000
#: How often a timed job applies a rule to each of them.
REPEATS = 3


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text, which ASCII white space alone parts; none for null."""
    blank = F.lit(" \t\n\x0b\x0c\r")
    bare = F.trim(F.coalesce(text, F.lit("")), blank)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def word_chars(text: Column) -> Column:
    """Code points in words."""
    bare = functools.reduce(lambda c, space: F.replace(c, F.lit(space), F.lit("")), " \t\n\x0b\x0c\r", text)
    return F.coalesce(F.length(bare), F.lit(0)).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _covered(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in words.

    Windows are compared by hash first, which finds every repetition; only those whose hash recurs are compared as
    strings, sorted so that equal ones are neighbours. Nothing compares all windows with all.
    """
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))  # the last two are cut off
    return let(F.slice(hashes, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_repeated(words, h)))


def _neighbours(rows: Column, same) -> Column:
    """Rows of a sorted array that equal the row before or after them."""
    return F.filter(rows, lambda x, i: (F.coalesce(same(x, F.get(rows, i + 1)), F.lit(False))) | ((i > 0) & F.coalesce(same(x, F.get(rows, F.greatest(i - 1, F.lit(0)))), F.lit(False))))


def _repeated(words: Column, hashes: Column) -> Column:
    # hash and place in one long, as many low bits for the place as the text needs
    bits = F.length(F.bin(F.size(hashes).cast("long")))
    place = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def by_hash(low: Column) -> Column:
        packed = F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
        return let(F.array_sort(packed), lambda rows: _neighbours(rows, lambda x, y: x.bitwiseXOR(y).bitwiseAND(F.bitwise_not(low)) == 0))

    def exact(found: Column, low: Column) -> Column:
        window = lambda p: F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2))
        named = F.transform(found, lambda x: let(x.bitwiseAND(low).cast("int"), lambda p: F.struct(window(p).alias("w"), p.alias("p"))))
        return let(F.array_sort(named), lambda rows: _neighbours(rows, lambda x, y: x["w"] == y["w"]))

    def union(rows: Column) -> Column:
        """Words that windows of three from these places on cover together."""
        return let(F.array_sort(F.transform(rows, lambda x: x["p"])), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))

    return let(place, lambda low: let(by_hash(low), lambda found: let(exact(found, low), union)))


def n_repeat_words(text: Column) -> Column:
    return let(words_of(text), _covered)


#: Metrics by name, of a text column.
METRICS = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}


@dataclass(frozen=True)
class Rule:
    """rejects: from a function that gives a metric's column by its name, the condition under which a text goes."""

    name: str
    rejects: object


#: What is asked of a text. The first two are the base; the others leave plain prose in any language alone.
BASE = (
    Rule("too_short", lambda m: m("n_words") < 50),
    Rule("repeats", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
)
RULES = (
    *BASE,
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("word_length", lambda m: let(m("word_chars"), lambda chars: (chars < 2 * m("n_words")) | (chars > 14 * m("n_words")))),
    Rule("repeated_lines", lambda m: 4 * m("n_dup_lines") > m("n_words")),
)


#: The same for a corpus whose short texts are wanted: only those without a word are too short.
SHORT_TOO = (Rule("empty", lambda m: m("n_words") < 1), *RULES[1:])


def lazily(text: Column, verdict) -> Column:
    """verdict(metric) with metrics of a text computed where they are used, its words once for all."""
    of_words = {"n_words": lambda w: F.size(w).cast("long"), "n_repeat_words": _covered}
    return let(words_of(text), lambda w: verdict(lambda name: of_words[name](w) if name in of_words else METRICS[name](text)))


def ready(name: str) -> Column:
    """Metrics that the table has as columns."""
    return F.col(name)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, share rejected, seconds for a row) on about sample_rows rows, drawn by a hash of doc_id and text.

    One job tells the shares of all rules, and warms up what they use. A rule's seconds are those of one job that applies it
    several times to each row of the stored sample, less those of the same job with a rule that looks at nothing. Empty tables
    and samples reject nothing at no cost, and nothing is timed.
    """
    nothing_known = [(r.name, 0.0, 0.0) for r in rules]
    held = docs.count()
    if not held:
        return nothing_known
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(min(1.0, sample_rows / held) * (1 << 30))
    sample = stored(docs.where(drawn).select(F.col("text").cast("string").alias("text")))
    rejects = lambda rule: F.coalesce(lazily(F.col("text"), rule.rejects), F.lit(False))
    n, *rejected = sample.agg(F.count("*"), *(F.count_if(rejects(r)) for r in rules)).first()
    if not n:
        return nothing_known
    repeated = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("turn"))

    def timed(rule: Rule) -> float:
        job = repeated.agg(F.count_if(rejects(rule)))
        began = time.perf_counter()
        job.collect()
        return time.perf_counter() - began

    nothing = Rule("", lambda m: F.lit(False))
    timed(nothing)
    base = timed(nothing)
    return [(r.name, k / n, max(0.0, timed(r) - base) / (n * REPEATS)) for r, k in zip(rules, rejected, strict=True)]


def order(rules: tuple[Rule, ...], estimates: list[tuple[str, float, float]]) -> list[Rule]:
    """By rejection per cost, best first; rules that rejected nothing last, cheapest first. What costs less than a tenth of
    a microsecond can't be told apart."""
    worth = {name: (-share / max(cost, 1e-7), cost) for name, share, cost in estimates}
    return sorted(rules, key=lambda r: worth[r.name])


def cascade(rules: list[Rule], metric=ready) -> Column:
    """The name of the first rule that rejects a text, null if none: later branches are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects(metric), F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """documents (doc_id, text) with every metric, rejected_by and kept; input columns of these names are replaced.

    rejected_by is the first rule, as they were given, that rejects the text, so reruns agree; the verdict is that of the
    cascade in the order of the estimates, which is the same in any order. A null text has no words. Each row is judged by its own text alone, repeated rows alike; no rows, no result.
    """
    ordered = order(rules, estimate(docs, rules, sample_rows))
    text = F.col("text").cast("string")
    bare = docs.drop("rejected_by", "kept", *METRICS)
    (words,) = fresh(bare, "words")
    # what needs the words shares them
    shared = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _covered(w).alias("n_repeat_words")))
    measured = bare.withColumns({words: shared} | {name: of(text) for name, of in METRICS.items() if name not in ("n_words", "n_repeat_words")})
    measured = measured.withColumns({name: F.col(words)[name] for name in ("n_words", "n_repeat_words")}).drop(words)
    return measured.withColumns({"rejected_by": cascade(list(rules)), "kept": cascade(ordered).isNull()})


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, all columns as they were; a rejected one costs no later rule. Null and empty
    texts are too short and go; repeated rows stay or go together; no rows, no result."""
    ordered = order(rules, estimate(docs, rules, sample_rows))
    (verdict,) = fresh(docs, "rejected_by")
    return docs.withColumn(verdict, lazily(F.col("text").cast("string"), lambda metric: cascade(ordered, metric))).where(F.col(verdict).isNull()).drop(verdict)


ORACLE = r"""
WITH split_ AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT *, row_number() OVER () AS k, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM split_
), placed AS (
  SELECT k, unnest(g) AS g, unnest(range(1, len(g) + 1)) AS i FROM windows
), twice AS (
  SELECT k, i FROM placed QUALIFY count(*) OVER (PARTITION BY k, g) > 1
), covered AS (
  SELECT k, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS s(d) GROUP BY k
), counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM windows LEFT JOIN covered USING (k)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 4 * n_dup_lines > n_words) AS kept
FROM counted
"""
