"""Text expressions: all built-in functions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java flags under which a pattern means what it means in Python: \n alone ends lines, ^ and $ at lines, . any, Unicode classes.
FLAGS = "(?dmsU)"


#: The characters that Unicode calls white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(c, F.lit(SPACES))


def drop_blank_lines(code: Column) -> Column:
    return F.array_join(F.filter(F.split(code, "\n"), lambda line: line.rlike(r"(?U)\S")), "\n")


def has_cjk(c: Column) -> Column:
    """Whether a character of the main block of CJK ideographs occurs."""
    return c.rlike("[\\x{4e00}-\\x{9fff}]")


def after_thinking(c: Column) -> Column:
    """What follows the last </think>, stripped; the whole text without one."""
    return strip(F.substring_index(c, "</think>", -1))


def _first(text: Column, pattern: Column, group: int) -> Column:
    """Group of the first match, null without one."""
    return F.when(F.regexp_like(text, pattern), F.call_function("regexp_extract", text, pattern, F.lit(group)))


#: What marks code in an answer, after the opening of a fence of the language and elsewhere, and how classes are named.
MARKED_IN_FENCE = r"(?U)\s*\[TASK_BEGIN\](.*?)\[TASK_END\]\s*```"
MARKED = r"(?s)\[TASK_BEGIN\](.*?)\[TASK_END\]"
IN_FENCE = r"(?U)\s*(.*?)\s*```"
ANY_FENCE = r"(?s)```(.*?)\n(.*?)```"
PUBLIC_CLASS = r"(?U)public class\s+(\w*?)\s+\{"
CLASS_BRACE = r"(?U)class\s+(\w*?)\s+\{"
CLASS_NAME = r"(?U)class\s+(\w+)"


def extract_code(answer: Column, language: Column) -> Column:
    """Code of a model's answer: between the task markers in a fence of the language, else between bare markers, else in
    such a fence; stripped. '' for null or empty answers, null if nothing matches."""
    fence = F.concat(F.lit(r"(?s)```\Q"), language, F.lit(r"\E"))
    marked = _first(answer, F.concat(fence, F.lit(MARKED_IN_FENCE)), 1)
    bare = _first(answer, F.lit(MARKED), 1)
    fenced = _first(answer, F.concat(fence, F.lit(IN_FENCE)), 1)
    return F.when(F.coalesce(answer, F.lit("")) == "", "").otherwise(strip(F.coalesce(marked, bare, fenced)))


def first_fence(text: Column) -> Column:
    """Body of the first fenced block after its info line, the whole text without one."""
    return F.coalesce(_first(text, F.lit(ANY_FENCE), 2), text)


def public_class_name(code: Column) -> Column:
    """Main without a public class, else the name of the first class that opens a brace."""
    return F.when(code.rlike(PUBLIC_CLASS), F.regexp_extract(code, CLASS_BRACE, 1)).otherwise("Main")


def header_class_name(header: Column, stem: Column) -> Column:
    return F.coalesce(_first(header, F.lit(CLASS_NAME), 1), stem)


def fill_type(c: Column) -> Column:
    """class, function, block or line, by what the lower-cased name contains; null for others."""
    low = F.lower(c)
    out = F.lit(None).cast("string")
    for name in ("line", "block", "function", "class"):
        out = F.when(low.contains(name), name).otherwise(out)
    return out


def shown_score(mean: Column) -> Column:
    """Whole percent between 0 and 100, 0 for a missing mean."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(mean, F.lit(0.0)).cast("int")))


def words(c: Column) -> Column:
    """Runs of letters, digits and underscores in any script."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), 0)


def code_tokens(c: Column) -> Column:
    """Words and single signs: the tokenizer used where no vocabulary is given."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), 0)


def truncate(tokens: Column, most: int, side: str) -> Column:
    """The first tokens (side right) or the last (side left), at most so many."""
    if side not in ("left", "right"):
        raise ValueError("side is left or right")
    if side == "right":
        return F.slice(tokens, 1, most)
    return F.when(F.size(tokens) <= most, tokens).otherwise(F.slice(tokens, -most, most))


#: Names under which a language's grammar goes.
ALIASES = {"c++": "cpp", "c#": "c_sharp"}


def language_alias(c: Column) -> Column:
    low = F.lower(c)
    out = F.when(low.contains("sharp"), "c_sharp").otherwise(low)
    for name, known in ALIASES.items():
        out = F.when(low == name, known).otherwise(out)
    return out


def relative_path(path: Column, root: Column) -> Column:
    return F.replace(path, root, F.lit(""))


def result_path(path: Column, model: Column) -> Column:
    """Where a benchmark file's inference result goes."""
    stem = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    language = F.regexp_extract(path, r"bench/([^/]+)/", 1)
    return F.concat(F.lit("result/"), language, F.lit("/"), model, F.lit("/inference/"), stem, F.lit("_inference_result.jsonl"))


def similarity_path(path: Column) -> Column:
    return F.replace(F.replace(path, F.lit("/inference/"), F.lit("/similarity/")), F.lit("_inference_result"), F.lit("_similarity_result"))


def masked(code: Column, start: Column, end: Column) -> Column:
    """struct(prefix, middle, suffix) by byte offsets, which join to the code again.

    An offset inside a character moves back to where the character begins.
    """
    raw = F.encode(code, "UTF-8")
    inside = lambda at: F.hex(F.substring(raw, at + 1, F.lit(1))).between("80", "BF")
    border = lambda at: F.when(~inside(at), at).when(~inside(at - 1), at - 1).when(~inside(at - 2), at - 2).otherwise(at - 3)
    start, end = border(start), border(end)
    cut = lambda at, n: F.decode(F.substring(raw, at, n), "UTF-8")
    return F.struct(cut(F.lit(1), start).alias("prefix"), cut(start + 1, end - start).alias("middle"), cut(end + 1, F.octet_length(code) - end).alias("suffix"))


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the keys, the same in every engine that has md5."""
    text = F.concat_ws(":", *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
