"""Comment removal by pattern. Strings are not recognised: "http://x" loses what follows the slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codegrain.functions.text import FLAGS, drop_blank_lines

#: What each form of comment looks like.
FORMS = {
    "hash": r"(?<!^)#.*?(?=\n|$)",  # after something on its line
    "hash_line": r"^\s*#(?![!/]).*?(?=\n|$)",  # at the start of a line
    "double_quotes": r'"""[\s\S]*?"""',
    "single_quotes": r"'''[\s\S]*?'''",
    "slashes": r"//.*?(?=\n|$)",
    "three_slashes": r"///.*?(?=\n|$)",
    "slashes_bang": r"//!.*?(?=\n|$)",
    "block": r"/\*[\s\S]*?\*/",
    "dashes": r"--(?!\[\[).*?(?=\n|$)",
    "long_brackets": r"--\[\[[\s\S]*?\]\]",
    "begin_end": r"=begin[\s\S]*?=end",
    "pod": r"=pod[\s\S]*?=cut",
    "angle": r"<!--[\s\S]*?-->",
}
#: Forms that several languages share.
_C_LIKE = ("slashes", "block")
_SHELL_LIKE = ("hash", "hash_line")
#: Which forms a language has, in the order in which they are removed.
OF_LANGUAGE = {
    "python": ("hash", "double_quotes", "single_quotes", "hash_line"),
    **dict.fromkeys(("java", "javascript", "typescript", "c", "cpp", "go", "swift", "kotlin", "scala", "verilog", "zig"), _C_LIKE),
    "c_sharp": ("slashes", "three_slashes", "block"),
    "rust": ("slashes", "three_slashes", "block", "slashes_bang"),
    "php": ("hash", "slashes", "block", "hash_line"),
    "ruby": ("hash", "begin_end", "hash_line"),
    "perl": ("hash", "pod", "hash_line"),
    "r": _SHELL_LIKE,
    "lua": ("long_brackets", "dashes"),
    "html": ("angle",),
    "sql": ("dashes",),
}
#: What is removed where the language is unknown.
OTHERS = ("hash", "slashes", "three_slashes", "block", "dashes", "begin_end", "slashes_bang", "angle", "long_brackets", "pod", "hash_line")


def remove(code: Column, forms: tuple[str, ...]) -> Column:
    for name in forms:
        code = F.regexp_replace(code, FLAGS + FORMS[name], "")
    return code


def strip_comments(code: Column, language: str, blank_lines: bool = True) -> Column:
    """Code without comments and, unless told otherwise, without blank lines; null and blank code as it is."""
    out = remove(code, OF_LANGUAGE.get(language.lower(), OTHERS))
    return F.when(code.rlike(r"(?U)\S"), drop_blank_lines(out) if blank_lines else out).otherwise(code)


def strip_comments_by(code: Column, language: Column, blank_lines: bool = True) -> Column:
    """The same with the language in a column: only the branch taken is evaluated."""
    out = strip_comments(code, "", blank_lines)
    by_forms: dict[tuple[str, ...], list[str]] = {}
    for name, forms in OF_LANGUAGE.items():
        by_forms.setdefault(forms, []).append(name)
    for names in by_forms.values():
        out = F.when(F.lower(language).isin(names), strip_comments(code, names[0], blank_lines)).otherwise(out)
    return out
