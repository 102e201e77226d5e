"""Skeletons of classes and functions, and classes put together from C++ headers and sources, by text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codegrain.functions.text import header_class_name
from codegrain.operators.nodes import hushed

#: How a function without its body ends.
ENDINGS = {"swift": "{ }", "zig": "{ }", "perl": "{ }", "lua": "end", "ruby": "end", "verilog": "endfunction", "python": "pass"}
#: Languages whose classes are shown as a header only.
HEADER_ONLY = frozenset("scala kotlin perl swift zig verilog lua rust r".split())


def _signatures(code: str) -> list[str]:
    """Python signatures, each cut after the colon that ends it, with an indented pass."""
    out = []
    for line in code.split("\n"):
        bare = line.strip()
        if bare.startswith(("def ", "async def ")) and ")" in bare and ":" in bare:
            depth = 0
            for i, ch in enumerate(line):
                depth += (ch in "([{") - (ch in ")]}")
                if ch == ":" and not depth:
                    out += [line[: i + 1], " " * (len(line) - len(line.lstrip()) + 4) + "pass"]
                    break
    return out


def _body(code: str) -> int:
    """Where the body's brace is, -1 without one."""
    return hushed(code).find("{")


def _members(code: str) -> list[tuple[str, bool]]:
    """(text without its body, whether it has one) of what stands directly in the outer braces."""
    bare, out = hushed(code), []
    begin = bare.find("{") + 1
    if not begin:
        return out
    depth, body = 0, None
    for i in range(begin, len(bare)):
        ch = bare[i]
        if ch == "{":
            if not depth:
                body = i
            depth += 1
        elif ch == "}":
            if not depth:
                break
            depth -= 1
            if not depth:
                out.append((code[begin:body].strip(), True))
                begin = i + 1
        elif ch == ";" and not depth:
            out.append((code[begin : i + 1].strip(), False))
            begin = i + 1
    return [m for m in out if m[0].strip("; ")]


def class_skeleton(code: str | None, language: str | None) -> str | None:
    """Header and members without bodies; null if there is no method, no braces, or the language has no classes."""
    language = (language or "").lower()
    if not code or language in ("c", "html"):
        return None
    if language == "python":
        lines, methods = [], False
        for line in code.split("\n"):
            if line.strip().startswith("class"):
                lines.append(line.strip())
            elif found := _signatures(line):
                methods, lines = True, lines + found
        return "\n".join(lines) if methods else None
    if language == "ruby":
        lines = [x for x in code.split("\n") if x.strip().startswith(("class", "module", "def"))]
        return "\n".join(y for x in lines for y in ([x, " " * (len(x) - len(x.lstrip())) + "end"] if x.strip().startswith("def") else [x])) + "\nend" if lines else None
    at = _body(code)
    if at < 0:
        return None
    header = " ".join(code[:at].split())
    if language in HEADER_ONLY:
        return f"{header} {ENDINGS.get(language, '{}')}"
    members = _members(code)
    if not any(has for _, has in members) and language != "go":
        return None
    shown = [" ".join(text.split()) + (" {}" if has else "") for text, has in members]
    return "\n".join([header, "{", *shown, "};" if language == "cpp" else "}"])


def function_skeleton(code: str | None, language: str | None) -> str | None:
    """The signature with an empty body in the language's way; null for html."""
    language = (language or "").lower()
    if not code or language == "html":
        return None
    if language == "python":
        return "\n".join(_signatures(code))
    ending = ENDINGS.get(language, "{}")
    if language in ("lua", "ruby", "verilog"):
        return f"{code.strip().split(chr(10))[0].rstrip()} {ending}"
    at = _body(code)
    return f"{' '.join((code if at < 0 else code[:at]).split())} {ending}"


def merge_class(header: str | None, source: str | None, name: str | None) -> str | None:
    """The class of a C++ header with the bodies that the source has for its functions, the last of a name winning.
    What stands outside the class is dropped."""
    if not header:
        return None
    bodies, bare = {}, hushed(source or "")
    for m in re.finditer(r"(\w+(?:::~?\w+)+)\s*\([^()]*\)[^;{}()]*\{", bare):
        depth, end = 1, m.end()
        while end < len(bare) and depth:
            depth += (bare[end] == "{") - (bare[end] == "}")
            end += 1
        bodies[m[1].split("::", 1)[1]] = source[m.end() - 1 : end]
    found = re.search(r"\bclass\s+\w+[^;{]*\{", hushed(header))
    if not found:
        return f"class {name} {{\n}};"
    lines = []
    for text, has in _members(header[found.start() :]):
        while m := re.match(r"(public|private|protected)\s*:\s*", text):
            lines.append(f"  {m[1]}:")
            text = text[m.end() :]
        call = re.search(r"(~?\w+)\s*\(", text)
        body = bodies.get(call[1]) if call and not has else None
        if text.strip():
            lines.append(f"    {text.rstrip(';').rstrip()} {body}" if body else f"    {text}{' {}' if has else ''}")
    return "\n".join([f"class {name} {{", *lines, "};"])


def class_skeleton_udf():
    @F.pandas_udf("string")
    def run(code: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series(list(map(class_skeleton, code, language)), dtype=object)

    return run


def function_skeleton_udf():
    @F.pandas_udf("string")
    def run(code: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series(list(map(function_skeleton, code, language)), dtype=object)

    return run


def merge_class_udf():
    @F.pandas_udf("string")
    def run(header: pd.Series, source: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series(list(map(merge_class, header, source, name)), dtype=object)

    return run


def merged_files(files: DataFrame) -> DataFrame:
    """C++ files (repo, path, code) with headers and sources of one stem put together under the header's path: the i-th
    header of a stem with its i-th source, by path; the class is the one that the header names, else the stem. What is left
    over stays as it is, and so do files of other endings. Codes may be null: they count as empty headers."""
    stem, ending = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1), F.regexp_extract("path", r"(\.[^./]*)?$", 1)
    nth = F.row_number().over(Window.partitionBy("repo", "stem", "ending").orderBy("path"))
    placed = files.select("repo", "path", "code", stem.alias("stem"), ending.alias("ending"))
    both = placed.where("ending in ('.h', '.cpp')").withColumn("nth", nth)
    header = both.where("ending = '.h'").select("repo", "stem", "nth", F.col("path").alias("h"), F.col("code").alias("header"))
    source = both.where("ending = '.cpp'").select("repo", "stem", "nth", F.col("path").alias("s"), F.col("code").alias("source"))
    pairs = header.join(source, ["repo", "stem", "nth"], "full_outer")
    name = header_class_name(F.coalesce("header", F.lit("")), F.col("stem"))
    merged = F.coalesce(merge_class_udf()("header", "source", name), F.col("source"))
    code = F.when(F.col("h").isNull(), F.col("source")).when(F.col("s").isNull(), F.col("header")).otherwise(merged)
    return pairs.select("repo", F.coalesce("h", "s").alias("path"), code.alias("code")).unionByName(placed.where("ending not in ('.h', '.cpp')").select("repo", "path", "code"))


def signature(code: str | None) -> tuple[str, str] | None:
    """(name, parameters) of the first function that braces code declares; null without one."""
    found = re.search(r"([\w~:]+)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:const\b\s*)?[{;]", hushed(code or ""))
    return (found[1], (code or "")[found.start(2) : found.end(2)].strip()) if found else None
