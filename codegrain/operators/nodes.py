"""Syntax nodes as rows, their categories, and samples drawn from them.

A backend turns a text into nodes (id, parent_id, depth, type, tag, start_byte, end_byte) in document order: html by the
standard library's HTML parser, python by its ast, ruby, lua and verilog by a scanner of blocks that a word ends, other
languages by a scanner of braces and keywords. Only this step needs Python; what follows is joins and expressions.
"""

from __future__ import annotations

import ast
import re
import sys
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from itertools import accumulate, chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrain.functions.text import uniform
from codegrain.operators.spans import inside

NODES = "array<struct<id:int,parent_id:int,depth:int,type:string,tag:string,start_byte:int,end_byte:int>>"
Node = tuple[int, int | None, int, str, str | None, int, int]

#: Element names sampled as blocks and as lines.
BLOCK_TAGS = ("div", "section", "article", "header", "footer", "nav", "main", "aside", "form", "table", "ul", "ol", "dl")
LINE_TAGS = ("span", "a", "strong", "em", "b", "i", "u", "small", "mark", "del", "ins", "sub", "sup", "code", "kbd", "samp", "var", "time", "data")
_TAG = re.compile(r"<([^\s/>]+)")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

#: Categories in order of priority; of those that a node type falls into the first counts.
CATEGORIES = ("import", "comment", "if", "for", "while", "return", "expression", "assignment", "class", "function")
#: What a node type's name says of its category, in any grammar. A table of exact names can be given instead.
RULES = {
    "import": r"^(import|using|use|export|include|require|dofile|loadfile|source|library|preproc_include|namespace_definition)",
    "comment": r"comment",
    "if": r"^(if|unless|try|conditional)",
    "for": r"^(for|foreach|enhanced_for|range_based_for|loop|repeat)",
    "while": r"^(while|until)",
    "return": r"^(return|throw)",
    "expression": r"^(expression|call_exp|binary_exp|unary_exp|declaration$)",
    "assignment": r"(assign|^(local_|short_)?var(iable)?_decl|^(let|val|var|property|field|net|lexical)_(decl|def))",
    "class": r"^(class|struct|enum|trait|interface|impl|module|object|protocol|union|type|package)",
    "function": r"(function|method|constructor|subroutine|task_decl|init_decl)",
}
#: Which categories make a grain, in order.
GRAINS = {"block": ("for", "if", "while", "import"), "line": ("assignment", "expression", "return"), "class": ("class",), "function": ("function",)}
LABELS = {"for": "for_statement", "if": "if_statement", "while": "while_statement", "import": "import", "assignment": "assignment", "expression": "expression", "return": "return_statement"}


class _Html(HTMLParser):
    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.lines = [0]
        for line in text.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.text, self.open, self.nodes = text, [], []
        self.feed(text)
        self.close()
        self._end(0, len(text))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _end(self, keep: int, at: int) -> None:
        while len(self.open) > keep:
            self.nodes[self.open.pop()[1]][6] = at

    def handle_starttag(self, tag, attrs) -> None:
        start = self._at()
        name = _TAG.match(self.text, start)
        parent = self.open[-1][1] if self.open else None
        self.nodes.append([len(self.nodes), parent, len(self.open), "element", name[1] if name else tag, start, start + len(self.get_starttag_text() or "")])
        if tag not in _VOID:
            self.open.append((tag, len(self.nodes) - 1))

    def handle_startendtag(self, tag, attrs) -> None:
        """Self-closing elements are no elements with a start tag."""

    def handle_endtag(self, tag) -> None:
        found = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if found is not None:
            start = self._at()
            stop = self.text.find(">", start)
            self._end(found + 1, start)
            self._end(found, len(self.text) if stop < 0 else stop + 1)


def _by_bytes(text: str, nodes: list) -> list[Node]:
    """Character offsets to byte offsets."""
    if text.isascii():
        return [tuple(n) for n in nodes]
    at = [0]
    for ch in text:
        at.append(at[-1] + len(ch.encode("utf-8", "surrogatepass")))
    return [(*n[:5], at[n[5]], at[n[6]]) for n in nodes]


def html_nodes(text: str) -> list[Node]:
    return _by_bytes(text, _Html(text).nodes)


_AST = {
    "Import": "import_statement", "ImportFrom": "import_from_statement", "If": "if_statement", "Try": "try_statement", "For": "for_statement", "AsyncFor": "for_statement",
    "While": "while_statement", "Return": "return_statement", "Expr": "expression_statement", "Assign": "assignment", "AnnAssign": "assignment", "AugAssign": "assignment",
    "ClassDef": "class_definition", "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition",
}


def python_nodes(text: str) -> list[Node]:
    tree = ast.parse(text)
    starts, at = [], 0
    for line in text.encode().split(b"\n"):
        starts.append(at)
        at += len(line) + 1
    out: list[Node] = []

    def walk(node, parent: int | None, depth: int) -> None:
        kind = _AST.get(type(node).__name__)
        if kind:
            out.append((len(out), parent, depth, kind, None, starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset))
            parent, depth = out[-1][0], depth + 1
        for child in ast.iter_child_nodes(node):
            walk(child, parent, depth)

    walk(tree, None, 0)
    return out


_QUIET = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_HEADS = (
    ("class_declaration", re.compile(r"\b(?:class|struct|interface|enum|trait|impl|protocol|object|union)\b")),
    ("for_statement", re.compile(r"^\s*(?:for|foreach)\b")),
    ("while_statement", re.compile(r"^\s*(?:while|do)\b")),
    ("if_statement", re.compile(r"^\s*(?:\}?\s*else\s+)?(?:if|switch|try|match)\b")),
    ("function_declaration", re.compile(r"\)[^;=()]*$|\bfn\b|\bfunc(?:tion)?\b|=>\s*$")),
)
_CONTROL = re.compile(r"\s*(?:for|if|switch)\b")
_DIRECTIVE = re.compile(r"\s*(?:#\s*include|import|package|use)\b")
_LINES = (("import_declaration", re.compile(r"^\s*(?:import|using|use|#include|package)\b|^\s*#\s*include")), ("return_statement", re.compile(r"^\s*return\b")), ("assignment_statement", re.compile(r"[^=!<>]=[^=]")))


def hushed(text: str) -> str:
    """Comments and strings blanked, length and lines kept."""
    return _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


#: Languages in which the end of a line ends a statement.
LINE_ENDS = frozenset("go kotlin swift scala r javascript typescript perl".split())
_GOES_ON = re.compile(r"[-+*/%=<>&|^,.(\[{:?\\]\s*$")


def brace_nodes(text: str, line_ends: bool = False) -> list[Node]:
    """line_ends: a line that is no part of a longer expression is a statement without a semicolon, too."""
    bare = hushed(text)
    nodes, open_, begin, i, depth = [], [], 0, 0, 0

    def add(kind: str, start: int, end: int) -> int:
        start += len(bare[start:end]) - len(bare[start:end].lstrip())
        parent = next((n for n in reversed(open_) if n is not None), None)
        nodes.append([len(nodes), parent, sum(n is not None for n in open_), kind, None, start, end])
        return len(nodes) - 1

    while i < len(bare):
        ch = bare[i]
        if ch == "{":
            head = bare[begin:i]
            kind = next((k for k, rule in _HEADS if rule.search(head.rstrip())), None)
            open_.append(add(kind, begin, i + 1) if kind else None)
            begin = i + 1
        elif ch == "}":
            if open_ and (n := open_.pop()) is not None:
                nodes[n][6] = i + 1
            begin = i + 1
        elif ch in "([" or ch in ")]":
            depth = max(0, depth + (1 if ch in "([" else -1))
        elif (ch == ";" and not depth and not (line_ends and _CONTROL.match(bare, begin, i))) or ch == "\n" and (_DIRECTIVE.match(bare, begin, i) or line_ends and not depth and bare[begin:i].strip() and not _GOES_ON.search(bare, max(begin, i - 80), i)):
            line = bare[begin : i + (ch == ";")]
            if line.strip(" \n\t;"):
                add(next((k for k, rule in _LINES if rule.search(line)), "expression_statement"), begin, i + (ch == ";"))
            begin = i + 1
        i += 1
    for n in open_:
        if n is not None:
            nodes[n][6] = len(text)
    return _by_bytes(text, nodes)


#: What opens a block, what ends one, and what is no code, in languages whose blocks a word ends.
_WORD_BLOCKS = {
    "ruby": (
        (("class", r"class\b"), ("module", r"module\b"), ("method", r"def\b"), ("if", r"(?:if|unless|case|begin)\b"), ("while", r"(?:while|until)\b"), ("for", r"for\b"), ("call_block", r".*\bdo(?:\s*\|[^|]*\|)?\s*$"), ("if", r"[\w@.\[\]]+\s*=\s*(?:if|case|begin)\b")),
        re.compile(r"end\b"),
        re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"),
    ),
    "lua": (
        (("function_declaration", r"(?:local\s+)?function\b|.*[=(,]\s*function\s*\([^()]*\)\s*$"), ("if_statement", r"if\b(?!.*\bend\b)"), ("for_statement", r"for\b(?!.*\bend\b)"), ("while_statement", r"while\b(?!.*\bend\b)"), ("repeat_statement", r"repeat\b"), ("do_statement", r"do\b")),
        re.compile(r"end\b|until\b"),
        re.compile(r"--\[\[.*?\]\]|--[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S),
    ),
    "verilog": (
        (("module_declaration", r"module\b"), ("function_declaration", r"function\b"), ("task_declaration", r"task\b"), ("case_statement", r"case[xz]?\b"), ("if_statement", r"(?:end\s+)?(?:else\s+)?if\b.*\bbegin\b|(?:end\s+)?else\b.*\bbegin\b"), ("for_statement", r"for\b.*\bbegin\b"), ("while_statement", r"while\b.*\bbegin\b"), ("block", r".*\bbegin\b(?:\s*:\s*\w+)?\s*$")),
        re.compile(r"end(?:module|function|task|case)?\b"),
        re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"", re.S),
    ),
}
_BETWEEN = re.compile(r"(?:else(?!.*\bbegin\b)|elsif|elseif|when|rescue|ensure|then)\b")
_WORD_LINES = (("import_declaration", re.compile(r"(?:require|require_relative|include|import|`include|dofile|local\s+\w+\s*=\s*require)\b")), ("return_statement", re.compile(r"return\b")), ("assignment_statement", re.compile(r"[^=!<>~]=[^=~>]|<=")))


def word_nodes(text: str, language: str) -> list[Node]:
    """Line by line: a line that opens a block, ends one, or is a statement. A block that begins and ends on one line is a
    statement; one that never ends goes to the end of the text."""
    openers, ends, quiet = _WORD_BLOCKS[language]
    rules = [(kind, re.compile(rule)) for kind, rule in openers]
    bare = quiet.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    nodes, open_, at = [], [], 0
    for line in bare.split("\n"):
        body, start, stop = line.strip(), at + len(line) - len(line.lstrip()), at + len(line.rstrip())
        at += len(line) + 1
        if not body or _BETWEEN.match(body):
            continue
        closing = ends.match(body)
        if closing and open_:
            nodes[open_.pop()][6] = stop
        opening = next((kind for kind, rule in rules if rule.match(body)), None)
        if closing and not (language == "verilog" and opening):
            continue
        if opening and not closing and re.search(r"\b(?:end|endmodule|endfunction|endtask)\s*;?$", body):
            opening = None
        kind = opening or next((k for k, rule in _WORD_LINES if rule.search(body)), "expression_statement")
        nodes.append([len(nodes), open_[-1] if open_ else None, len(open_), kind, None, start, stop])
        if opening:
            nodes[-1][6] = len(text)
            open_.append(len(nodes) - 1)
    return _by_bytes(text, nodes)


def parse(text: str | None, language: str | None) -> list[Node]:
    """Nodes of a text; none for null, for what the backend cannot parse, and for an unknown language without braces."""
    language = (language or "").lower()
    if not text:
        return []
    try:
        if language == "html":
            return html_nodes(text)
        if language == "python":
            return python_nodes(text)
        if language in _WORD_BLOCKS:
            return word_nodes(text, language)
        return brace_nodes(text, language in LINE_ENDS)
    except (SyntaxError, ValueError, RecursionError):
        return []


def with_nodes(df: DataFrame, code: str = "code", language: str = "language") -> DataFrame:
    """df with an array column `nodes`. Texts are parsed a few at a time, and what they give is kept as columns, so a batch costs
    little more than its texts."""

    @F.arrow_udf(NODES)
    def nodes(texts: pa.Array, languages: pa.Array) -> pa.Array:
        out = [_as_list(texts.slice(at, 64).to_pylist(), languages.slice(at, 64).to_pylist()) for at in range(0, len(texts), 64)]
        return pa.concat_arrays(out) if out else _as_list([], [])

    return df.withColumn("nodes", nodes(F.col(code), F.col(language)))


def _as_list(texts: list, languages: list) -> pa.ListArray:
    found = [parse(t, lang) for t, lang in zip(texts, languages, strict=True)]
    columns = zip(*chain.from_iterable(found), strict=True) if any(found) else [()] * 7
    kinds = zip(("id", "parent_id", "depth", "type", "tag", "start_byte", "end_byte"), (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)
    fields = [(name, pa.array(c, kind)) for (name, kind), c in zip(kinds, columns, strict=True)]
    values = pa.StructArray.from_arrays([c for _, c in fields], [name for name, _ in fields])
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), values)


def exploded(df: DataFrame) -> DataFrame:
    return df.withColumn("node", F.explode("nodes")).drop("nodes").select("*", "node.*").drop("node")


def category(node_type: Column) -> Column:
    """By the rules, first match in order of priority; null if none matches."""
    return F.coalesce(*(F.when(node_type.rlike(RULES[name]), name) for name in CATEGORIES))


def classify(nodes: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """nodes with `category`: by a table symbols (language, category, priority, node_type) if given, else by the rules."""
    if symbols is None:
        return nodes.withColumn("category", category(F.col("type")))
    best = symbols.groupBy(F.col("language").alias("_language"), F.col("node_type").alias("_type")).agg(F.min_by("category", "priority").alias("category"))
    return nodes.join(best, (F.col("language") == F.col("_language")) & (F.col("type") == F.col("_type")), "left").drop("_language", "_type")


def grain(category: Column, tag: Column) -> tuple[Column, Column]:
    """(grain, label) of a category, or of an HTML element by its tag."""
    of = F.when(tag.isin(*BLOCK_TAGS), "block").when(tag.isin(*LINE_TAGS), "line")
    for name, has in GRAINS.items():
        of = of.when(category.isin(*has), name)
    label = F.when(tag.isNotNull(), tag)
    for name, text in LABELS.items():
        label = label.when(category == name, text)
    return of, label


def sample_nodes(nodes: DataFrame, keys: list[str], seed: int = 7) -> DataFrame:
    """One node for each combination of keys, drawn by hash: the least hash wins, which partial aggregation finds."""
    u = uniform(*map(F.col, keys), F.col("id"), F.lit(seed))
    rest = [c for c in nodes.columns if c not in keys]
    return nodes.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(u, F.col("id"))).alias("_n")).select(*keys, "_n.*")


def perturbed(chosen: DataFrame, nodes: DataFrame, key: str, share: float = 0.8, seed: int = 7, also: tuple[str, ...] = ()) -> DataFrame:
    """chosen with start_byte and end_byte of the node itself for a share of block and line samples, else of a random part
    of it, itself included; class and function samples stay whole. Parts are found by a sweep over the ranges of a key.
    also: further columns that tell chosen rows apart, where a node may be chosen more than once."""
    more = [F.col(c) for c in also]
    whole = (uniform(F.col(key), F.col("id"), *more, F.lit(seed)) < share) | F.col("grain").isin("class", "function")
    asked = chosen.where(~whole)
    pairs = inside(asked.select(key, "id", "start_byte", "end_byte").distinct(), nodes, key)
    parts = pairs.select(key, F.col("outer_id").alias("id"), F.col("inner_id").alias("_part"), F.col("start_byte").alias("_start"), F.col("end_byte").alias("_end"))
    u = uniform(F.col(key), F.col("id"), *more, F.col("_part"), F.lit(seed))
    drawn = asked.select(key, "id", *also).join(parts, [key, "id"]).groupBy(key, "id", *also).agg(F.min_by(F.struct("_start", "_end"), F.struct(u, "_part")).alias("_p"))
    joined = chosen.join(drawn, [key, "id", *also], "left")
    return joined.withColumns({"start_byte": F.coalesce("_p._start", "start_byte"), "end_byte": F.coalesce("_p._end", "end_byte")}).drop("_p")


def imports_of(code: str | None) -> list[str]:
    """Modules that Python code imports: dotted names of plain imports without alias, and of `from` imports the module
    without its dots and the names."""
    out: list[str] = []
    try:
        for node in ast.walk(ast.parse(code or "")):
            if isinstance(node, ast.Import):
                out += [a.name for a in node.names if a.asname is None]
            elif isinstance(node, ast.ImportFrom):
                out += [m for m in [node.module or ("" if node.level else None)] if m is not None] + [a.name for a in node.names if a.asname is None and a.name != "*"]
    except (SyntaxError, ValueError):
        for m in re.finditer(r"^[ \t]*(?:from[ \t]+\.*([\w.]*)[ \t]+import[ \t]+([\w, \t]+)|import[ \t]+([\w., \t]+))", code or "", re.M):
            names = [x.strip() for x in (m[2] or m[3]).split(",")]
            out += ([m[1]] if m[1] else []) + [x for x in names if x and " as " not in x]
    return out


def python_imports():
    """Pandas UDF code -> array of modules."""

    def run(code: pd.Series) -> pd.Series:
        return code.map(imports_of)

    return F.pandas_udf(run, "array<string>")


def project_modules(modules: Column, installed: Iterable[str] = ()) -> Column:
    """Those of an array of modules that are not the interpreter's own and not installed: their files may be in the project.
    A dotted name goes by its first part. Nothing is imported to find out."""
    known = F.array(*map(F.lit, sorted({*sys.builtin_module_names, *installed})))
    return F.filter(modules, lambda m: ~F.array_contains(known, F.substring_index(m, ".", 1)))


def definition_name(code: str | None, language: str | None) -> str | None:
    """The name of the first class or function that code defines; null without one."""
    for node in parse(code, language):
        if re.search(RULES["class"], node[3]) or re.search(RULES["function"], node[3]):
            head = (code or "").encode()[node[5] : node[6]].decode("utf-8", "replace").split("{", 1)[0]
            found = re.search(r"\b(?:class|struct|interface|enum|trait|object|protocol|union|def|func|fn|function|module)\s+([\w$]+)", head) or re.search(r"([\w$~]+)\s*\(", head)
            return found[1] if found else None
    return None


def has_return(nodes: Column) -> Column:
    """Whether an array of nodes holds one that returns."""
    return F.exists(nodes, lambda n: n["type"].rlike(RULES["return"]))


def partition_map(df: DataFrame, task, schema: str) -> DataFrame:
    """task(frame) over the chunks of each partition, results in any order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield task(frame)

    return df.mapInPandas(run, schema)
