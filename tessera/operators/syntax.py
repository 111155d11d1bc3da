"""Scopes and references of source files: a lexer with a nesting stack per file, joins for the rest.

Rust, JavaScript and TypeScript are read as tokens (comments, strings and characters are left out, code within
template literals is not), from which items and members are cut by balanced brackets. Python has its own parser.
Rows are positions; which scope a reference belongs to is found by an interval join.
"""

from __future__ import annotations

import ast
import re
import textwrap
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.paths import language_of
from tessera.sources.work import held

SCOPES = "file_path string, language string, chunk_type string, name string, parent string, start long, stop long, start_line int, end_line int"
REFERENCES = "file_path string, rel string, name string, at long, line int"
BRACES = ("rust", "javascript", "typescript")
#: Rows from which on a worker gives to Spark what it has read.
OUT_ROWS = 20_000
#: Lines of a bucket of the interval join.
BUCKET_LINES = 64
#: References from which on a name counts as frequent; there are at most as many such names as references over OFTEN.
OFTEN = 50_000
#: Item keywords of Rust and statements of JavaScript and TypeScript, with the type of their chunks.
RUST_ITEMS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "interface", "mod": "module", "const": "const", "static": "variable"}
SCRIPT_ITEMS = {"function": "function", "class": "class", "interface": "interface", "enum": "enum"}


class Token(NamedTuple):
    kind: str  # word, life, text or sign
    text: str
    start: int
    stop: int
    fresh: bool  # first of its line


class Scope(NamedTuple):
    chunk_type: str
    name: str | None
    parent: str | None
    start: int
    stop: int


_RUST = re.compile(r"""//[^\n]*|(?P<deep>/\*)|(?P<text>b?r(?P<hash>\#*)".*?"(?P=hash)|b?"(?:\\.|[^"\\])*"|b?'(?:\\(?:u\{\w+\}|x\w\w|.)|[^'\\])')|(?P<life>'\w+)|(?P<word>r\#\w+|\w+)|(?P<sign>->|=>|::|\.\.=?|\S)""", re.S)
_SCRIPT = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<text>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<back>`)|(?P<word>[\w$#]+)|(?P<sign>=>|\?\.|\.\.\.|\S)""", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_NESTED = re.compile(r"/\*|\*/")
_BACK = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{|\\?\Z)", re.S)
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; => return typeof case".split())
_CLOSES = {"(": ")", "[": "]", "{": "}"}


def tokens_of(language: str, text: str) -> list[Token]:
    """Tokens without comments; strings are one token each, of template literals only their code is left."""
    out: list[Token] = []
    line_end, braces = -1, []  # braces: for each open one, whether a template literal goes on after it
    pattern = _RUST if language == "rust" else _SCRIPT
    follow = pattern.finditer(text)
    while (found := next(follow, None)) is not None:
        start, at, kind = found.start(), found.end(), found.lastgroup
        if kind is None:
            continue
        sign = found[0]
        if kind == "deep":  # comments of Rust nest
            depth = 1
            while depth and (mark := _NESTED.search(text, at)):
                depth += 1 if mark[0] == "/*" else -1
                at = mark.end()
            follow = pattern.finditer(text, at if not depth else len(text))
            continue
        if kind == "hash":
            kind = "text"
        elif kind == "sign" or kind == "back":
            resumes = kind == "back"
            if sign == "{":
                braces.append(False)
            elif sign == "}" and braces:
                resumes = braces.pop()
            elif sign == "/" and language != "rust" and (not out or out[-1].text in _BEFORE_REGEX) and (regex := _REGEX.match(text, start)):
                at, kind = regex.end(), "text"
                follow = pattern.finditer(text, at)
            if resumes:
                ends = _BACK.match(text, at)
                if ends[1] == "${":
                    braces.append(True)
                follow = pattern.finditer(text, ends.end())
                continue
        if start > line_end:  # a further line
            fresh, line_end = True, text.find("\n", start)
            line_end = len(text) if line_end < 0 else line_end
        else:
            fresh = False
        out.append(Token(kind, sign, start, at, fresh))
    return out


def _closing(tokens: list[Token], at: int) -> int:
    """Index of the bracket that closes the one at `at`, or of the last token."""
    wanted = []
    for i in range(at, len(tokens)):
        sign = tokens[i].text if tokens[i].kind == "sign" else ""
        if sign in _CLOSES:
            wanted.append(_CLOSES[sign])
        elif sign in (")", "]", "}"):
            while wanted and wanted.pop() != sign:
                pass
            if not wanted:
                return i
    return len(tokens) - 1


def _until(tokens: list[Token], at: int, stops: str, block: bool) -> int:
    """Index of the first of `stops` outside of brackets, or of the end of the first block."""
    while at < len(tokens) - 1:
        sign = tokens[at].text if tokens[at].kind == "sign" else ""
        if sign and sign in stops:
            return at
        if sign in _CLOSES:
            at = _closing(tokens, at)
            if block and sign == "{":
                return at
        at += 1
    return len(tokens) - 1


def _rust(tokens: list[Token], text: str, first: int, last: int, parent: str | None = None) -> Iterator[Scope]:
    """Items of a file, of modules in it (parent None), or of a block of a type (parent), however deep they nest."""
    todo = [(first, last, parent)]
    while todo:
        at, last, parent = todo.pop()
        while at < last:
            if tokens[at].text == "#":  # an attribute stands before the item
                at = _closing(tokens, _until(tokens, at, "[", False)) + 1
                continue
            start = at
            while at < last - 1 and (tokens[at].text in ("pub", "async", "unsafe", "default", "extern") or tokens[at].kind == "text" or (tokens[at].text == "const" and tokens[at + 1].text in ("fn", "unsafe", "async", "extern"))):
                at += 1
                if tokens[at].text == "(" and tokens[at - 1].text == "pub":
                    at = _closing(tokens, at) + 1
            if at >= last:
                break
            word, inner = tokens[at].text, None
            end = _until(tokens, at, ";", word not in ("const", "static", "type", "use", "let"))
            span = (tokens[start].start, tokens[end].stop)
            name = next((t.text for t in tokens[at + 1 : end] if t.kind == "word" and t.text not in ("mut", "const")), None)
            if word == "impl":
                body = _until(tokens, at, "{;", False)
                head = at + 1
                if head < body and tokens[head].text == "<":
                    depth = 0
                    while head < body:
                        depth += {"<": 1, ">": -1}.get(tokens[head].text, 0)
                        head += 1
                        if not depth:
                            break
                target = [i for i in range(head, body) if tokens[i].text == "for" and tokens[i + 1].text != "<"]
                head = target[0] + 1 if target else head
                where = next((i for i in range(head, body) if tokens[i].text == "where"), body)
                if head < where:
                    inner = (body + 1, end, text[tokens[head].start : tokens[where - 1].stop].strip())
            elif parent is not None:
                kind = {"fn": "method", "const": "const", "type": "impl"}.get(word)
                if kind:
                    yield Scope(kind, name, parent, *span)
            elif word in RUST_ITEMS:
                yield Scope(RUST_ITEMS[word], name, None, *span)
                body = _until(tokens, at, "{;", False)
                if word == "mod" and tokens[body].text == "{":
                    inner = (body + 1, end, None)
            at = end + 1
            if inner:  # its items come before what follows it
                todo += [(at, last, parent), inner]
                break


def _members(tokens: list[Token], first: int, last: int, owner: str | None) -> Iterator[Scope]:
    """Methods with a body and fields of a class."""
    at = first
    while at < last:
        if tokens[at].text in (";", "@"):
            at += 1 if tokens[at].text == ";" else 2
            at = _closing(tokens, at) + 1 if at < last and tokens[at].text == "(" else at
            continue
        start = at
        while at < last - 1 and tokens[at].text in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "*") and tokens[at + 1].text not in ("(", "=", ":", ";", "?"):
            at += 1
        if tokens[at].text == "{":  # a static block
            at = _closing(tokens, at) + 1
            continue
        name = tokens[at].text if tokens[at].kind != "sign" else None
        at = (_closing(tokens, at) if tokens[at].text == "[" else at) + 1
        while at < last and tokens[at].text in ("?", "!"):
            at += 1
        if at < last and tokens[at].text == "<":
            at = _until(tokens, at, "(", False)
        if at < last and tokens[at].text == "(":
            at = _closing(tokens, at) + 1
            while at < last and not (tokens[at].text == ";" or tokens[at].text == "{" and tokens[at - 1].text not in (":", "|", "&", "=>", ",", "<")):
                if tokens[at].fresh and tokens[at].text not in ("{", ":"):
                    break
                at = (_closing(tokens, at) if tokens[at].text in _CLOSES else at) + 1
            if at < last and tokens[at].text == "{":
                end = _closing(tokens, at)
                yield Scope("method", name, owner, tokens[start].start, tokens[end].stop)
                at = end + 1
            continue
        while at < last and tokens[at].text != ";" and not (tokens[at].fresh and tokens[at - 1].text not in ("=", ",", "+", "|", "&", "?", ":", "=>", ".")):
            at = (_closing(tokens, at) if tokens[at].text in _CLOSES else at) + 1
        yield Scope("variable", name, owner, tokens[start].start, tokens[min(at, last) - 1].stop)


def _script(tokens: list[Token]) -> Iterator[Scope]:
    """Functions, interfaces, enumerations and members of classes at the top of a file; what is exported or declared is wrapped, and left out."""
    at = 0
    while at < len(tokens):
        begins = not at or tokens[at - 1].text in (";", "}") or (tokens[at].fresh and tokens[at - 1].text not in ("=", "(", ",", ":", "?", "=>", "export", "default", "declare", "abstract"))
        lead = 1 if tokens[at].text in ("async", "const") and at + 1 < len(tokens) and tokens[at + 1].text in ("function", "enum") else 0
        word = tokens[min(at + lead, len(tokens) - 1)].text
        if begins and word in SCRIPT_ITEMS and at + lead + 1 < len(tokens) and tokens[at + lead + 1].kind == "word":
            body = at + lead
            while body < len(tokens) - 1 and not (tokens[body].text == "{" and tokens[body - 1].text not in (":", "|", "&", "<", ",")) and tokens[body].text != ";":
                body = min((_closing(tokens, body) if tokens[body].text in _CLOSES else body) + 1, len(tokens) - 1)
            end = _closing(tokens, body) if tokens[body].text == "{" else body
            name = tokens[at + lead + 1].text
            if word == "class":
                yield from _members(tokens, body + 1, end, name)
            elif tokens[body].text == "{":
                yield Scope(SCRIPT_ITEMS[word], name, None, tokens[at].start, tokens[end].stop)
            at = end + 1
        else:
            at = (_closing(tokens, at) if tokens[at].text in _CLOSES else at) + 1


def scopes_of(language: str, text: str, tokens: list[Token] | None = None) -> list[Scope]:
    """The chunks of a file in order: items, those of modules after their module, members without their container."""
    tokens = tokens_of(language, text) if tokens is None else tokens
    return list(_rust(tokens, text, 0, len(tokens)) if language == "rust" else _script(tokens)) if tokens else []


_NO_CALL = frozenset("if for while switch match return fn function catch in let else impl where loop move await new super as mod use pub dyn".split())
_BEFORE_TYPE = {
    "rust": frozenset("-> < & dyn impl for as where + struct enum trait union type".split()),
    "typescript": frozenset("< | & as interface type implements class keyof".split()),
    "javascript": frozenset(),
}


def references_of(language: str, text: str, tokens: list[Token] | None = None) -> list[tuple[str, str, int]]:
    """(Calls or Uses, name, position): last names of what is called, and names in the place of a type.

    Names of types are told from others by what stands before: a colon, an arrow, brackets of generics, a
    reference or a keyword; in Rust also by the brace of a literal. JavaScript has no types. Macros, attributes and `new` are no calls.
    """
    if language == "python":
        return _python_references(text)
    tokens, out, generic = tokens_of(language, text) if tokens is None else tokens, [], 0
    for i, t in enumerate(tokens):
        before = tokens[i - 1].text if i else ""
        after = tokens[i + 1].text if i + 1 < len(tokens) else ""
        if t.kind == "sign":
            opens = t.text == "<" and i and (before == "::" or tokens[i - 1].kind == "word" and tokens[i - 1].stop == t.start)
            generic = generic + 1 if opens else max(0, generic - 1) if t.text == ">" else 0 if t.text in (";", "{", "}") else generic
            continue
        if t.kind != "word" or t.text[0].isdigit():
            continue
        if after == "(" and t.text not in _NO_CALL and before not in ("fn", "function", "struct"):
            attribute = before == "[" and i > 1 and tokens[i - 2].text in ("#", "!")
            if not attribute and not (language != "rust" and (before == "new" or _is_method(tokens, i))):
                out.append(("Calls", t.text, t.start))
        elif language != "javascript" and t.text[0].isupper() and after not in ("!", "::", "(" if before != "struct" else ""):
            typed = before in _BEFORE_TYPE[language] or before == ":" or (generic and before in (",", "(", "[", "<")) or (before == "mut" and i > 1 and tokens[i - 2].text == "&") or (i and tokens[i - 1].kind == "life")
            literal = language == "rust" and after == "{" and before not in (".", "::")
            if typed or literal:
                out.append(("Uses", t.text, t.start))
    return out


def _is_method(tokens: list[Token], at: int) -> bool:
    """Whether the name before the bracket is that of a method with a body, not of a call."""
    end = _closing(tokens, at + 1)
    after = tokens[end + 1].text if end + 1 < len(tokens) else ""
    before = tokens[at - 1].text if at else ""
    return after in ("{", ":") and before not in (".", "?.", "new", "=", "(", ",", "return", "=>", "?", "&", "|") and (tokens[at].fresh or before in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "*", "{", "}", ";"))


_PYTHON_LINE = re.compile(r"\r\n?|\n")


def python_lines(text: str) -> list[int]:
    """For each line of the parser, which also ends one at a carriage return, the line that it is in by line feeds."""
    out = [1]
    for end in _PYTHON_LINE.finditer(text):
        out.append(out[-1] + end[0].endswith("\n"))
    return out


def parsed_python(text: str) -> ast.Module | None:
    """The tree of a Python text, None for one that is no Python or nests deeper than the parser goes."""
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    except MemoryError as e:
        if not e.args:  # the parser's full stack has a message, a worker without memory has none
            raise
        return None


def _python_references(text: str) -> list[tuple[str, str, int]]:
    text = textwrap.dedent(text)
    tree = parsed_python(text)
    if tree is None:
        return []
    nodes = list(ast.walk(tree))
    starts = [0, *(m.end() for m in _PYTHON_LINE.finditer(text))]
    place = lambda node: starts[node.lineno - 1] + node.col_offset
    out = []
    for node in nodes:
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name | ast.Attribute):
            out.append(("Calls", node.func.id if isinstance(node.func, ast.Name) else node.func.attr, place(node)))
        for kind in (getattr(node, "annotation", None), getattr(node, "returns", None)):
            if isinstance(kind, ast.expr):
                out.append(("Uses", ast.get_source_segment(text, kind) or "", place(kind)))
    return sorted(out, key=lambda r: r[2])


def _mapped(files: DataFrame, languages: tuple[str, ...], rows_of, schema: str) -> DataFrame:  # noqa: ANN001
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, language, text in zip(part["file_path"], part["language"], part["content"], strict=True):
                ends = [m.start() for m in re.finditer("\n", text)]
                rows += rows_of(path, language, text, lambda at, ends=ends: bisect_right(ends, at - 1) + 1)
                if len(rows) >= OUT_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    read = files.select("file_path", "content", language_of(F.col("file_path")).alias("language"))
    return read.where((F.col("content") != "") & F.col("language").isin(*languages)).mapInPandas(run, schema)


def code_scopes(files: DataFrame) -> DataFrame:
    """Scopes of all Rust, JavaScript and TypeScript files (file_path, content): type, name, parent, positions and lines."""
    return _mapped(files, BRACES, lambda path, language, text, line: [(path, language, *s, line(s.start), line(s.stop - 1)) for s in scopes_of(language, text)], SCOPES)


def code_references(files: DataFrame) -> DataFrame:
    """Calls and uses of types in those files, with their positions and lines."""
    return _mapped(files, BRACES, lambda path, language, text, line: [(path, *r, line(r[2])) for r in references_of(language, text)], REFERENCES)


def code_parts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scopes, references) of those files as code_scopes() and code_references() give them, of one reading of each; both are written."""
    schema = f"{SCOPES}, rel string, at long, line int"

    def rows_of(path, language, text, line):  # noqa: ANN001, ANN202
        tokens = tokens_of(language, text)
        scopes = [(path, language, *s, line(s.start), line(s.stop - 1), None, None, None) for s in scopes_of(language, text, tokens)]
        return scopes + [(path, None, None, name, None, None, None, None, None, rel, at, line(at)) for rel, name, at in references_of(language, text, tokens)]

    both = held(_mapped(files, BRACES, rows_of, schema), "code-parts")
    names = lambda s: [c.split()[0] for c in s.split(", ")]
    return both.where("rel IS NULL").select(*names(SCOPES)), both.where("rel IS NOT NULL").select(*names(REFERENCES))


def within_scopes(references: DataFrame, scopes: DataFrame, innermost: bool = False) -> DataFrame:
    """References with each scope that holds them, or the innermost one only: name, rel, at, and the scope's columns but `name`, which is `scope`.

    Both meet by file and bucket of lines, so a reference meets only scopes that cover its bucket. References outside of all scopes go.
    """
    wide = scopes.withColumnRenamed("name", "scope").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_line") / BUCKET_LINES), F.floor(F.col("end_line") / BUCKET_LINES))))
    met = references.withColumn("_bucket", F.floor(F.col("line") / BUCKET_LINES)).join(wide, ["file_path", "_bucket"]).where("start <= at AND at < stop").drop("_bucket")
    if not innermost:
        return met
    nearest = F.row_number().over(W.partitionBy("file_path", "at", "rel").orderBy(F.desc("start"), "stop"))
    return met.withColumn("_n", nearest).where("_n = 1").drop("_n")


def build_code_graph(files: DataFrame, innermost: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of source files: scopes are nodes; a call or a type in a scope is an edge to the last scope of that name.

    The last one in order of path and position counts, as in build_graph(); parallel and self edges stay. A module holds
    what its functions call too, unless only the innermost scope is asked for.
    """
    scopes, references = code_parts(files)
    ids = F.concat_ws(":", "file_path", "start_line", "end_line")
    nodes = scopes.select(ids.alias("node"), F.coalesce("name", F.lit("unknown")).alias("name"), "file_path", "start_line", "end_line", "chunk_type", "start")
    last = nodes.groupBy("name").agg(F.max_by("node", F.struct("file_path", "start")).alias("dst"))
    weight = F.when(F.col("rel") == "Calls", F.lit(1.0)).otherwise(F.lit(0.5))
    inside = within_scopes(references, scopes, innermost).select(ids.alias("src"), "name", "rel", weight.alias("weight"))
    # a name that many refer to would be one task's: its references stay where they are, and its scope comes to them
    often = references.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > OFTEN).select("name")
    often = held(last.join(F.broadcast(often), "name"), "often")
    common = inside.join(F.broadcast(often), "name")
    rare = inside.join(F.broadcast(often.select("name")), "name", "left_anti").join(last, "name")
    return nodes.drop("start"), common.unionByName(rare).select("src", "dst", "rel", "weight")
