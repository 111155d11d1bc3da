"""Chunkers and the post-processing of chunks.

Files are rows, so chunking needs no shuffle. What folds over the chunks of one file runs on that
file's array of chunks; scans bound files, and so these arrays.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import language_of
from tessera.functions.text import lines_of, token_estimate
from tessera.operators.syntax import BRACES, parsed_python, python_lines, scopes_of
from tessera.schemas import CHUNKS

# Caps on imports, lines read for them, and tokens of the presets (target, maximum).
MAX_IMPORTS, IMPORT_LINES, FILE_IMPORTS = 10, 300, 20
PRESETS = {"default": (512, 1024), "embedding": (384, 512), "large": (1024, 2048)}
MIN_TOKENS = 10
#: Chunks, and characters of them, that a worker holds before it gives them to Spark.
OUT_ROWS, OUT_CHARS = 2000, 1 << 23


@dataclass(frozen=True)
class ChunkConfig:
    """Token limits and overlap; overlap is none, lines:N, tokens:N or window:PERCENT."""

    target: int = 512
    maximum: int = 1024
    minimum: int = MIN_TOKENS
    overlap: str = "none"
    max_imports: int = MAX_IMPORTS

    def __post_init__(self) -> None:
        if not self.minimum <= self.target <= self.maximum:
            raise ValueError("minimum <= target <= maximum must hold")

    @classmethod
    def preset(cls, name: str) -> ChunkConfig:
        return cls(*PRESETS[name])

    @property
    def lines(self) -> int:
        return max(self.target // 10, 10)


def chunk_by_lines(files: DataFrame, lines: int) -> DataFrame:
    """Blocks of `lines` lines: the columns of files but content, and start_line, end_line, content, tokens.

    An empty file has no chunks.
    """
    rest = [c for c in files.columns if c != "content"]
    split = files.select(*rest, lines_of(F.col("content")).alias("_lines"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / lines).cast("int")), lambda i: F.struct(
        (i * lines + 1).alias("start_line"), F.least(i * lines + lines, F.size("_lines")).alias("end_line"), F.array_join(F.slice("_lines", i * lines + 1, lines), "\n").alias("content"),
    ))
    cut = split.where(F.size("_lines") > 0).select(*rest, F.explode(blocks).alias("_b")).select(*rest, "_b.*")
    return cut.withColumn("tokens", token_estimate(F.col("content")))


def chunk_by_tokens(files: DataFrame, target: int) -> DataFrame:
    """Greedy blocks: a block ends with the line that brings it to `target` tokens; the rest of a file is its last block.

    Blocks that were cut carry the sum of their lines' estimates, the last one its own.
    """
    rest = [c for c in files.columns if c != "content"]
    split = files.select(*rest, lines_of(F.col("content")).alias("_lines")).where(F.size("_lines") > 0)
    empty = F.array().cast("array<struct<end:int,tokens:bigint>>")

    def step(acc: Column, line: Column) -> Column:
        total, at = acc["total"] + token_estimate(line), acc["at"] + 1
        full = total >= target
        cuts = F.when(full, F.concat(acc["cuts"], F.array(F.struct(at.alias("end"), total.alias("tokens"))))).otherwise(acc["cuts"])
        return F.struct(at.alias("at"), F.when(full, F.lit(0).cast("bigint")).otherwise(total).alias("total"), cuts.alias("cuts"))

    cuts = F.aggregate("_lines", F.struct(F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("total"), empty.alias("cuts")), step)["cuts"]
    cut = split.withColumn("_cuts", cuts)
    last = F.coalesce(F.element_at(F.col("_cuts"), F.when(F.size("_cuts") > 0, F.size("_cuts")))["end"], F.lit(0))
    tail = F.when(last < F.size("_lines"), F.array(F.struct(F.size("_lines").alias("end"), F.lit(None).cast("bigint").alias("tokens")))).otherwise(empty)
    cut = cut.withColumn("_all", F.concat("_cuts", tail))
    started = F.transform("_all", lambda c, i: F.struct(F.when(i == 0, 1).otherwise(F.get("_all", i - 1)["end"] + 1).alias("start_line"), c["end"].alias("end_line"), c["tokens"].alias("tokens")))
    out = cut.select(*rest, "_lines", F.explode(started).alias("_b")).select(*rest, "_b.*", F.array_join(F.slice("_lines", F.col("_b.start_line"), F.col("_b.end_line") - F.col("_b.start_line") + 1), "\n").alias("content"))
    return out.select(*rest, "start_line", "end_line", "content", F.coalesce("tokens", token_estimate(F.col("content"))).alias("tokens"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks, their lines and tokens, and the mean, least and largest tokens (0 without chunks)."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"), zero(F.sum(F.col("end_line") - F.col("start_line") + 1)).alias("lines"), zero(F.sum("tokens")).alias("tokens"),
        zero(F.floor(F.sum("tokens") / F.count(F.lit(1)))).alias("avg_tokens"), zero(F.min("tokens")).alias("min_tokens"), zero(F.max("tokens")).alias("max_tokens"),
    )


def drop_shadowed(chunks: DataFrame) -> DataFrame:
    """Drops untyped chunks of which a typed chunk of the same file covers nine tenths of the lines or more."""
    typed = chunks.where("chunk_type IS NOT NULL").select(F.col("file_path").alias("_file"), F.col("start_line").alias("_start"), F.col("end_line").alias("_end"))
    overlap = F.least("end_line", "_end") - F.greatest("start_line", "_start") + 1
    covered = (F.col("file_path") == F.col("_file")) & F.col("chunk_type").isNull() & (overlap * 10 >= (F.col("end_line") - F.col("start_line") + 1) * 9)
    return chunks.join(typed, covered, "left_anti")


# What starts an import line, by language.
IMPORT_STARTS = {
    "rust": r"^(pub )?(use |extern crate )", "python": r"^(import |from )", "javascript": r"^import |require\(", "typescript": r"^import |require\(",
    "go": r"^import ", "java": r"^import ", "swift": r"^import ", "kotlin": r"^import ", "csharp": r"^using ", "ruby": r"^(require |include )",
    "c": r"^#include ", "cpp": r"^#include ",
}


def import_names(language: str, line: str) -> list[str]:
    """Identifiers that an import line brings in; none for languages without a rule."""
    if language == "rust":
        last = line.rsplit("::", 1)[-1].strip()
        found = last[1:].rstrip().rstrip("}").split(",") if last.startswith("{") else [last]
    elif language == "python":
        found = line.split("import")[1].split(",") if "import" in line else []
    elif language in ("javascript", "typescript"):
        braces = re.search(r"\{([^}]+)\}", line)
        found = braces[1].split(",") if braces else []
    else:
        found = []
    return [f.strip() for f in found if f.strip()]


def file_imports(language: str, lines: list[str]) -> list[str]:
    """Distinct import lines among the first lines of a file, in order."""
    start = IMPORT_STARTS.get(language)
    if not start:
        return []
    found = (x.rstrip(";").strip() for x in map(str.strip, lines[:IMPORT_LINES]) if re.search(start, x))
    return list(dict.fromkeys(x for x in found if x))[:FILE_IMPORTS]


def used_imports(language: str, imports: list[str], content: str, limit: int) -> list[str]:
    """The imports of which a name occurs in the content; the first ones for languages without a rule for names."""
    if language not in ("rust", "python", "javascript", "typescript"):
        return imports[:limit]
    return [i for i in imports if any(n in content for n in import_names(language, i))][:limit]


def _tokens(text: str | None) -> int:
    return max(len(text.encode()) // 4, 1) if text is not None else 0


def _total(chunk: dict) -> int:
    return max(1, _tokens(chunk["content"]) + sum(map(_tokens, (chunk["parent_scope"], chunk["documentation"]))) + sum(map(_tokens, chunk["context_imports"])))


def merge_small(chunks: list[dict], config: ChunkConfig) -> list[dict]:
    """Joins neighbouring untyped chunks of which one is small, as long as the result stays within the maximum."""
    out: list[dict] = []
    for chunk in chunks:
        last = out[-1] if out else None
        joins = last and last["chunk_type"] is None and chunk["chunk_type"] is None and chunk["start_line"] <= last["end_line"] + 1
        if joins and last["tokens"] + chunk["tokens"] <= config.maximum and min(last["tokens"], chunk["tokens"]) < config.target // 2:
            gap = "" if last["content"].endswith("\n") else "\n"
            last |= {"content": last["content"] + gap + chunk["content"], "end_line": max(last["end_line"], chunk["end_line"])}
            last["context_imports"] = sorted({*last["context_imports"], *chunk["context_imports"]})[: config.max_imports]
            for name in ("language", "symbol_name", "qualified_name", "parent_scope", "documentation"):
                last[name] = last[name] if last[name] == chunk[name] else None
            last["tokens"] = _total(last)
        else:
            out.append(dict(chunk))
    return out


def overlap_chunks(chunks: list[dict], config: ChunkConfig) -> list[dict]:
    """Puts the last lines of each chunk, as it is by then, before the next; oldest lines go first while it is too long."""
    kind, _, amount = config.overlap.partition(":")
    out: list[dict] = []
    for chunk in map(dict, chunks):
        lines = out[-1]["content"].splitlines() if out and kind in ("lines", "tokens", "window") else []
        if kind == "lines":
            lines = lines[max(0, len(lines) - int(amount)) :]
        elif lines:
            left = int(amount) if kind == "tokens" else _tokens(out[-1]["content"]) * min(int(amount), 100) // 100
            first = len(lines)
            while left > 0 and first > 0:
                first -= 1
                left -= _tokens(lines[first])
            lines = lines[first:]
        while lines:
            longer = chunk | {"content": "\n".join(lines) + "\n" + chunk["content"], "start_line": max(1, chunk["start_line"] - len(lines))}
            longer["tokens"] = _total(longer)
            if longer["tokens"] <= config.maximum:
                chunk = longer
                break
            lines = lines[1:]
        out.append(chunk)
    return out


def _chunk(path: str, language: str, start: int, end: int, lines: list[str], **more) -> dict:
    out = {"file_path": path, "start_line": start, "end_line": end, "content": "\n".join(lines[start - 1 : end]), "language": language}
    out |= {"chunk_type": None, "symbol_name": None, "parent_scope": None, "qualified_name": None, "documentation": None, "context_imports": []} | more
    return out | {"tokens": _total(out)}


def _comment_above(lines: list[str], start: int, mark: str) -> str | None:
    found, at = [], start - 2
    while at >= 0 and (not lines[at].strip() or lines[at].strip().startswith(mark)):
        if lines[at].strip():
            found.append(lines[at].strip().lstrip("/#! ").rstrip())
        at -= 1
    return "\n".join(reversed(found)) or None


def python_chunks(path: str, lines: list[str]) -> list[dict]:
    """Functions and methods of a Python file; classes only give their members, wrappers are not looked into."""
    text = "\n".join(lines)
    tree = parsed_python(text)
    if tree is None:
        return []
    out, line_of = [], python_lines(text)

    def add(node, kind: str, scope: str | None) -> None:
        if not node.decorator_list:
            name = f"{scope}.{node.name}" if scope else node.name
            start, end = line_of[node.lineno - 1], line_of[node.end_lineno - 1]
            doc = ast.get_docstring(node) or _comment_above(lines, start, "#")
            doc = doc and doc.encode("utf-8", "replace").decode()  # escapes can make halves of characters
            out.append(_chunk(path, "python", start, end, lines, chunk_type=kind, symbol_name=node.name, parent_scope=scope, qualified_name=name, documentation=doc))

    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            add(node, "function", None)
        elif isinstance(node, ast.ClassDef) and not node.decorator_list:
            for member in node.body:
                if isinstance(member, ast.FunctionDef | ast.AsyncFunctionDef):
                    add(member, "method", node.name)
    return out


# How a line of documentation above an item starts.
DOC_LINES = {"rust": ("///", "//!", "/**"), "javascript": ("//", "/*", "*"), "typescript": ("//", "/*", "*")}


def doc_lines(language: str, lines: list[str], start: int) -> str | None:
    """Lines of documentation right above line `start`, as they stand; blank ones between them are skipped."""
    found: list[str] = []
    for at in range(start - 2, -1, -1):
        line = lines[at]
        if line.strip().startswith(DOC_LINES[language]):
            found.append(line)
        elif line.strip():
            break
    return "\n".join(reversed(found)) or None


def brace_chunks(path: str, language: str, lines: list[str]) -> list[dict]:
    """Items of a file in Rust, JavaScript or TypeScript and members of its types; methods of Rust are qualified by their type."""
    text, out = "\n".join(lines), []
    ends = [i for i, c in enumerate(text) if c == "\n"]
    for s in scopes_of(language, text):
        first, last = (bisect_left(ends, at) + 1 for at in (s.start, s.stop - 1))
        name = f"{s.parent}::{s.name}" if language == "rust" and s.chunk_type == "method" else s.name
        out.append(_chunk(path, language, first, last, lines, content=text[s.start : s.stop], chunk_type=s.chunk_type, symbol_name=s.name, parent_scope=s.parent, qualified_name=name, documentation=doc_lines(language, lines, first)))
    return out


def chunk_source(path: str, language: str, content: str, config: ChunkConfig) -> list[dict]:
    """All chunks of a file, post-processed: syntax where it is known, else the whole file or token blocks; imports, merging, shadowing, overlap, minimum."""
    lines = content.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    if not lines:
        return []
    if language == "python":
        found = python_chunks(path, lines)
    elif language in BRACES:
        found = brace_chunks(path, language, lines)
    else:
        found, start, total = [], 1, 0
        for n, line in enumerate(lines, 1):
            total += _tokens(line)
            if total >= config.target or n == len(lines):
                found.append(_chunk(path, language, start, n, lines))
                start, total = n + 1, 0
    found = sorted(found or [_chunk(path, language, 1, len(lines), lines)], key=lambda c: (c["start_line"], c["end_line"]))
    imports = file_imports(language, lines)
    for c in found:
        c["context_imports"] = sorted(used_imports(language, imports, c["content"], config.max_imports))
        c["tokens"] = _total(c)
    found = merge_small(found, config)
    typed = [(c["start_line"], c["end_line"]) for c in found if c["chunk_type"]]

    def shadowed(c: dict) -> bool:
        size = c["end_line"] - c["start_line"] + 1
        return c["chunk_type"] is None and any((min(c["end_line"], e) - max(c["start_line"], s) + 1) * 10 >= size * 9 for s, e in typed)

    found = overlap_chunks([c for c in found if not shadowed(c)], config)
    return [c for c in found if c["chunk_type"] or c["tokens"] >= config.minimum]


def chunk_files(files: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """Chunks of all files (file_path, content) by their language; empty ones have none."""
    config = config or ChunkConfig()
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows, size = [], 0
            for p, lang, text in zip(part["file_path"], part["language"], part["content"], strict=True):
                for chunk in chunk_source(p, lang, text, config):
                    rows.append(tuple(chunk[n] for n in names))
                    size += len(chunk["content"])
                    if len(rows) >= OUT_ROWS or size >= OUT_CHARS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    read = files.where(F.col("content") != "")
    return read.select("file_path", "content", language_of(F.col("file_path")).alias("language")).mapInPandas(run, CHUNKS)
