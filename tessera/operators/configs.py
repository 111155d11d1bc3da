"""Files of builds, services and contracts: their entries as rows of key paths, the steps they name, the flows of messages they describe."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.paths import base_name, contract_kind
from tessera.functions.text import ascii_lower
from tessera.operators.lines import explode_lines

ENTRIES = "file_path string, form string, n long, keys array<string>, value string"
_SCHEMA = pa.schema([("file_path", pa.string()), ("form", pa.string()), ("n", pa.int64()), ("keys", pa.list_(pa.string())), ("value", pa.string())])
#: Rows of one Arrow batch that goes back to Spark.
BATCH_ROWS = 10_000
_BLOCK = re.compile(r"[|>][+-]?\d?$|[|>]\d[+-]?$")

# Kinds of steps in the order of a report.
STEP_ORDER = ("setup", "build", "run", "test", "eval", "lint", "format")
# What tells the kind of a command, in order; words that make one a test where nothing else does.
COMMANDS = (
    ("setup", ("git lfs install", "git lfs pull", "pip install", "poetry install", "uv pip", "pnpm install", "npm install", "yarn install")),
    ("build", ("cargo build", "npm run build", "pnpm build", "go build", "dotnet build", "cmake -s", "cmake --build", "ninja")),
    ("run", ("cargo run", "python -m", "go run", "npm run dev", "npm start", "pnpm dev", "yarn dev")),
    ("test", ("cargo test", "pytest", "ctest", "go test", "dotnet test", "npm test", "pnpm test", "yarn test")),
    ("eval", ("bench", "benchmark", "eval")),
    ("lint", ("lint", "clippy", "golangci-lint", "eslint", "ruff", "mypy", "pylint")),
    ("format", ("cargo fmt", "rustfmt", "gofmt", "prettier", " fmt", "format")),
)
RUN_STARTS = ("python ", "python3 ")
TEST_WORDS = ("validate", "check")
# Patterns of the names of targets and scripts, in order.
TARGETS = (
    ("setup", r"^(doctor|preflight|setup|install|bootstrap|deps|dep|init)$"), ("build", r"^build$"), ("run", r"^(run|start|serve|dev)$"),
    ("test", r"^test|^(unit|integration)$"), ("test", r"^(check|validate|verify|smoke|skeleton|ci)$|^ci-|smoke|gate"), ("eval", r"eval|bench"),
    ("lint", r"^lint$"), ("format", r"^(fmt|format)$"),
)
# The pattern of actions that set up, kinds of anchors that are read for steps, in order.
SETUP_ACTIONS = r"^actions/(checkout|setup-)|rust-toolchain|cache"
STEP_ANCHORS = ("howto", "ci", "canon", "experiment")
MAX_STEPS, LABEL_CHARS, MAX_CHANNELS = 6, 80, 10
_SPACE = " \t\r\n\x0b\x0c"


def _uncomment(s: str) -> str:
    """s up to a comment, which starts with # after white space or at once, outside of quotes."""
    if "#" not in s:
        return s
    quote, before = "", " "
    for i, c in enumerate(s):
        if quote:
            quote = "" if c == quote and before != "\\" else quote
        elif c in "\"'" and before in " \t:[{,":
            quote = c
        elif c == "#" and before in " \t":
            return s[:i]
        before = c
    return s


def _scalar(s: str) -> str | None:
    """The text of a plain or quoted scalar, null where there is none."""
    if len(s) > 1 and s[0] == s[-1] == '"':
        try:
            return str(json.loads(s))
        except ValueError:
            return s[1:-1]
    if len(s) > 1 and s[0] == s[-1] == "'":
        return s[1:-1].replace("''", "'")
    return s or None


def _key(s: str) -> tuple[str, str] | None:
    """(key, what follows it) of an entry of a mapping, None if s is none."""
    if s[:1] in ('"', "'"):
        end = s.find(s[0], 1)
        while end > 0 and s[0] == '"' and s[end - 1] == "\\":
            end = s.find('"', end + 1)
        if end < 0 or not re.match(r"\s*:(\s|$)", s[end + 1 :]):
            return None
        return _scalar(s[: end + 1]) or "", s[s.index(":", end + 1) + 1 :].strip()
    m = re.search(r":(?:[ \t]|$)", s)
    if not m or s[0] in "{[|>&*!%@`":
        return None
    return s[: m.start()].strip(), s[m.end() :].strip()


def _text(value) -> str | None:
    return None if value is None or isinstance(value, (dict, list)) else value if isinstance(value, str) else json.dumps(value)


def _flatten(value, keys: list[str]) -> Iterator[tuple[list[str], str | None]]:
    """All entries below a value of JSON, with no recursion."""
    todo = [(keys, value)]
    while todo:
        keys, value = todo.pop()
        if keys:
            yield keys, _text(value)
        below = list(value.items()) if isinstance(value, dict) else [(str(i), v) for i, v in enumerate(value)] if isinstance(value, list) else []
        todo += [([*keys, k], v) for k, v in reversed(below)]


def _indented(text: str) -> Iterator[tuple[int, list[str], str | None]]:
    """(line, keys, value) of all entries, by a stack of the open ones with their indents.

    A stack entry is [indent, key, items so far, whether it is an item]. Items may stand as deep as the key they belong to.
    """
    stack: list[list] = [[-1, None, 0, False]]
    keys = lambda *last: [e[1] for e in stack[1:]] + list(last)
    block = None  # [line, keys, indent, lines, folded] of a scalar over several lines
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.rstrip("\r")
        indent = len(line) - len(line.lstrip(" \t"))
        if block is not None:
            if not line.strip() or indent > block[2]:
                block[3].append(line.strip())
                continue
            yield block[0], block[1], (" " if block[4] else "\n").join(block[3]).strip()
            block = None
        rest = _uncomment(line).strip()
        if not rest or rest.startswith(("---", "...", "%")):
            if rest.startswith("---"):
                del stack[1:]
            continue
        item = False
        while rest == "-" or rest.startswith(("- ", "-\t")):
            item = True
            while stack[-1][0] > indent or (stack[-1][0] == indent and stack[-1][3]):
                stack.pop()
            place = str(stack[-1][2])
            stack[-1][2] += 1
            stack.append([indent, place, 0, True])
            inner = rest[1:].lstrip()
            indent += len(rest) - len(inner) if inner else 1
            rest = inner
            if not rest or _key(rest) or rest.startswith("- "):
                yield n, keys(), None
        if not rest:
            continue
        found = _key(rest)
        if found is None:  # an item, or what goes on from a line before and has no entry of its own
            if item:
                if _BLOCK.match(rest):
                    block = [n, keys(), stack[-1][0], [], rest[0] == ">"]
                else:
                    yield from _valued(n, keys(), rest)
            continue
        while stack[-1][0] >= indent:
            stack.pop()
        key, value = found
        stack.append([indent, key, 0, False])
        if _BLOCK.match(value):
            block = [n, keys(), indent, [], value[0] == ">"]
        else:
            yield from _valued(n, keys(), value)
    if block is not None:
        yield block[0], block[1], (" " if block[4] else "\n").join(block[3]).strip()


def _valued(n: int, keys: list[str], value: str) -> Iterator[tuple[int, list[str], str | None]]:
    """The entry, or those of a value in JSON's form on one line."""
    if value[:1] in ("{", "["):
        try:
            yield from ((n, k, v) for k, v in _flatten(json.loads(value), keys))
            return
        except (ValueError, RecursionError):
            pass
    yield n, keys, _scalar(value)


def _entries(text: str) -> Iterator[tuple[str, int, list[str], str | None]]:
    if text.lstrip()[:1] in ("{", "["):
        try:
            found = json.loads(text)
        except (ValueError, RecursionError):
            pass
        else:
            yield from (("json", i, k, v) for i, (k, v) in enumerate(_flatten(found, []), 1))
            return
    yield from (("indented", n, k, v) for n, k, v in _indented(text))


def _entry_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)

    for given in batches:
        for path, content in zip(*(given.column(i).to_pylist() for i in (0, 1))):
            for entry in _entries(content or ""):
                rows.append((path, *entry))
                if len(rows) == BATCH_ROWS:
                    yield batch()
                    rows.clear()
    if rows:
        yield batch()


def config_entries(files: DataFrame) -> DataFrame:
    """file_path, form (json, indented), n, keys, value: a row for each entry of the files (file_path, content), containers too (value null).

    n is the line of an indented entry, else its place in the document. Items have their numbers from 0 as keys. Of YAML, mappings, items,
    quotes, comments, scalars over several lines and values in JSON's form are read; other collections within a line, anchors, tags and what
    goes on from a plain line stay text or are left out. Repeated keys give repeated rows. A null or empty text has no rows.
    """
    return files.select("file_path", "content").mapInArrow(_entry_batches, ENTRIES)


def _cases(pairs, otherwise: Column | None = None) -> Column:
    out = F.lit(None).cast("string") if otherwise is None else otherwise
    for kind, condition in reversed(list(pairs)):
        out = F.when(condition, kind).otherwise(out)
    return out


def command_kind(command: Column) -> Column:
    """The kind of a step that a command stands for, null if none."""
    low = ascii_lower(command)
    word = F.when(low.rlike(rf"(?<![a-z0-9])({'|'.join(TEST_WORDS)})(?![a-z0-9])"), "test")
    starts = {"run": [F.startswith(low, F.lit(s)) for s in RUN_STARTS]}
    pairs = []
    for kind, needles in COMMANDS:
        met = low.rlike("|".join(map(re.escape, needles)))
        for more in starts.get(kind, []):
            met = met | more
        pairs.append((kind, met))
    return _cases(pairs, word)


def target_kind(name: Column) -> Column:
    """The kind of a target of a build file or of a script, null if none."""
    low = F.btrim(ascii_lower(name), F.lit(_SPACE))
    return _cases((kind, low.rlike(pattern)) for kind, pattern in TARGETS)


def step_rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STEP_ORDER)), kind)


def pipeline_steps(files: DataFrame) -> DataFrame:
    """file_path, n, kind, label, confidence: the steps that files (file_path, content) name.

    A makefile or justfile has its targets, package.json its scripts (n null), each label once; any other file the first command of each
    kind by line, MAX_STEPS kinds at most, where `run:` and `uses:` of workflows are commands. A null text has no steps.
    """
    name = ascii_lower(base_name(F.col("file_path")))
    known = files.select("file_path", "content", name.alias("_name"))
    trim = lambda c: F.btrim(c, F.lit(_SPACE))

    scripts = known.where("_name = 'package.json'").select("file_path", F.explode(F.array_distinct(F.json_object_keys(F.get_json_object("content", "$.scripts")))).alias("_s"))
    scripts = scripts.select("file_path", F.lit(None).cast("int").alias("n"), target_kind(F.col("_s")).alias("kind"), F.concat(F.lit("npm run "), "_s").alias("label"), F.lit(0.85).alias("confidence"))

    lines = explode_lines(known.where("_name <> 'package.json'"))
    make = F.col("_name").isin("makefile", "justfile")
    target = F.regexp_extract("line", r"^\s*([A-Za-z0-9_.\-]{1,32})\s*:", 1)
    made = lines.where(make & (target != "")).select(
        "file_path", "n", target_kind(target).alias("kind"), F.concat(F.when(F.col("_name") == "makefile", "make ").otherwise("just "), target).alias("label")
    )
    made = made.where("kind IS NOT NULL").groupBy("file_path", "kind", "label").agg(F.min("n").alias("n")).select("file_path", "n", "kind", "label", F.lit(0.9).alias("confidence"))

    command = trim(F.regexp_replace(trim(F.col("line")), r"^\$", ""))
    said = lines.where(~make).withColumn("_c", command).where((F.col("_c") != "") & ~F.startswith("_c", F.lit("#")))
    uses = F.regexp_extract("_c", r"^(?:- )?uses:(.*)$", 1)
    is_uses = F.col("_c").rlike(r"^(- )?uses:")
    plain = trim(F.regexp_replace("_c", r"^(- )?run:", ""))
    kind = F.when(is_uses, F.when(trim(ascii_lower(uses)).rlike(SETUP_ACTIONS), "setup")).otherwise(command_kind(plain))
    label = F.rtrim(F.substring(F.when(is_uses, F.concat(F.lit("uses "), trim(uses))).otherwise(plain), 1, LABEL_CHARS))
    said = said.select("file_path", kind.alias("kind"), F.struct("n", label.alias("label"), F.when(is_uses, 0.7).otherwise(0.75).alias("confidence")).alias("_f")).where("kind IS NOT NULL")
    first = said.groupBy("file_path", "kind").agg(F.min("_f").alias("_f"))  # seven rows a file at most
    place = F.row_number().over(W.partitionBy("file_path").orderBy("_f.n"))
    said = first.withColumn("_p", place).where(F.col("_p") <= MAX_STEPS).select("file_path", "_f.n", "kind", "_f.label", "_f.confidence")
    return scripts.where("kind IS NOT NULL").unionByName(made).unionByName(said)


def build_steps(files: DataFrame, anchors: DataFrame) -> DataFrame:
    """kind, label, confidence, file_path: MAX_STEPS steps at most of what is read first, one of each kind, in STEP_ORDER.

    anchors: kind, file_path, as from select_anchors(), thus a row for each kind of anchor. Those of STEP_ANCHORS are read in that order, the
    steps of a file by kind, then label.
    """
    source = F.array_position(F.array(*map(F.lit, STEP_ANCHORS)), F.col("kind"))
    read = anchors.where(F.col("kind").isin(*STEP_ANCHORS)).groupBy("file_path").agg(F.min(source).alias("_source"))
    steps = pipeline_steps(files.join(F.broadcast(read), "file_path", "left_semi")).join(F.broadcast(read), "file_path")
    order = F.struct("_source", step_rank(F.col("kind")).alias("_rank"), "label", "confidence", "file_path")
    best = steps.groupBy("kind").agg(F.min(order).alias("_o")).orderBy("_o").limit(MAX_STEPS)
    return best.orderBy("_o._rank", "_o.label").select("kind", "_o.label", "_o.confidence", "_o.file_path")


def _directories(path: Column) -> Column:
    """The directories above a path, from the top, each with all before it; an empty text for a path at the root."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(F.size(parts) > 1, above).otherwise(F.array(F.lit("")))


def flow_actors(contracts: DataFrame, entries: DataFrame) -> DataFrame:
    """file_path, actor: the entry point that shares most directories with a contract, the first of these; one at the root has the only entry point there is, if so."""
    only = entries.agg(F.count(F.lit(1)).alias("_n"), F.min("file_path").alias("actor")).where("_n = 1").select(F.lit("").alias("_dir"), "actor")
    within = entries.select(F.col("file_path").alias("actor"), F.explode(_directories(F.col("file_path"))).alias("_dir")).where("_dir <> ''")
    actors = within.groupBy("_dir").agg(F.min("actor").alias("actor")).unionByName(only)
    near = contracts.select("file_path", F.explode(_directories(F.col("file_path"))).alias("_dir")).distinct()
    depth = F.size(F.split("_dir", "/"))
    return near.join(actors, "_dir").groupBy("file_path").agg(F.max_by("actor", depth).alias("actor"))


def asyncapi_flows(contracts: DataFrame, entries: DataFrame, limit: int = MAX_CHANNELS) -> DataFrame:
    """file_path, channel, direction, protocol, actor: the first channels by name of AsyncAPI documents, in JSON or YAML, with what is done on them.

    contracts: file_path, content; those named so, or that say so by their first key, are read. entries: file_path. The protocol is the first
    of the servers, by name in JSON, by line in YAML, in lower case; the actor is that of flow_actors().
    """
    named = contract_kind(F.col("file_path")) == "asyncapi"
    may = contracts.where(named | F.contains("content", F.lit("asyncapi")))
    keys, value = F.col("keys"), ascii_lower(F.btrim("value", F.lit(_SPACE)))
    top, depth = F.get(keys, 0), F.size(keys)
    json_form = F.col("form") == "json"
    server = F.element_at(keys, -1) == "protocol"
    protocol = F.when((value != "") & server & (~json_form | ((top == "servers") & (depth == 3))), value)
    order = F.struct(F.when(json_form, F.get(keys, 1)).alias("s"), "n")
    side = F.get(keys, 2)
    told = config_entries(may).select(
        "file_path", (named | ((top == "asyncapi") & (depth == 1))).alias("_is"), protocol.alias("_protocol"), order.alias("_order"),
        F.when((top == "channels") & (depth >= 2), F.get(keys, 1)).alias("channel"), F.when((depth == 3) & side.isin("publish", "subscribe"), side).alias("direction"),
    ).where("_is OR _protocol IS NOT NULL OR channel IS NOT NULL")
    # a row for each file and channel, and one without a channel for each file
    by = told.groupBy("file_path", "channel").agg(
        F.bool_or("_is").alias("_is"), F.min(F.when(F.col("_protocol").isNotNull(), F.struct("_order", "_protocol"))).alias("_p"), F.collect_set("direction").alias("_sides")
    )
    file = W.partitionBy("file_path")
    place = F.row_number().over(file.orderBy(F.col("channel").asc_nulls_last()))
    whole = by.withColumns({"_is": F.bool_or("_is").over(file), "_p": F.min("_p").over(file), "_place": place})
    flows = whole.where(F.col("_is") & F.col("channel").isNotNull() & (F.col("_place") <= limit))
    flows = flows.select("file_path", "channel", F.explode("_sides").alias("direction"), F.col("_p._protocol").alias("protocol"))
    return flows.join(flow_actors(contracts, entries), "file_path", "left")
