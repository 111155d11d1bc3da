"""Scalar functions on texts and queries, as column expressions."""

from __future__ import annotations

import re
import string

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

# Synonyms of code-search terms.
SYNONYMS = {
    "error": ("Error", "Err", "Result", "err", "failure", "exception"),
    "handle": ("handler", "handling", "process", "manage"),
    "handling": ("handler", "handle", "process", "manage"),
    "vector": ("embedding", "vec", "array", "tensor"),
    "similarity": ("distance", "cosine", "dot_product", "score"),
    "embedding": ("vector", "encode", "representation", "embed"),
    "search": ("find", "query", "lookup", "retrieve"),
    "index": ("indexing", "store", "build", "create"),
    "workspace": ("workspaces", "monorepo", "pnpm-workspace", "repo graph"),
    "pnpm": ("pnpm-workspace", "workspace", "monorepo"),
    "layout": ("workspace layout", "structure", "workspace structure", "pnpm-workspace", "pnpm-workspace.yaml"),
    "function": ("fn", "func", "method", "procedure"),
    "class": ("struct", "type", "object", "impl"),
    "method": ("function", "fn", "func", "member"),
    "parse": ("parser", "parsing", "analyze", "AST", "tree"),
    "ast": ("tree", "syntax", "parse", "parser", "node"),
    "chunk": ("split", "segment", "block", "part", "piece"),
    "helper": ("utility", "utils", "helper function", "support"),
    "fuzzy": ("approximate", "similarity", "match", "typo"),
}
MAX_EXPANSIONS = 15

# First words that mark a question, and needles that mark a wish for documentation.
QUESTION_LEADERS = (
    "how", "what", "why", "where", "when", "who", "which", "does", "do", "is", "are", "can", "could", "should", "will", "would",
    "explain", "describe", "tell", "show", "list", "find", "help",
    "как", "что", "почему", "где", "когда", "кто", "какой", "какая", "какие", "объясни", "объясните", "опиши", "опишите",
    "покажи", "покажите", "найди", "найдите", "перечисли", "перечислите",
)
DOCS_NEEDLES = (
    "readme", "docs", "documentation", "guide", "tutorial", "quick start", "usage", "install", "architecture", "rfc", "adr",
    "changelog", "license", "contributing", "philosophy",
)
# Semantic weight, fuzzy weight, pool multiplier of each query kind.
WEIGHTS = {"identifier": (0.1, 0.9, 3), "path": (0.15, 0.85, 4), "conceptual": (0.8, 0.2, 6), "conceptual_long": (0.9, 0.1, 6)}


def ascii_lower(text: Column) -> Column:
    """Lower case for ASCII letters only."""
    return F.translate(text, UPPER, LOWER)


def token_estimate(content: Column) -> Column:
    """Tokens of a text: a quarter of its UTF-8 bytes, one at least."""
    return F.greatest(F.floor(F.octet_length(content) / 4), F.lit(1)).cast("bigint")


def lines_of(content: Column) -> Column:
    """Lines without their line feeds; a final line feed ends the last line instead of starting one."""
    split = F.split(content, "\n")
    return F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)


def words_of(text: Column) -> Column:
    """ASCII alphanumeric runs of at least three characters, lower-cased, in order."""
    return F.filter(F.split(ascii_lower(text), "[^a-z0-9]+"), lambda x: F.length(x) >= 3)


def query_tokens(query: Column) -> Column:
    """Sorted distinct words of a query."""
    return F.array_sort(F.array_distinct(words_of(query)))


def content_tokens(content: Column, terms: Column, window: int) -> Column:
    """The first `window` words of a content that are query terms; repeats count."""
    return F.slice(F.filter(words_of(content), lambda x: F.array_contains(terms, x)), 1, window)


def keywords(text: Column, n: int) -> Column:
    """The n longest distinct words of a text, ties in order, as a query."""
    ranked = F.array_sort(F.transform(query_tokens(text), lambda x: F.struct((-F.length(x)).alias("l"), x.alias("w"))))
    return F.array_join(F.transform(F.slice(ranked, 1, n), lambda s: s["w"]), " ")


def camel_tokens(query: Column) -> Column:
    """Words at white space and underscores, cut again before a capital that follows no capital."""
    return F.regexp_extract_all(query, F.lit(r"(\p{Lu}+[^\p{Lu}\s_]*|[^\p{Lu}\s_]+)"), F.lit(1))


def expand_query(query: Column) -> Column:
    """The query, its lower-cased words and their synonyms, distinct in order, fifteen at most."""
    table = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for p in SYNONYMS.items() for x in p))
    words = F.transform(camel_tokens(query), F.lower)
    synonyms = F.flatten(F.transform(words, lambda w: F.coalesce(table[w], F.array().cast("array<string>"))))
    return F.slice(F.array_distinct(F.concat(F.array(query), words, synonyms)), 1, MAX_EXPANSIONS)


def _is_path(token: Column) -> Column:
    return token.rlike(r"[/\\]") | F.contains(token, F.lit("::")) | token.rlike(r"\.[A-Za-z0-9]{1,6}$")


def _is_identifier(text: Column) -> Column:
    return ~F.contains(text, F.lit(" ")) & (F.contains(text, F.lit("_")) | text.rlike("[0-9]") | (text.rlike("[a-z]") & text.rlike("[A-Z]")))


def query_kind(query: Column) -> Column:
    """path, identifier or conceptual."""
    trimmed = F.regexp_replace(query, r"^\s+|\s+$", "")
    tokens = F.split(trimmed, r"\s+")
    n, paths = F.size(tokens), F.size(F.filter(tokens, _is_path))
    first = F.regexp_replace(tokens[0], r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", "")
    leads = (n > 1) & (first != "") & ~_is_path(first) & ~F.lower(first).isin(*QUESTION_LEADERS) & _is_identifier(first)
    return (
        F.when(trimmed == "", "conceptual")
        .when((paths > 0) & ((paths == n) | (n <= 2)), "path")
        .when(leads | _is_identifier(trimmed), "identifier").otherwise("conceptual")
    )


def query_weights(query: Column) -> Column:
    """(semantic, fuzzy, multiplier) of a query's kind."""
    words = F.size(F.filter(F.split(query, r"\s+"), lambda x: x != ""))
    kind = query_kind(query)
    key = F.when((kind == "conceptual") & (words >= 4), "conceptual_long").otherwise(kind)
    struct = lambda w: F.struct(F.lit(w[0]).alias("semantic"), F.lit(w[1]).alias("fuzzy"), F.lit(w[2]).alias("multiplier"))
    out = struct(WEIGHTS["conceptual"])
    for name in ("identifier", "path", "conceptual_long"):
        out = F.when(key == name, struct(WEIGHTS[name])).otherwise(out)
    return out


def is_docs_intent(query: Column) -> Column:
    """Whether a query asks for documentation."""
    low = ascii_lower(F.trim(query))
    found = low.rlike(r"[^/]\.mdx?$")
    for needle in DOCS_NEEDLES:
        found = found | F.contains(low, F.lit(needle))
    return found


def candidate_pool(limit: int, multiplier: int) -> int:
    """Candidates to draw before fusion."""
    return max(limit, 1) * max(multiplier, 4)


def strategy_of(query: Column) -> Column:
    """How far to follow the graph: deep for questions on architecture, extended for flows, else direct."""
    low = F.lower(query)
    return F.when(low.rlike("architecture|overview|design|end-to-end|pipeline"), "deep").when(low.rlike("flow|how |call|depend|usage|impact"), "extended").otherwise("direct")


def word_position(text: Column, needle: str) -> Column:
    """1-based place of the first whole-identifier occurrence of needle, 0 if none; ASCII case is ignored.

    A needle with other characters than those of identifiers is found anywhere.
    """
    quoted = re.escape(needle.lower())
    if re.fullmatch(r"[A-Za-z0-9_]+", needle):
        pattern = f"(?<![a-z0-9_]){quoted}(?![a-z0-9_])"
    else:
        pattern = quoted
    return F.regexp_instr(ascii_lower(text), F.lit(pattern))


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the word sets of two texts; 0 if both are empty."""
    sets = [F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")) for x in (a, b)]
    both, either = F.size(F.array_intersect(*sets)), F.size(F.array_union(*sets))
    return F.when(either == 0, 0.0).otherwise(both / either)


def render_template(template: str, values: dict[str, Column], max_chars: int) -> Column:
    """A template with its {placeholders} filled in, cut to max_chars; unknown placeholders are errors."""
    parts = re.split(r"\{(\w+)\}", template)
    unknown = set(parts[1::2]) - set(values)
    if unknown:
        raise ValueError(f"unknown placeholders {sorted(unknown)}")
    columns = [F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)]
    return F.substring(F.concat(*columns), 1, max_chars)


def has_secret_assignment(content: Column) -> Column:
    """Whether a content seems to assign a credential: a key word, then a value of some length."""
    return content.rlike(r"""(?i)(password|passwd|secret|token|api_?key)["']?\s*[:=]\s*["']?[A-Za-z0-9+/_.\-]{8,}""")


def fnv1a64(data: bytes) -> int:
    """FNV-1a hash of 64 bits."""
    out = 0xCBF29CE484222325
    for byte in data:
        out = (out ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return out


#: Texts from which on hashing them side by side is faster than one after the other.
SIDE_BY_SIDE = 32


def fnv1a64_all(data: list[bytes]) -> np.ndarray:
    """fnv1a64() of each: a byte of all texts that are long enough at a time, the last few texts by themselves."""
    lengths = np.array([len(d) for d in data], np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat, starts = np.frombuffer(b"".join(data), np.uint8), (np.cumsum(lengths) - lengths)[order]
    longer, out, at = -lengths[order], np.full(len(data), 0xCBF29CE484222325, np.uint64), 0
    while (n := int(np.searchsorted(longer, -at, side="left"))) >= SIDE_BY_SIDE:
        for _ in range(int(-longer[n - 1]) - at):
            out[:n] = (out[:n] ^ flat[starts[:n] + at]) * np.uint64(0x100000001B3)
            at += 1
    for i in range(n):
        hashed = int(out[i])
        for byte in data[order[i]][at:]:
            hashed = (hashed ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        out[i] = hashed
    back = np.empty_like(out)
    back[order] = out
    return back


# Parts of queries that ask for a section, in English and Russian.
SECTION_HINTS = {
    "entrypoints": ("entrypoint", "entrypoints", "main", "cli", "точка входа", "точки входа", "входная точка", "входные точки", "запуск", "старт"),
    "contracts": (
        "contract", "contracts", "openapi", "asyncapi", "schema", "proto", "grpc", "api",
        "контракт", "контракты", "схема", "схемы", "спека", "спеки", "спецификац", "прото", "протокол", "апи",
    ),
    "brokers": ("broker", "brokers", "kafka", "nats", "amqp", "rabbit", "rabbitmq", "redis", "брокер", "брокеры", "кафка", "натс", "очеред", "шина"),
    "infra": (
        "infra", "config", "configs", "env", "environment", "settings", "deploy", "k8s", "kubernetes", "helm", "terraform", "gitops", "boundary",
        "инфра", "конфиг", "конфиги", "переменн", "окружен", "настройк", "деплой", "развер",
    ),
    "ci": ("ci", "workflow", "workflows", "github actions", "pipeline", "pipelines", "пайплайн", "гейт", "гейты", "экшн", "actions", "воркфло"),
    "artifacts": (
        "artifact", "artifacts", "output", "outputs", "result", "results", "checkpoint", "checkpoints",
        "артефакт", "артефакты", "вывод", "результат", "результаты", "чекпоинт", "чекпоинты",
    ),
    "experiments": (
        "experiment", "experiments", "baseline", "baselines", "bench", "benchmark", "eval", "evaluation", "research", "analysis", "notebook",
        "эксперимент", "эксперименты", "бейслайн", "бенч", "оценк", "исслед", "анализ", "ноутбук",
    ),
}


def section_hints(query: Column) -> dict[str, Column]:
    """For each section, whether a query asks for it."""
    low = F.lower(query)
    return {section: low.rlike("|".join(needles)) for section, needles in SECTION_HINTS.items()}
