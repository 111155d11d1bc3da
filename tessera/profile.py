"""Search profiles: path rules, thresholds, boosts and routing, as plain values."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class PathRule:
    """A pattern on lower-cased paths; kind is prefix, suffix, contains or glob."""

    pattern: str
    kind: str = "contains"
    weight: float = 1.0
    tokens: tuple[str, ...] = ()


def _contains(weight: float, *patterns: str) -> tuple[PathRule, ...]:
    return tuple(PathRule(p, "contains", weight) for p in patterns)


# Fixed values of the general profile.
BOOST = (
    PathRule("src/", "prefix", 1.3), PathRule("lib/", "contains", 1.2), PathRule("utils", "contains", 1.2),
    PathRule("configs/", "contains", 1.35), PathRule("tools/bench", "contains", 1.02), PathRule("workspace.yaml", "suffix", 1.45),
    PathRule("pnpm-workspace", "contains", 1.6), PathRule("packages/", "contains", 1.45),
)
PENALTY = (
    *_contains(0.15, "/tests/", "/test/"), *_contains(0.12, "__tests__"), *_contains(0.35, "docs/"),
    PathRule(".md", "suffix", 0.25), PathRule(".mdx", "suffix", 0.25), *_contains(0.35, "docker", "infra"),
    *_contains(0.45, "monitoring"), *_contains(0.08, "vendor"), PathRule(".log", "suffix", 0.15), *_contains(0.15, "logs/"),
    *_contains(0.45, "data/", "datasets/"), *_contains(0.1, "post-context", "marketing", "landing", "roadmap"),
    *_contains(0.3, "/e2e/"), *_contains(0.2, "AGENTS", "docker-compose"),
    PathRule("compose.yml", "suffix", 0.2), PathRule("compose.yaml", "suffix", 0.2), *_contains(0.1, "deploy/"),
    *_contains(0.05, "specs/", "bench_plan"), *_contains(0.02, "guardrails"), *_contains(0.05, "storefront"),
    *_contains(0.2, "runtime/src/bench"), *_contains(0.1, "docker-bake"), *_contains(0.15, "scripts/bench"),
    *_contains(0.08, "security/"), *_contains(0.15, "runtime/include/hd/flash", "runtime/src/flash"),
    *_contains(0.08, "runtime/include/hd/kv", "runtime/src/kv", "telemetry"), *_contains(0.05, "scheduler/bench.py"),
    *_contains(0.08, "warehouse"), *_contains(0.1, "bulk"), *_contains(0.08, "eslint_runner.bat"),
    *_contains(0.01, "transformer_engine_wheel"),
)
REJECT = _contains(
    1.0, ".git/", ".agents/mcp/.context", ".context/cache", "node_modules", "dist/", "build/",
    "target/", ".venv/", "venv/", ".direnv/", "transformer_engine_wheel",
)
NOISE = (
    *_contains(1.0, "audit", "report", "phase_", "docs/", "data/", "datasets/", "specs/", "bench_plan"),
    PathRule(".md", "suffix"), PathRule(".mdx", "suffix"), PathRule(".log", "suffix"),
    *_contains(
        1.0, "bench/logs", "post-context", "marketing", "landing", "roadmap", "/tests/", "/test/", "__tests__", ".test.", "/e2e/",
        "AGENTS", "docker-compose", "deploy/", "docker-bake", "guardrails", "storefront", "runtime/src/bench",
        "runtime/include/hd/flash", "runtime/src/flash", "runtime/include/hd/kv", "runtime/src/kv", "warehouse", "security/",
        "telemetry", "bulk", "eslint_runner.bat", "scheduler/bench.py", "scripts/bench", "transformer_engine_wheel",
    ),
)
MUST_HIT = (
    PathRule("workspace.yaml", "suffix", 1.6, ("workspace",)), PathRule("pnpm-workspace", "contains", 1.65, ("workspace",)),
    PathRule("tools/quant/bench_gemm.py", "contains", 2.4, ("gemm",)), PathRule("tools/kv/bench_allocator.py", "contains", 2.4, ("alloc",)),
    PathRule("packages/utils", "contains", 1.8, ("utility",)), PathRule("utils/", "contains", 1.4, ("utility",)),
)
EXPERTS = {
    "default": ("bge-small",), "identifier": ("bge-small",), "path": ("bge-small",),
    "conceptual": ("embeddinggemma-300m", "multilingual-e5-small", "bge-base", "bge-small"),
}
QUERY_TEMPLATES = {"default": "Query: {text}", "identifier": "Identifier: {text}", "path": "Path: {text}", "conceptual": "Question: {text}"}
DOCUMENT_TEMPLATES = {
    "default": "File: {path}\nKind: {doc_kind}\nLanguage: {language}\nChunkType: {chunk_type}\nSymbol: {qualified_name}\n\n{text}",
    "code": "File: {path}\nLanguage: {language}\nChunkType: {chunk_type}\nSymbol: {qualified_name}\nParent: {parent_scope}\nDoc: {documentation}\nImports:\n{imports}\n\n{text}",
    "docs": "Doc: {path}\n\n{text}",
    "config": "Config: {path}\n\n{text}",
    "test": "Test: {path}\nLanguage: {language}\n\n{text}",
}


@dataclass(frozen=True)
class Profile:
    """What steers retrieval; the defaults are those of the general profile."""

    name: str = "general"
    boost: tuple[PathRule, ...] = BOOST
    penalty: tuple[PathRule, ...] = PENALTY
    reject: tuple[PathRule, ...] = REJECT
    noise: tuple[PathRule, ...] = NOISE
    must_hit: tuple[PathRule, ...] = MUST_HIT
    min_fuzzy: float = 0.42
    min_semantic: float = 0.3
    k1: float = 1.35
    b: float = 0.7
    window: int = 210
    path_boost: float = 1.8
    symbol_boost: float = 2.2
    yaml_boost: float = 1.1
    bm25_weight: float = 1.1
    must_hit_bonus: float = 220.0
    graph_weight: float = 0.25
    graph_top_k: int = 25
    graph_neighbors: int = 12
    experts: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(EXPERTS))
    graph_enabled: bool = True
    graph_experts: tuple[str, ...] = ("bge-small",)
    max_chars: int = 8192
    query_templates: dict[str, str] = field(default_factory=lambda: dict(QUERY_TEMPLATES))
    document_templates: dict[str, str] = field(default_factory=lambda: dict(DOCUMENT_TEMPLATES))
    graph_template: str = "Graph: {text}"

    def query_template(self, kind: str) -> str:
        """The template of a query kind, else the default one."""
        return self.query_templates.get(kind, self.query_templates["default"])

    def document_template(self, kind: str) -> str:
        """The template of a kind of path, else the default one."""
        return self.document_templates.get(kind, self.document_templates["default"])

    def models(self, kind: str) -> tuple[str, ...]:
        """Model roster of a query kind, else the default one."""
        return self.experts.get(kind) or self.experts["default"]


#: Values that hold where a profile document leaves them out.
BARE = Profile(
    name="bare", boost=(), penalty=(), reject=(), noise=(), must_hit=(), min_fuzzy=0.15, min_semantic=0.0, k1=1.2, b=0.75, window=180,
    path_boost=1.5, symbol_boost=2.0, yaml_boost=1.5, bm25_weight=1.0, must_hit_bonus=25.0,
)

_KEYS = {
    "thresholds": {"min_fuzzy_score": "min_fuzzy", "min_semantic_score": "min_semantic"},
    "bm25": {"k1": "k1", "b": "b", "window": "window"},
    "boosts": {"path": "path_boost", "symbol": "symbol_boost", "yaml_path": "yaml_boost", "bm25": "bm25_weight"},
    "must_hit": {"base_bonus": "must_hit_bonus"},
}


def _rules(raw: list[dict], where: str) -> tuple[PathRule, ...]:
    out = []
    for i, rule in enumerate(raw):
        unknown = set(rule) - {"pattern", "kind", "weight", "tokens", "boost"}
        if unknown:
            raise ValueError(f"{where}[{i}]: unknown keys {sorted(unknown)}")
        if rule["pattern"].strip():
            weight = rule.get("weight", rule.get("boost", 1.0))
            out.append(PathRule(rule["pattern"], rule.get("kind", "contains"), float(weight), tuple(rule.get("tokens", ()))))
    return tuple(out)


_GRAPH_KEYS = {"enabled": "graph_enabled", "weight": "graph_weight", "top_k": "graph_top_k", "max_neighbors_per_relation": "graph_neighbors"}
# Kinds that have templates, and what these may name.
_TEMPLATES = {"query": ("default", "identifier", "path", "conceptual"), "document": ("default", "code", "docs", "config", "test"), "graph_node": ("default",)}
_PLACES = (
    "text", "path", "language", "chunk_type", "symbol", "qualified_name", "parent_scope", "documentation", "imports", "tags", "bundle_tags", "related_paths", "chunk_id",
    "start_line", "end_line", "doc_kind", "query_kind",
)


def _known(raw: dict, allowed, where: str) -> dict:  # noqa: ANN001
    unknown = set(raw) - set(allowed)
    if unknown:
        raise ValueError(f"{where}: unknown keys {sorted(unknown)}")
    return raw


def _templates(raw: dict, group: str) -> dict[str, str]:
    """Templates of a group by kind."""
    for kind, template in _known(raw, _TEMPLATES[group], f"embedding.{group}").items():
        unknown = set(re.findall(r"\{([^{}]*)\}", template)) - set(_PLACES)
        if unknown:
            raise ValueError(f"embedding.{group}.{kind}: unknown placeholders {sorted(unknown)}")
    return raw


def _embedding(raw: dict, base: Profile) -> dict:
    _known(raw, ("schema_version", "max_chars", *_TEMPLATES), "embedding")
    if raw.get("schema_version", 1) != 1:
        raise ValueError("embedding: schema_version must be 1")
    if int(raw.get("max_chars", 1)) < 1:
        raise ValueError("embedding.max_chars must be positive")
    return {
        "max_chars": int(raw.get("max_chars", base.max_chars)), "query_templates": base.query_templates | _templates(raw.get("query", {}), "query"),
        "document_templates": base.document_templates | _templates(raw.get("document", {}), "document"),
        "graph_template": _templates(raw.get("graph_node", {}), "graph_node").get("default", base.graph_template),
    }


def load_profile(text: str, base: Profile = BARE) -> Profile:
    """A profile from JSON laid over `base`; rule lists replace those of the base, unknown keys are errors."""
    raw = json.loads(text)
    unknown = set(raw) - {"name", "description", "paths", "must_hit", "rerank", "graph_nodes", "embedding", "experts"}
    if unknown:
        raise ValueError(f"profile: unknown keys {sorted(unknown)}")
    changes: dict = {"name": raw.get("name", base.name)}
    for group, rules in raw.get("paths", {}).items():
        if group not in ("boost", "penalty", "reject", "noise"):
            raise ValueError(f"paths: unknown key {group}")
        changes[group] = _rules(rules, f"paths.{group}")
    if "must_hit" in raw:
        changes["must_hit"] = _rules(raw["must_hit"], "must_hit")
    for section, values in raw.get("rerank", {}).items():
        for key, value in values.items():
            if key not in _KEYS.get(section, {}):
                raise ValueError(f"rerank.{section}: unknown key {key}")
            changes[_KEYS[section][key]] = value
    changes |= {_GRAPH_KEYS[k]: v for k, v in _known(raw.get("graph_nodes", {}), _GRAPH_KEYS, "graph_nodes").items()}
    if "embedding" in raw:
        changes |= _embedding(raw["embedding"], base)
    if "experts" in raw:
        experts = _known(raw["experts"], ("schema_version", "semantic", "graph_nodes"), "experts")
        if experts.get("schema_version", 1) != 1:
            raise ValueError("experts: schema_version must be 1")
        changes["experts"] = base.experts | {k: tuple(v) for k, v in experts.get("semantic", {}).items()}
        changes["graph_experts"] = tuple(_known(experts.get("graph_nodes", {}), ("default",), "experts.graph_nodes").get("default", base.graph_experts))
    return replace(base, **changes)


GENERAL = Profile()
FAST = replace(GENERAL, name="fast", experts={"default": ("bge-small",)})
QUALITY = replace(GENERAL, name="quality", experts=EXPERTS | {"default": ("embeddinggemma-300m", "bge-small")})
