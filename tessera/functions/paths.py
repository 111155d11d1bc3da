"""Scalar functions and predicates on file paths, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import ascii_lower
from tessera.profile import PathRule, Profile

# Languages by extension, and by name for files that have none.
LANGUAGES = {
    "rust": ("rs",), "python": ("py", "pyw"), "javascript": ("js", "mjs", "cjs"), "typescript": ("ts", "tsx"), "go": ("go",),
    "java": ("java",), "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx"), "csharp": ("cs",), "ruby": ("rb",),
    "swift": ("swift",), "kotlin": ("kt", "kts"), "markdown": ("md", "mdx", "rst", "adoc"), "yaml": ("yaml", "yml"), "json": ("json",),
    "config": ("toml", "ini", "cfg", "conf", "properties", "env", "gradle", "groovy"), "sql": ("sql", "dbml"),
    "shell": ("sh", "bash", "zsh", "fish", "ps1", "bat", "cmd"), "terraform": ("tf", "tfvars", "hcl"), "html": ("html",),
    "css": ("css", "scss", "less"),
}
LANGUAGE_NAMES = {"Dockerfile": "terraform", "docker-compose.yml": "terraform", "Makefile": "shell", "makefile": "shell"}
# Extensions of documentation and configuration, names of test directories.
DOCS_EXTENSIONS = ("md", "mdx", "rst", "adoc", "txt", "context")
CONFIG_EXTENSIONS = ("toml", "yaml", "yml", "json", "ini", "cfg", "conf")
TEST_DIRECTORIES = ("test", "tests", "__tests__")
# Chunk types with their priority.
TYPE_PRIORITY = {
    "function": 100, "method": 100, "class": 90, "struct": 90, "enum": 85, "interface": 85, "impl": 80, "type": 70, "module": 60,
    "const": 50, "variable": 50, "import": 40, "comment": 20, "other": 10,
}
# Extensions of files that are never read, and names that are exempt.
SECRET_EXTENSIONS = ("pem", "key", "p12", "pfx", "env")
SECRET_EXEMPT = (".env.example", ".env.sample", ".env.template", ".env.dist")
# Directories and extensions of descriptions of interfaces.
INTERFACE_ROOTS = ("contracts", "proto")
CONTRACT_ROOTS = ("schemas", "schema", "spec", "specs", "protocol", "protocols")
INTERFACE_NESTED = ("contracts", "contract", "schemas", "schema", "specs", "spec", "protocols", "protocol")
INTERFACE_EXTENSIONS = ("proto", "avsc", "yaml", "yml", "json", "toml", "md", "rst", "txt")
INDEX_NAMES = ("readme.md", "readme.rst", "readme.txt", "index.md")
# Areas of changed paths in the order of a report, and what speaks for them.
AREA_ORDER = ("interfaces", "core", "ci", "docs", "tooling", "infra", "outputs", "experiments")
CI_NAMES = (".gitlab-ci.yml", "jenkinsfile")
INFRA_AREA = ("k8s", "kubernetes", "manifests", "gitops", "infra", "terraform", "charts")
OUTPUT_SCOPES = (
    "artifacts", "artifact", "results", "runs", "outputs", "output", "checkpoints", "checkpoint",
    "data", "dataset", "datasets", "corpus", "corpora", "weights",
)
EXPERIMENT_ROOTS = ("experiments", "experiment", "baselines", "baseline", "bench", "benches")
EXPERIMENT_NESTED = ("eval", "evaluation", "analysis", "notebooks")
TOOLING_NAMES = ("makefile", "justfile", "cargo.toml", "package.json", "pyproject.toml")
CODE_EXTENSIONS = ("rs", "py", "js", "ts", "tsx", "go", "java", "kt", "c", "cc", "cpp", "cxx", "h", "hpp", "cs", "rb", "php", "swift")
PROSE_EXTENSIONS = ("md", "rst", "txt")
# Names of entry points at the root and in a source directory.
ENTRY_ROOT = (
    "main.rs", "main.py", "__main__.py", "app.py", "server.py", "index.js", "server.js", "main.ts", "server.ts",
    "main.c", "main.cpp", "main.cc", "main.cxx",
)
ENTRY_SRC = (
    "main.rs", "main.py", "__main__.py", "app.py", "server.py", "index.js", "index.ts", "main.c", "main.cpp", "main.cc", "main.cxx",
)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension, null for a name without one or with a leading dot only."""
    name = base_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), ascii_lower(F.substring_index(name, ".", -1)))


def language_of(path: Column) -> Column:
    """Programming language of a path, "unknown" if none is known."""
    ext, out = extension(path), F.lit("unknown")
    for name, language in LANGUAGE_NAMES.items():
        out = F.when(base_name(path) == name, language).otherwise(out)
    known = F.lit("unknown")
    for language, extensions in LANGUAGES.items():
        known = F.when(ext.isin(*extensions), language).otherwise(known)
    return F.when(ext.isNotNull(), known).otherwise(out)


def path_kind(path: Column) -> Column:
    """docs and config by extension, then test by directory, code for any other extension, else other."""
    ext = extension(path)
    tested = F.exists(F.split(ascii_lower(path), "/"), lambda part: part.isin(*TEST_DIRECTORIES))
    return (
        F.when(ext.isin(*DOCS_EXTENSIONS), "docs").when(ext.isin(*CONFIG_EXTENSIONS), "config").when(tested, "test")
        .when(ext.isNotNull(), "code").otherwise("other")
    )


def type_priority(chunk_type: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, priority in TYPE_PRIORITY.items():
        out = F.when(chunk_type == name, priority).otherwise(out)
    return out


def directory_key(path: Column, depth: int) -> Column:
    """The first `depth` directories of a path, "." for a file at the root."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    dirs = F.slice(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), 1, depth)
    return F.when(F.size(dirs) == 0, ".").otherwise(F.array_join(dirs, "/"))


def below(low: Column, top: Iterable[str] = (), nested: Iterable[str] = ()) -> Column:
    """Whether a path starts with a directory of `top` or has one of `nested` further down."""
    out = F.lit(False)
    if top:
        out = out | low.rlike(f"^({'|'.join(map(re.escape, top))})/")
    if nested:
        out = out | low.rlike(f"/({'|'.join(map(re.escape, nested))})/")
    return out


def changed_area(path: Column) -> Column:
    """Area of a changed path, null if no rule holds; those of the store of working copies have none."""
    low = ascii_lower(F.trim(path))
    name, last = base_name(low), F.substring_index(low, ".", -1)
    described = low.rlike(rf"\.({'|'.join(INTERFACE_EXTENSIONS)})$") | (name == "")
    return (
        F.when((low == "") | (low == ".worktrees") | F.startswith(low, F.lit(".worktrees/")), None)
        .when(below(low, INTERFACE_ROOTS, INTERFACE_NESTED) & described & ~name.isin(*INDEX_NAMES), "interfaces")
        .when(name.isin(*CI_NAMES) | F.startswith(low, F.lit(".github/workflows/")), "ci")
        .when(below(low, INFRA_AREA, INFRA_AREA), "infra")
        .when(artifact_scope(low), "outputs")
        .when(below(low, EXPERIMENT_ROOTS, EXPERIMENT_NESTED), "experiments")
        .when(name.isin(*TOOLING_NAMES) | below(low, ["scripts"]), "tooling")
        .when(last.isin(*CODE_EXTENSIONS), "core")
        .when(below(low, ["docs"]) | last.isin(*PROSE_EXTENSIONS), "docs")
    )


def artifact_scope(low: Column) -> Column:
    """Whether the first part of a path in lower case is a place for results or data."""
    return F.trim(F.substring_index(low, "/", 1)).isin(*OUTPUT_SCOPES)


# Roles of top-level directories by their whole name.
LAYER_ROLES = {
    "cli": "Command-line interface", "cmd": "Command-line interface", "bin": "Command-line interface",
    "api": "API/Server layer", "server": "API/Server layer", "web": "API/Server layer",
    "core": "Core library", "lib": "Core library", "src": "Core library",
    "test": "Test suite", "tests": "Test suite", "crates": "Workspace crates", "docs": "Documentation", "doc": "Documentation",
}


def layer_role(name: Column) -> Column:
    """What a top-level directory is likely for, by its whole name in any case."""
    out = F.lit("Module")
    for directory, role in LAYER_ROLES.items():
        out = F.when(F.lower(name) == directory, role).otherwise(out)
    return out


def glob_regex(glob: str) -> str:
    """Regular expression of a glob in which `*` and `?` stay within a path segment and `**` does not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"^{out}$"


def rule_matches(path: Column, rule: PathRule) -> Column:
    """Whether a rule holds for a path that is already in lower case."""
    needle = rule.pattern.lower()
    if rule.kind == "glob":
        return path.rlike(glob_regex(needle))
    return {"prefix": F.startswith, "suffix": F.endswith, "contains": F.contains}[rule.kind](path, F.lit(needle))


def any_rule(path: Column, rules: Iterable[PathRule]) -> Column:
    """Whether any rule holds; the rules become one expression, so no join is needed."""
    low, out = ascii_lower(path), F.lit(False)
    for rule in rules:
        out = out | rule_matches(low, rule)
    return out


def rule_weight(path: Column, rules: Iterable[PathRule]) -> Column:
    """Product of the weights of all rules that hold."""
    low, out = ascii_lower(path), F.lit(1.0)
    for rule in rules:
        out = out * F.when(rule_matches(low, rule), rule.weight).otherwise(1.0)
    return out


def path_weight(path: Column, profile: Profile, kind: Column) -> Column:
    """Boosts for all queries, penalties for conceptual ones only."""
    return F.when(kind == "conceptual", rule_weight(path, [*profile.boost, *profile.penalty])).otherwise(rule_weight(path, profile.boost))


def path_allowed(path: Column, include: list[str], exclude: list[str], pattern: str | None = None) -> Column:
    """Below one of the included prefixes (any if there are none) and of no excluded one, and matching a glob or substring."""

    def within(prefixes: list[str]) -> Column:
        out = F.lit(False)
        for prefix in (p.strip().strip("/").removeprefix("./") for p in prefixes):
            if prefix:
                out = out | (path == prefix) | F.startswith(path, F.lit(f"{prefix}/"))
        return out

    allowed = ~within(exclude)
    if any(p.strip() for p in include):
        allowed = allowed & within(include)
    if pattern and pattern.strip():
        glob = any(c in pattern for c in "*?")
        # a glob without a directory is held against the name alone
        target = path if "/" in pattern else base_name(path)
        allowed = allowed & (target.rlike(glob_regex(pattern)) if glob else F.contains(path, F.lit(pattern)))
    return allowed


def is_secret_file(path: Column) -> Column:
    """Whether a name or extension marks a file with credentials; templates of .env files do not."""
    name = ascii_lower(base_name(path))
    secret = name.rlike(r"^\.env(\..+)?$") | extension(path).isin(*SECRET_EXTENSIONS) | name.isin("id_rsa", "id_ed25519", ".npmrc", ".netrc", ".pypirc")
    return F.coalesce(secret, F.lit(False)) & ~name.isin(*SECRET_EXEMPT)


def entrypoint_rank(path: Column) -> Column:
    """Rank of a file as the place to start reading, null if it is none: mains at the root, then in sources, then roots of libraries."""
    low = ascii_lower(path)
    name, folder = base_name(low), F.regexp_replace(low, "[^/]*$", "")
    in_src = F.endswith(folder, F.lit("/src/"))
    return (
        F.when((folder == "") & name.isin(*ENTRY_ROOT), 0)
        .when((folder == "src/") & name.isin(*ENTRY_SRC), 1)
        .when(in_src & name.isin(*ENTRY_SRC), 2)
        .when((name == "main.go") & ((folder == "") | F.startswith(folder, F.lit("cmd/"))), 2)
        .when((name == "lib.rs") & (folder.isin("", "src/") | in_src), 3)
        .when((name == "__init__.py") & (folder == "src/"), 3)
        .when((name == "__init__.py") & folder.rlike("^src/[^/]*/$"), 4)
    )


def is_contract(path: Column) -> Column:
    """Whether a file describes an interface."""
    low = ascii_lower(path)
    described = low.rlike(rf"\.({'|'.join(INTERFACE_EXTENSIONS)})$")
    return (
        (below(low, INTERFACE_ROOTS + CONTRACT_ROOTS, INTERFACE_NESTED) & described) | below(low, INTERFACE_ROOTS)
        | low.rlike(r"\.(proto|schema\.json)$|(openapi|asyncapi)\.(json|yaml|yml)$|/(openapi|asyncapi)\.")
    )


def contract_kind(path: Column) -> Column:
    """What a description of an interface is written in."""
    low = ascii_lower(path)
    return (
        F.when(F.endswith(low, F.lit(".proto")) | below(low, ["proto"]), "proto").when(F.endswith(low, F.lit(".schema.json")), "jsonschema")
        .when(low.rlike(r"openapi\.(json|yaml|yml)$|/openapi\."), "openapi").when(low.rlike(r"asyncapi\.(json|yaml|yml)$|/asyncapi\."), "asyncapi").otherwise("contract")
    )
