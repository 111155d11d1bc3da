"""Orientation in a set of files: what they are for, where to start, and a short pack of it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.paths import AREA_ORDER, artifact_scope, base_name, below, changed_area, contract_kind, directory_key, entrypoint_rank, is_contract, layer_role
from tessera.functions.text import ascii_lower
from tessera.operators.lines import explode_lines

# Kinds of anchors with their priority and the paths that qualify, in order of preference.
ANCHORS = (
    ("canon", 100, r"(^|/)(readme|architecture|philosophy)[^/]*\.md$"), ("howto", 95, r"(^|/)(quick_?start|contributing|usage|install)[^/]*|makefile|justfile"),
    ("contract", 80, r"\.(proto|avsc|graphql)$|openapi|asyncapi|(^|/)contracts?/"), ("ci", 78, r"(^|/)\.github/|\.gitlab-ci"),
    ("experiment", 70, r"(^|/)(experiments?|notebooks?)/|\.ipynb$"), ("artifact", 68, r"(^|/)(artifacts|results|models)/"),
    ("infra", 60, r"(^|/)(infra|deploy|k8s)/|dockerfile|\.ya?ml$"), ("entrypoint", 55, r"(^|/)(main|lib|app|index)\.[a-z]+$|\.py$"),
)
MAX_ANCHORS = 7
# Names of files that stand for the build, for an environment and for continuous integration.
CONFIG_NAMES = (
    "cargo.toml", "package.json", "pyproject.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "makefile", "justfile",
    ".github/workflows/ci.yml", ".github/workflows/ci.yaml",
)
ENV_NAMES = (".env.example", ".env.sample", ".env.template", ".env.dist")
# Directories of deployments, and names of files that belong to one wherever they are.
DEPLOY_DIRS = ("k8s", "kubernetes", "manifests", "deploy", "kustomize")
GITOPS_DIRS = ("argocd", "argo", "flux", "gitops", "clusters")
TERRAFORM_DIRS = ("terraform", "infra")
INFRA_STEMS = ("values", "helmfile", "helmrelease", "kustomization", "skaffold", "werf", "devspace")
TERRAFORM_NAMES = ("main.tf", "variables.tf", "versions.tf", "provider.tf", "providers.tf", "backend.tf", "outputs.tf", "terraform.tf", "terragrunt.hcl")
# Patterns of infrastructure files in lower case, the most telling first, with the confidence in them.
INFRA = (
    (r"(^|/)chart\.yaml$", 0.9), (r"(^|/)values\.ya?ml$", 0.85), (r"(^|/)helmfile\.ya?ml$", 0.82), (r"(^|/)helmrelease\.ya?ml$", 0.83),
    (r"(^|/)kustomization\.ya?ml$", 0.85), (rf"(^|/)({'|'.join(GITOPS_DIRS)})/(.*/)?application(set)?\.ya?ml$", 0.82), (r"(^|/)terragrunt\.hcl$", 0.85),
    (r"(^|/)skaffold\.ya?ml$", 0.83), (r"^tiltfile$", 0.83), (r"(^|/)werf\.ya?ml$", 0.82), (r"(^|/)devspace\.ya?ml$", 0.82), (r"ingress", 0.8),
    (r"service", 0.78), (r"deployment|statefulset", 0.78), (r"(^|/)main\.tf$", 0.85), (r"(^|/)variables\.tf$", 0.82),
    (r"(^|/)(versions|providers?|backend|outputs|terraform)\.tf$", 0.8), (r"\.(tf|tfvars|hcl)$", 0.78), (r"", 0.75),
)
MAX_INFRA = 8
# Kinds of boundaries in the order of a report.
BOUNDARY_ORDER = ("http", "cli", "event", "env", "config", "db")


def _boundary(kind: str, confidence: float | Column) -> Column:
    return F.struct(F.lit(kind).alias("boundary"), F.lit(confidence).cast("double").alias("confidence"))


def infra_rank(low: Column) -> Column:
    """Place of a path in lower case among INFRA, null if it doesn't belong to a deployment."""
    name, rank = base_name(low), F.lit(None).cast("int")
    for i, (pattern, _) in reversed(list(enumerate(INFRA))):
        rank = F.when(low.rlike(pattern), i).otherwise(rank)
    deployed = below(low, (*DEPLOY_DIRS, *GITOPS_DIRS, "charts"), (*DEPLOY_DIRS, *GITOPS_DIRS, "charts", "helm"))
    named = name.rlike(rf"^(chart\.yaml|({'|'.join(INFRA_STEMS)})\.ya?ml)$")
    yaml = low.rlike(r"\.ya?ml$") & (deployed | named)
    terraform = low.rlike(r"\.(tf|tfvars|hcl)$") & (below(low, TERRAFORM_DIRS, TERRAFORM_DIRS) | name.isin(*TERRAFORM_NAMES))
    return F.when(yaml | terraform | (low == "tiltfile"), rank)


def classify_files(files: DataFrame) -> DataFrame:
    """file_path, entry_rank, contract, contract_kind, boundary, confidence: a row for each of the files, which are distinct.

    Files of results and data are no entry points or contracts, and an entry point is no contract. The boundary
    is that of the first of these that holds: files of the build, entry points, the MAX_INFRA most telling
    infrastructure files of all, databases, events. A null path has nulls only.
    """
    path = F.col("file_path")
    low = ascii_lower(path)
    rank = F.when(~artifact_scope(low), entrypoint_rank(path))
    contract = F.coalesce(is_contract(path) & ~artifact_scope(low) & rank.isNull(), F.lit(False))
    known = files.select("file_path", rank.alias("entry_rank"), contract.alias("contract"), infra_rank(low).alias("_infra"))
    # MAX_INFRA rows, whatever the number of files
    told = known.where("_infra IS NOT NULL").orderBy("_infra", "file_path").limit(MAX_INFRA).select("file_path", F.lit(True).alias("_told"))
    confidence = F.element_at(F.array(*(F.lit(c) for _, c in INFRA)), F.col("_infra") + 1)
    event = below(low, ["events", "messages"], ["events", "messages"]) | low.rlike(r"^asyncapi\.(json|yaml|yml)$|/asyncapi\.|\.avsc$")
    boundary = (
        F.when(low.isin(*CONFIG_NAMES), _boundary("config", 1.0)).when(low.isin(*ENV_NAMES), _boundary("env", 1.0))
        .when(F.col("entry_rank").isNotNull() & low.rlike(r"/server\.|/api/|/http/"), _boundary("http", 0.7))
        .when(F.col("entry_rank").isNotNull() & low.rlike("/(cli|cmd|bin)/"), _boundary("cli", 0.7))
        .when(F.col("entry_rank").isNotNull(), _boundary("cli", 0.55))
        .when(F.col("_told"), _boundary("config", confidence))
        .when(below(low, ["migrations", "prisma"], ["migrations"]) | low.rlike(r"schema\.(sql|prisma)$"), _boundary("db", 0.85))
        .when(event, _boundary("event", F.when(F.contains(low, F.lit("asyncapi")), 1.0).when(F.endswith(low, F.lit(".avsc")), 0.9).otherwise(0.75)))
    )
    met = known.join(F.broadcast(told), "file_path", "left").withColumn("_b", boundary)
    return met.select("file_path", "entry_rank", "contract", F.when(F.col("contract"), contract_kind(path)).alias("contract_kind"), "_b.boundary", "_b.confidence")


def ordered_boundaries(classified: DataFrame) -> DataFrame:
    """The rows of classify_files() that are boundaries, by kind, then path."""
    place = F.array_position(F.array(*map(F.lit, BOUNDARY_ORDER)), F.col("boundary"))
    return classified.where("boundary IS NOT NULL").orderBy(place, "file_path")


def select_anchors(files: DataFrame, k: int = MAX_ANCHORS) -> DataFrame:
    """kind, file_path, priority: one file for each kind of anchor, the shallowest and first, k kinds by priority; a file serves one kind."""
    low = F.lower("file_path")
    kinds = F.filter(F.array(*(F.when(low.rlike(p), F.struct(F.lit(v).alias("priority"), F.lit(n).alias("kind"))) for n, v, p in ANCHORS)), lambda x: x.isNotNull())
    first = files.select("file_path", F.get(kinds, 0).alias("a")).where("a IS NOT NULL")
    order = F.struct(F.size(F.split("file_path", "/")).alias("depth"), F.col("file_path"))
    best = first.groupBy("a.kind", "a.priority").agg(F.min_by("file_path", order).alias("file_path"))
    return best.orderBy(F.desc("priority")).limit(k).select("kind", "file_path", "priority")


def directory_rows(files: DataFrame, depth: int = 1) -> DataFrame:
    """directory, files, role, weight: rows of a map, by files and anchors within."""
    return files.groupBy(directory_key(F.col("file_path"), depth).alias("directory")).agg(F.count(F.lit(1)).alias("files")).withColumn("role", layer_role(F.col("directory")))


def meaning_pack(files: DataFrame, max_chars: int) -> DataFrame:
    """section, ord, line: the lines of a pack in order, as many as the budget of characters allows; anchors go before the map."""
    anchors = select_anchors(files).select(F.lit(0).alias("s"), F.lit("ANCHORS").alias("section"), (-F.col("priority")).alias("o"), F.concat_ws(" ", F.lit("A"), "kind", "file_path").alias("line"))
    rows = directory_rows(files).select(F.lit(1).alias("s"), F.lit("MAP").alias("section"), (-F.col("files")).alias("o"), F.concat_ws(" ", F.lit("M"), "directory", "role", "files").alias("line"))
    whole = W.partitionBy(F.lit(1)).orderBy("s", "o", "line")  # a row for each anchor and directory
    used = F.sum(F.length("line") + 1).over(whole.rowsBetween(W.unboundedPreceding, 0))
    kept = anchors.unionByName(rows).withColumn("_used", used).withColumn("ord", F.row_number().over(whole))
    return kept.where(F.col("_used") <= max_chars).select("section", F.col("ord").cast("bigint").alias("ord"), "line")


def worktree_pack(worktrees: DataFrame, terms: list[str], offset: int, limit: int) -> DataFrame:
    """Working copies (path, branch, dirty, last_commit) by words of the query, dirty ones first, then the latest; a page of them."""
    hay = F.lower(F.concat_ws(" ", "path", "branch"))
    score = sum((F.contains(hay, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    return worktrees.withColumn("score", score).orderBy(F.desc("score"), F.desc("dirty"), F.desc("last_commit"), "path").offset(offset).limit(limit)


def notebook_staleness(pointers: DataFrame, files: DataFrame) -> DataFrame:
    """anchor_id, total, stale: pointers (anchor_id, file_path, sha256) whose file has changed; one without a hash never is."""
    now = files.select("file_path", F.sha2("content", 256).alias("_now"))
    met = pointers.join(now, "file_path", "left")
    return met.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("sha256").isNotNull() & ~F.col("sha256").eqNullSafe(F.col("_now"))).alias("stale"))


def touched_areas(changes: DataFrame, k: int = 5) -> DataFrame:
    """worktree, areas: distinct areas of changed paths (worktree, path), in the order of the areas, k at most."""
    order = F.create_map(*(F.lit(x) for i, name in enumerate(AREA_ORDER) for x in (name, i)))
    area = changed_area(F.col("path"))
    found = changes.withColumn("area", area).where("area IS NOT NULL").select("worktree", F.struct(order[F.col("area")].alias("o"), "area").alias("a"))
    return found.groupBy("worktree").agg(F.transform(F.slice(F.array_sort(F.collect_set("a")), 1, k), lambda a: a["area"]).alias("areas"))


# Protocols of message brokers with the words that name them.
BROKERS = (("kafka", r"kafka"), ("amqp", r"rabbitmq|amqp"), ("nats", r"\bnats\b"), ("redis", r"\bredis\b"), ("mqtt", r"\bmqtt\b"))


def brokers(files: DataFrame, limit: int = 4) -> DataFrame:
    """file_path, protocol, confidence: configuration files that name a broker, the surest first."""
    config = files.where(F.lower("file_path").rlike(r"compose|\.(ya?ml|toml|env|tf|properties)$"))
    protocol = F.lit(None).cast("string")
    for name, pattern in reversed(BROKERS):
        protocol = F.when(F.lower("content").rlike(pattern), name).otherwise(protocol)
    sure = F.when(F.contains(F.lower("file_path"), F.lit("compose")), 0.9).when(F.lower("content").rlike(r"(broker|bootstrap)[^\n]*://"), 0.85).otherwise(0.75)
    found = config.select("file_path", protocol.alias("protocol"), sure.alias("confidence")).where("protocol IS NOT NULL")
    return found.orderBy(F.desc("confidence"), "file_path").limit(limit)


def meaning_focus(files: DataFrame, prefix: str, max_chars: int) -> DataFrame:
    """meaning_pack() of what is below a directory, or of one file."""
    below = (F.col("file_path") == prefix) | F.startswith("file_path", F.lit(prefix.rstrip("/") + "/"))
    return meaning_pack(files.where(below), max_chars)


def evidence_window(files: DataFrame, lines: int = 40) -> DataFrame:
    """file_path, first, last: lines from the first heading or command on."""
    first = explode_lines(files.select("file_path", "content")).where(F.col("line").rlike(r"^(#{1,3} |\$ |```|def |fn |class )"))
    return first.groupBy("file_path").agg(F.min("n").alias("first")).withColumn("last", F.col("first") + lines - 1)
