"""Sources: files of a directory, evaluation sets."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.paths import LANGUAGE_NAMES, LANGUAGES, base_name, extension, is_secret_file
from tessera.schemas import CASES
from tessera.sources.ignore import drop_ignored, ignore_rules, read_rule_files

MAX_BYTES = 1 << 20
# Directories and names that are never indexed, hidden ones that are.
IGNORED = ("node_modules", "target", "dist", "build", ".git", ".venv", "venv", "__pycache__", ".direnv", ".cache")
HIDDEN_ALLOWED = (".github", ".gitlab", ".cargo", ".config")
NOISE_NAMES = ("cargo.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "poetry.lock", "uv.lock")


def indexable(path: Column, size: Column) -> Column:
    """Whether a file is indexed: small enough, of a known kind, not ignored, hidden, noise or secret."""
    parts = F.split(path, "/")
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) & ~p.isin(*HIDDEN_ALLOWED))
    known = F.coalesce(extension(path).isin(*(e for x in LANGUAGES.values() for e in x), "txt", "proto", "graphql"), F.lit(False)) | base_name(path).isin(*LANGUAGE_NAMES)
    return (size <= MAX_BYTES) & known & ~hidden & ~F.exists(parts, lambda p: p.isin(*IGNORED)) & ~F.lower(base_name(path)).isin(*NOISE_NAMES) & ~is_secret_file(path)


def scan(spark: SparkSession, root: str, ignore_files: bool = True) -> DataFrame:
    """file_path (below root), mtime_ms, bytes, content of all indexable files; contents of others are never read.

    What the ignore files in the tree rule out is left out, unless ignore_files is false; the user's own global one is not read.
    Spark's file sources do not list hidden directories: name an allowed one (HIDDEN_ALLOWED) as a root of its own.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.col("path"), "^" + r"[a-z]+:/*" + root.strip("/").replace(".", r"\.") + "/", "")
    listed = found.where(F.col("length") <= MAX_BYTES).withColumn("file_path", path)
    kept = listed.where(indexable(F.col("file_path"), F.col("length")))
    if ignore_files:
        kept = drop_ignored(kept, ignore_rules(read_rule_files(kept.select("file_path"), root)))
    return kept.select("file_path", F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("content"))


def filter_paths(paths: DataFrame) -> DataFrame:
    """The same predicate over given files (file_path, bytes)."""
    return paths.where(indexable(F.col("file_path"), F.col("bytes")))


def list_directory(files: DataFrame, directory: str, last: str = "", limit: int = 100) -> DataFrame:
    """Names directly below a directory after `last`, in order."""
    prefix = f"{directory.strip('/')}/" if directory.strip("/.") else ""
    rest = F.expr(f"substring(file_path, {len(prefix) + 1})")
    names = files.where(F.startswith("file_path", F.lit(prefix))).select(F.substring_index(rest, "/", 1).alias("name")).distinct()
    return names.where(F.col("name") > last).orderBy("name").limit(limit)


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of an evaluation set in JSON; an empty set, blank ids, queries or paths are errors."""
    whole = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one document of cases, control data
    document = json.loads(whole)
    if document.get("schema_version") != 1 or not document.get("cases"):
        raise ValueError("an evaluation set needs schema_version 1 and cases")
    rows = []
    for case in document["cases"]:
        if not case["id"].strip() or not case["query"].strip() or not case["expected_paths"] or not all(p.strip() for p in case["expected_paths"]):
            raise ValueError(f"case {case.get('id')!r} has blank fields")
        rows.append((case["id"], case["query"], case["expected_paths"], case.get("expected_symbols"), case.get("intent")))
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("case ids repeat")
    return spark.createDataFrame(rows, CASES)
