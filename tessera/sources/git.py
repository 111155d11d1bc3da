"""Working copies under version control as a data source: a partition asks about one working copy.

Repositories must be reachable by the same path from the driver, which lists their working copies, and from the executors, which read
their states. A repository or copy that cannot be asked, or does not answer in time, has no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import WATERMARK

FORMAT = "working_copies"
COPIES = "root string, path string, branch string, head string, detached boolean, dirty boolean, dirty_hash string, dirty_paths array<string>, last_commit timestamp, base string, ahead long, behind long"
CHANGED = "root string, path string"
#: Paths whose sizes and times go into a hash, and seconds that a question may take.
MAX_DIRTY, TIMEOUT_S = 512, 30
MAX_CHANGED = 10_000
# References that a copy is compared with, in order of preference.
BASES = ("refs/remotes/origin/HEAD", "refs/remotes/origin/main", "refs/remotes/origin/master", "refs/heads/main", "refs/heads/master")


def _source(schemas: dict, max_dirty: int, bases: tuple[str, ...]) -> type:
    """The class of the data source; it is made here so that workers get it by value and need nothing of this package."""
    import hashlib
    import json
    import os
    import subprocess
    from datetime import datetime, timezone

    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Asked(InputPartition):
        def __init__(self, root: str, copy: dict) -> None:
            self.root, self.copy = root, copy

    class Copies(DataSourceReader):
        def __init__(self, options) -> None:
            self.roots, self.timeout = json.loads(options["roots"]), float(options["timeout"])
            self.kind, self.base = options["rows"], options.get("base")
            self.heads, self.limit = (options.get("old"), options.get("new")), int(options.get("limit", 0))

        def ask(self, path: str, *question: str) -> bytes | None:
            try:
                done = subprocess.run(["git", "-C", path, *question], capture_output=True, timeout=self.timeout, check=False)
            except (OSError, subprocess.TimeoutExpired):
                return None
            return done.stdout if done.returncode == 0 else None

        def copies(self, root: str) -> list[dict]:
            found: list[dict] = []
            for line in (self.ask(root, "worktree", "list", "--porcelain") or b"").decode("utf-8", "replace").splitlines():
                name, _, value = line.partition(" ")
                if name == "worktree":
                    found.append({"path": value})
                elif found and name in ("HEAD", "branch", "detached"):
                    found[-1][name] = value
            return found

        def partitions(self) -> list[InputPartition]:
            if self.kind == "changed":
                return [Asked(root, {"path": root}) for root in self.roots]
            return [Asked(root, copy) for root in self.roots for copy in self.copies(root)]

        def read(self, partition):
            if partition is None:  # where there are no partitions, Spark asks for one of its own
                return
            found = self.changed(partition.root) if self.kind == "changed" else self.state(partition.root, partition.copy)
            yield from found

        def changed(self, root: str):
            said = self.ask(root, "diff", "--name-status", "-z", *self.heads)
            words = [w.decode("utf-8", "replace") for w in (said or b"").split(b"\0") if w]
            paths, i = set(), 0
            while i + 1 < len(words):
                n = 2 if words[i][0] in "RC" else 1  # a rename or copy has its old and its new path
                paths.update(words[i + 1 : i + 1 + n])
                i += 1 + n
            if len(paths) > self.limit:
                yield (root, None)
            else:
                yield from ((root, p) for p in sorted(paths))

        def state(self, root: str, copy: dict):
            path = copy["path"]
            status = self.ask(path, "status", "--porcelain", "-z")
            if status is None:
                return
            dirty, i, words = [], 0, [w for w in status.split(b"\0") if w]
            while i < len(words) and len(dirty) < max_dirty:
                if len(words[i]) > 3 and words[i][2:3] == b" ":
                    dirty.append(words[i][3:])
                    if words[i][:1] in b"RC" and i + 1 < len(words):
                        i += 1
                        dirty.append(words[i])
                i += 1
            digest = hashlib.sha256(status)
            for name in dirty:
                # the status of a file that is changed once more stays the same, its size or time does not
                try:
                    stat = os.stat(os.path.join(os.fsencode(path), name))
                    size, time = stat.st_size, stat.st_mtime_ns // 1_000_000
                except OSError:
                    size, time = 0, 0
                digest.update(name + size.to_bytes(8, "big") + max(time, 0).to_bytes(8, "big"))
            base = self.base or next((b for b in bases if self.ask(path, "rev-parse", "--verify", "--quiet", b) is not None), None)
            counts = (self.ask(path, "rev-list", "--left-right", "--count", f"{base}...HEAD") or b"").split() if base else []
            seconds = (self.ask(path, "log", "-1", "--format=%ct") or b"").strip()
            last = datetime.fromtimestamp(int(seconds), timezone.utc) if seconds else None
            branch = copy.get("branch")
            shown = [d.decode("utf-8", "replace") for d in dirty]
            yield (
                root, path, branch.removeprefix("refs/heads/") if branch else None, copy.get("HEAD"), "detached" in copy, bool(status),
                digest.hexdigest()[:16] if status else None, [p for p in shown if p.split("/")[0] != ".worktrees"], last, base,
                int(counts[1]) if len(counts) == 2 else None, int(counts[0]) if len(counts) == 2 else None,
            )

    class WorkingCopies(DataSource):
        @classmethod
        def name(cls) -> str:
            return "working_copies"

        def schema(self) -> str:
            return schemas[self.options["rows"]]

        def reader(self, schema) -> DataSourceReader:
            return Copies(self.options)

    return WorkingCopies


def _load(spark: SparkSession, rows: str, roots: list[str], **options) -> DataFrame:
    spark.dataSource.register(_source({"copies": COPIES, "changed": CHANGED}, MAX_DIRTY, BASES))
    given = {k: str(v) for k, v in options.items() if v is not None}
    return spark.read.format(FORMAT).options(rows=rows, roots=json.dumps(list(roots)), timeout=str(TIMEOUT_S), **given).load()


def working_copies(spark: SparkSession, roots: list[str], base: str | None = None) -> DataFrame:
    """COPIES: a row for each working copy of the repositories at `roots`, which are asked in parallel.

    dirty_hash (null if clean) covers the status and the sizes and times of MAX_DIRTY changed paths at most; dirty_paths are these, without
    those of working copies within. ahead and behind count commits against base, or the first of BASES that there is (else null).
    """
    return _load(spark, "copies", roots, base=base)


def changed_paths(spark: SparkSession, roots: list[str], old: str, new: str, limit: int = MAX_CHANGED) -> DataFrame:
    """root, path: paths that differ between two commits, both of a rename; one null path stands for more than `limit`: scan it all."""
    for head in (old, new):
        if not head.strip() or head.startswith("-"):
            raise ValueError(f"{head!r} names no commit")
    return _load(spark, "changed", roots, old=old.strip(), new=new.strip(), limit=limit)


def git_watermark(spark: SparkSession, root: str) -> DataFrame:
    """WATERMARK of one working copy: its head, whether it is dirty, and a hash of what is; no row if it cannot be asked."""
    row = working_copies(spark, [root]).where(F.col("head").isNotNull() & (F.col("path") == root.rstrip("/")))
    out = row.select(F.lit("git").alias("kind"), F.col("head").alias("git_head"), F.col("dirty").alias("git_dirty"), "dirty_hash")
    out = out.withColumns({name: F.lit(None).cast("long") for name in ("file_count", "max_mtime_ms", "total_bytes")})
    return out.select(*(c.split()[0] for c in WATERMARK.split(", ")))


def copy_areas(copies: DataFrame, k: int = 5) -> DataFrame:
    """path, areas: where dirty paths of working copies are, as touched_areas()."""
    from tessera.operators.orient import touched_areas

    return touched_areas(copies.select(F.col("path").alias("worktree"), F.explode("dirty_paths").alias("path")), k).withColumnRenamed("worktree", "path")
