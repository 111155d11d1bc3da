"""A log of snapshots of tables: numbered manifests, committed by whoever is first, and the index cycle over it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.sinks import changed_files, filesystem_watermark, purge_missing

#: Version of what manifests say of their tables.
FORMAT = 1


class CommitConflictError(RuntimeError):
    """Another commit has taken the number."""


@dataclass(frozen=True)
class Snapshot:
    """sequence rises by one; batch names what was committed; tables are folders by name."""

    sequence: int
    batch: str
    format: int
    tables: dict[str, str]


class SnapshotLog:
    """Snapshots below `root`, of which readers see the last manifest's whole or, before the first, none.

    Data are written to folders of their own first. A manifest's file is made only where there is none of its number, which the
    file system decides (compare and set), so of two writers that go on from one snapshot the second fails and leaves
    files that no manifest names (see expire()). A batch that a manifest names already is not committed again.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, sequence: int) -> str:
        return f"{self.root}/manifests/{sequence:012d}.json"

    def sequences(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.root}/manifests/*.json")) or ()
        return sorted(int(s.getPath().getName()[:-5]) for s in found if s.getLen())  # one without text is being written, or its writer was lost

    def snapshot(self, sequence: int | None = None) -> Snapshot | None:
        """The snapshot of that number, or the last one."""
        if sequence is None:
            known = self.sequences()
            if not known:
                return None
            sequence = known[-1]
        stream = self._fs.open(self._path(self._manifest(sequence)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(sequence, **json.loads(text))

    def committed(self, batch: str) -> Snapshot | None:
        """The snapshot that a batch has made. Batches are few since the last expiry, and the last ones are looked at first."""
        return next((s for n in reversed(self.sequences()) if (s := self.snapshot(n)).batch == batch), None)

    def read(self, name: str, sequence: int | None = None) -> DataFrame | None:
        """A table of a snapshot, None where it has none of that name."""
        now = self.snapshot(sequence)
        return self.spark.read.parquet(now.tables[name]) if now and name in now.tables else None

    def stage(self, name: str, df: DataFrame) -> tuple[str, DataFrame]:
        """Writes a table in a folder of its own below the data, for a later commit; gives its path and what is read back."""
        path = f"{self.root}/data/work-{uuid.uuid4().hex}/{name}"
        df.write.parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def commit(self, tables: dict[str, DataFrame], batch: str, after: int | None = None, staged: dict[str, str] | None = None) -> Snapshot:
        """Writes the tables and makes them, with those that stage() has written (paths by name), the next snapshot after `after` (the last one), which keeps that one's other tables."""
        if done := self.committed(batch):
            return done
        before = self.snapshot(after)
        sequence = before.sequence + 1 if before else 1
        folder = f"{self.root}/data/{sequence:012d}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        return self._put(Snapshot(sequence, batch, FORMAT, (before.tables if before else {}) | {name: f"{folder}/{name}" for name in tables} | (staged or {})))

    def _put(self, new: Snapshot) -> Snapshot:
        text = json.dumps({"batch": new.batch, "format": new.format, "tables": new.tables}, sort_keys=True)
        try:
            stream = self._fs.create(self._path(self._manifest(new.sequence)), False)
        except Exception as e:  # py4j gives any refusal of the file system as one error
            if "exists" in str(e).lower():
                raise CommitConflictError(f"snapshot {new.sequence} exists") from e
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return new

    def roll_back(self, sequence: int, batch: str) -> Snapshot:
        """Makes an earlier snapshot's tables the next one's; nothing is copied."""
        old, last = self.snapshot(sequence), self.snapshot()
        return self.committed(batch) or self._put(Snapshot(last.sequence + 1, batch, old.format, old.tables))

    def migrate(self, steps: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]], to: int = FORMAT) -> Snapshot | None:
        """Brings the last snapshot to format `to`, step by step, each from its format to the next; a missing step is an error."""
        now = self.snapshot()
        if not now or now.format >= to:
            return now
        tables = {name: self.spark.read.parquet(path) for name, path in now.tables.items()}
        for version in range(now.format, to):
            tables = steps[version](tables)
        folder = f"{self.root}/data/{now.sequence + 1:012d}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        return self._put(Snapshot(now.sequence + 1, f"migrate-{now.format}-{to}", to, {name: f"{folder}/{name}" for name in tables}))

    def expire(self, keep: int = 2) -> list[int]:
        """Deletes all but the last `keep` manifests, those without text, and data that the kept ones don't name. No commit may be under way."""
        known = self.sequences()
        gone, kept = known[:-keep], known[-keep:]
        used = {path.rsplit("/", 1)[0].rsplit("/", 1)[-1] for n in kept for path in self.snapshot(n).tables.values()}
        for n in gone:
            self._fs.delete(self._path(self._manifest(n)), False)
        for status in self._fs.globStatus(self._path(f"{self.root}/manifests/*.json")) or ():
            if not status.getLen():
                self._fs.delete(status.getPath(), False)
        for status in self._fs.globStatus(self._path(f"{self.root}/data/*")) or ():
            if status.getPath().getName() not in used:
                self._fs.delete(status.getPath(), True)
        return gone


def index_cycle(log: SnapshotLog, live: DataFrame, batch: str, chunk: Callable[[DataFrame], DataFrame], embed: Callable[[Column], Column], full: bool = False) -> Snapshot:
    """One incremental cycle over all live files (file_path, mtime_ms, bytes, content), committed as one snapshot of files, chunks, vectors and watermark.

    * Files that are new or younger than their stored state are chunked again (all of them if `full`), those that are gone are purged. chunk gives
      file_path, start_line, end_line, content and more.
    * Vectors (file_path, start_line, end_line, doc_hash, vector) stay where a chunk of that place and text does; all other chunks get one, also
      those that an earlier cycle has left without (drift).
    * A batch that has been committed is not done again, so a repeated micro-batch changes nothing; a second writer's commit is refused.
      Empty tables are fine; contents are read of changed files only.
    """
    if done := log.committed(batch):
        return done
    before = log.snapshot()
    stored = {name: log.read(name, before.sequence) for name in ("files", "chunks", "vectors")} if before else {}
    state = live.select("file_path", "mtime_ms", "bytes")
    changed = live if full or not stored else live.join(changed_files(state, stored["files"]).select("file_path"), "file_path", "left_semi")
    place = ["file_path", "start_line", "end_line"]
    fresh = chunk(changed.select("file_path", "content"))
    # files that have become empty have no chunks, but replace what is stored
    chunks = fresh if not stored or full else purge_missing(stored["chunks"], state).join(changed.select("file_path"), "file_path", "left_anti").unionByName(fresh)
    path, chunks = log.stage("chunks", chunks)
    hashed = chunks.withColumn("doc_hash", F.sha2("content", 256))
    key = [*place, "doc_hash"]
    if stored:
        known = hashed.select(key).distinct().join(stored["vectors"], key)
        missing = hashed.join(stored["vectors"].select(key), key, "left_anti")
        vectors = known.select(*key, "vector").unionByName(missing.select(*key, embed(F.col("content")).alias("vector")))
    else:
        vectors = hashed.select(*key, embed(F.col("content")).alias("vector"))
    return log.commit({"files": state, "vectors": vectors, "watermark": filesystem_watermark(state)}, batch, before.sequence if before else None, {"chunks": path})


def index_on_batches(log: SnapshotLog, name: str, scan: Callable[[], DataFrame], chunk: Callable[[DataFrame], DataFrame], embed: Callable[[Column], Column]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a cycle over what `scan` gives for each micro-batch with a row; one with a true `full_scan` chunks everything anew."""

    def cycle(batch: DataFrame, number: int) -> None:
        full = batch.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("full_scan"), F.lit(False)).alias("full")).first() if "full_scan" in batch.columns else None
        if full is None and batch.limit(1).count() or full is not None and full.n:
            index_cycle(log, scan(), f"{name}-{number}", chunk, embed, bool(full and full.full))

    return cycle


__all__ = ["FORMAT", "CommitConflictError", "Snapshot", "SnapshotLog", "index_cycle", "index_on_batches"]
