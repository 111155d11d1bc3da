"""Incremental tables: upserts, deletions, change detection, watermarks, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_files(stored: DataFrame, fresh: DataFrame, key: str = "file_path") -> DataFrame:
    """All rows of the files in `fresh` replace those that `stored` has of them."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def purge_missing(stored: DataFrame, live: DataFrame, key: str = "file_path") -> DataFrame:
    """Rows of files that are still there."""
    return stored.join(live.select(key).distinct(), key, "left_semi")


def changed_files(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Files (file_path, mtime_ms) that are new or younger than their stored state."""
    old = stored.select("file_path", F.col("mtime_ms").alias("_old"))
    return live.join(old, "file_path", "left").where(F.coalesce(F.col("mtime_ms") > F.col("_old"), F.lit(True))).drop("_old")


def missing_vectors(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Chunks that have no vector yet."""
    return chunks.join(vectors.select(key).distinct(), key, "left_anti")


def filesystem_watermark(files: DataFrame) -> DataFrame:
    """One row: number of files, latest change, total size."""
    return files.agg(F.count(F.lit(1)).alias("file_count"), F.max("mtime_ms").alias("max_mtime_ms"), F.sum("bytes").alias("total_bytes"))


def staleness(current: Column, index: Column, exists: Column, corrupt: Column) -> Column:
    """Reasons why an index is stale, in order; watermarks are structs of kind, git_head, git_dirty, dirty_hash, file_count, max_mtime_ms, total_bytes.

    Watermarks of different kinds count as changed files.
    """
    both_git = (current["kind"] == "git") & (index["kind"] == "git")
    same_files = current["file_count"].eqNullSafe(index["file_count"]) & current["max_mtime_ms"].eqNullSafe(index["max_mtime_ms"]) & current["total_bytes"].eqNullSafe(index["total_bytes"])
    known = exists & ~corrupt
    moved = ~current["git_dirty"].eqNullSafe(index["git_dirty"]) | (current["git_dirty"] & ~current["dirty_hash"].eqNullSafe(index["dirty_hash"]))
    files = known & index.isNotNull() & ((current["kind"] != index["kind"]) | ((current["kind"] == "filesystem") & ~same_files))
    return F.array_compact(F.array(
        F.when(~exists, "index_missing"), F.when(exists & corrupt, "index_corrupt"), F.when(known & index.isNull(), "watermark_missing"),
        F.when(known & both_git & ~current["git_head"].eqNullSafe(index["git_head"]), "git_head_mismatch"),
        F.when(known & both_git & moved, "git_dirty_mismatch"), F.when(files, "filesystem_changed"),
    ))


def replace_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Writes a table as a whole, or only the partitions that df has; Spark's committer shows readers all or nothing of a job."""
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def delete_anchors(anchors: DataFrame, gone: DataFrame, runbooks: DataFrame) -> DataFrame:
    """Anchors without those in `gone` (anchor_id); one that a runbook (anchor_ids) refers to can't go and is an error."""
    used = runbooks.select(F.explode("anchor_ids").alias("anchor_id")).distinct().withColumn("_used", F.lit(True))
    marked = anchors.join(gone.select("anchor_id").distinct().withColumn("_gone", F.lit(True)), "anchor_id", "left").join(used, "anchor_id", "left")
    bad = F.when(F.col("_gone") & F.col("_used"), F.raise_error(F.concat(F.lit("a runbook refers to anchor "), F.col("anchor_id")))).otherwise(F.col("_gone").isNull())
    return marked.where(bad).select(*anchors.columns)


def must_reembed(stored: DataFrame, mode: str, model_id: str, template_hash: str, dimension: int) -> DataFrame:
    """Vectors that were made in another mode, by another model or template, or of another length."""
    same = (F.col("mode") == mode) & (F.col("model_id") == model_id) & (F.col("template_hash") == template_hash) & (F.size("vector") == dimension)
    return stored.where(~F.coalesce(same, F.lit(False)))


def health_snapshot(cycles: DataFrame, failures: int = 5) -> DataFrame:
    """One row from the log of cycles (cycle, ts, ok, duration_ms, reason): last success and failure, p95 of the last 20 durations, last failures."""
    last = cycles.orderBy(F.desc("cycle")).limit(20)
    p95 = last.where("ok").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)").alias("p95_ms"))
    bad = cycles.where("NOT ok").orderBy(F.desc("cycle")).limit(failures).agg(F.transform(F.sort_array(F.collect_list(F.struct("cycle", "reason")), asc=False), lambda x: x["reason"]).alias("failures"))
    seen = cycles.agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_success"), F.max(F.when(~F.col("ok"), F.col("ts"))).alias("last_failure"))
    return seen.join(p95).join(bad)  # three tables of one row


def stage_and_commit(tables: dict[str, DataFrame], root: str, version: str) -> str:
    """Writes all tables to a version of their own, and then the pointer to it: readers see all tables of a version or none.

    An earlier version stays for rollback: write the pointer to it again with point_to().
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/versions/{version}/{name}")
    point_to(spark, root, version)
    return version


def point_to(spark, root: str, version: str) -> None:
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{root}/pointer")


def read_version(spark, root: str, name: str) -> DataFrame:
    """A table in the version that was pointed to last."""
    pointer = spark.read.schema("version string").parquet(f"{root}/pointer").select("version", F.col("_metadata.file_modification_time").alias("at"))
    version = pointer.orderBy(F.desc("at")).first().version
    return spark.read.parquet(f"{root}/versions/{version}/{name}")
