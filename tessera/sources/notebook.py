"""Notebooks of anchors and runbooks as tables: validated edits, suggestions with preview, application and roll-back.

A notebook is a pair of tables in a snapshot log. What an edit replaces stays in the snapshot before it, so a
roll-back is a commit of that one's tables; an edit names the snapshot that it was made for, and fails if another one came between.
Entries that a suggestion has written carry a fingerprint of their content, by which later ones tell whether somebody has changed them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.sinks import upsert_files
from tessera.sources.snapshots import Snapshot, SnapshotLog

ANCHORS = "id string, kind string, label string, evidence array<struct<file_path:string,start_line:int,end_line:int,sha256:string>>, fingerprint string"
RUNBOOKS = "id string, title string, anchor_ids array<string>, fingerprint string"
NOT_MANAGED, CHANGED = "not_managed", "manual_modified"


def content_fingerprint(df: DataFrame) -> Column:
    """Digest of all columns but the fingerprint; hashes of evidence don't count, as they follow the files."""
    columns = [F.transform("evidence", lambda e: F.struct(e["file_path"], e["start_line"], e["end_line"])).alias(c) if c == "evidence" else F.col(c) for c in sorted(df.columns) if c != "fingerprint"]
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def _checked(df: DataFrame, wrong: Column, what: str) -> DataFrame:
    """df, of which a row that is wrong is an error."""
    ok = F.when(wrong, F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce("id", F.lit("null"))))).otherwise(F.lit(True))
    return df.where(ok)


def _valid_ids(df: DataFrame, what: str) -> DataFrame:
    twice = df.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    counted = df.join(twice, F.col("id").eqNullSafe(F.col("_id")), "left").select(*df.columns, "_n")
    return _checked(counted, F.coalesce(F.trim("id") == "", F.lit(True)) | (F.col("_n") > 1), f"{what} with a blank or repeated id").select(*df.columns)


def valid_anchors(anchors: DataFrame) -> DataFrame:
    """The anchors; a blank or repeated id, no evidence, or lines that are none are errors."""
    lines = F.exists("evidence", lambda e: F.coalesce((F.trim(e["file_path"]) == "") | (e["start_line"] < 1) | (e["end_line"] < e["start_line"]), F.lit(True)))
    return _checked(_valid_ids(anchors, "anchors"), F.coalesce(F.size("evidence") < 1, F.lit(True)) | F.coalesce(lines, F.lit(True)), "anchor without sound evidence")


def valid_runbooks(runbooks: DataFrame, anchors: DataFrame) -> DataFrame:
    """The runbooks; a blank or repeated id, or an anchor that there is not, are errors."""
    each = runbooks.select("id", F.explode("anchor_ids").alias("anchor"))
    known = anchors.select(F.col("id").alias("anchor"), F.lit(True).alias("_known"))
    missing = each.join(known, "anchor", "left").where("_known IS NULL").select("id").distinct().withColumn("_missing", F.lit(True))
    return _checked(_valid_ids(runbooks, "runbooks").join(missing, "id", "left"), F.col("_missing").isNotNull(), "runbook of an unknown anchor").select(*runbooks.columns)


def suggested_changes(stored: DataFrame, incoming: DataFrame, force: bool = False, adopt: bool = False) -> DataFrame:
    """incoming with `action` (create, update or skip) and `reason` of a skip.

    Unless forced, an entry is left alone that no suggestion has written (not_managed) or that has been changed since (manual_modified). With
    `adopt`, as for runbooks, one that no suggestion has written is taken over if it is the same as the suggested one.
    """
    old = stored.select("id", content_fingerprint(stored).alias("_now"), F.col("fingerprint").alias("_written"), F.lit(True).alias("_stored"))
    both = incoming.withColumn("_new", content_fingerprint(incoming)).join(old, "id", "left")
    own = F.col("_written").isNull()
    kept = F.lit(force) | (~own & (F.col("_written") == F.col("_now"))) | (F.lit(adopt) & own & (F.col("_now") == F.col("_new")))
    action = F.when(F.col("_stored").isNull(), "create").when(kept, "update").otherwise("skip")
    reason = F.when(action == "skip", F.when(own, NOT_MANAGED).otherwise(CHANGED))
    return both.select(*incoming.columns, action.alias("action"), reason.alias("reason"))


def _tables(log: SnapshotLog, sequence: int | None) -> tuple[DataFrame, DataFrame]:
    empty = lambda schema: log.spark.createDataFrame([], schema)
    read = lambda name, schema: (log.read(name, sequence) if sequence else None) or empty(schema)
    return read("anchors", ANCHORS), read("runbooks", RUNBOOKS)


def preview(log: SnapshotLog, anchors: DataFrame, runbooks: DataFrame, force: bool = False) -> DataFrame:
    """kind, id, action, reason: what apply_suggestion() would do; nothing is written."""
    last = log.snapshot()
    old_anchors, old_runbooks = _tables(log, last and last.sequence)
    listed = lambda kind, df: df.select(F.lit(kind).alias("kind"), "id", "action", "reason")
    return listed("anchor", suggested_changes(old_anchors, valid_anchors(anchors), force)).unionByName(listed("runbook", suggested_changes(old_runbooks, valid_runbooks(runbooks, old_anchors.unionByName(anchors)), force, adopt=True)))


def _written(old: DataFrame, changes: DataFrame) -> DataFrame:
    taken = changes.where("action <> 'skip'").select(*old.columns)
    return upsert_files(old, taken.withColumn("fingerprint", content_fingerprint(taken)).select(*old.columns), "id")


def apply_suggestion(log: SnapshotLog, anchors: DataFrame, runbooks: DataFrame, batch: str, after: int | None = None, force: bool = False, truncated: bool = False) -> Snapshot:
    """Writes a suggestion (ANCHORS, RUNBOOKS) as the snapshot after `after` (the last one). A truncated one is refused; a repeated batch changes nothing."""
    if truncated:
        raise ValueError("a truncated suggestion is not applied")
    last = log.snapshot(after)
    old_anchors, old_runbooks = _tables(log, last and last.sequence)
    new_anchors = _written(old_anchors, suggested_changes(old_anchors, valid_anchors(anchors), force))
    new_runbooks = _written(old_runbooks, suggested_changes(old_runbooks, valid_runbooks(runbooks, new_anchors), force, adopt=True))
    return log.commit({"anchors": new_anchors, "runbooks": new_runbooks}, batch, after)


def edit(log: SnapshotLog, batch: str, anchors: DataFrame | None = None, runbooks: DataFrame | None = None, gone_anchors: DataFrame | None = None, gone_runbooks: DataFrame | None = None, after: int | None = None) -> Snapshot:
    """Writes entries and deletes others (id). Deleting what there is not, or an anchor that a runbook still refers to, is an error."""
    last = log.snapshot(after)
    old_anchors, old_runbooks = _tables(log, last and last.sequence)
    tables = []
    for old, fresh, gone in ((old_anchors, anchors, gone_anchors), (old_runbooks, runbooks, gone_runbooks)):
        new = upsert_files(old, fresh.select(*old.columns), "id") if fresh is not None else old
        if gone is not None:
            ids = gone.select("id").distinct()
            known = old.select("id").withColumn("_known", F.lit(True))
            sound = _checked(ids.join(known, "id", "left"), F.col("_known").isNull(), "nothing to delete")
            new = new.join(sound.select("id"), "id", "left_anti")
        tables.append(new)
    new_anchors = valid_anchors(tables[0])
    # a deleted anchor that is referred to shows as an unknown one
    return log.commit({"anchors": new_anchors, "runbooks": valid_runbooks(tables[1], tables[0])}, batch, after)


def roll_back(log: SnapshotLog, sequence: int, batch: str) -> tuple[Snapshot, DataFrame]:
    """Brings back a snapshot's notebook, and (kind, id) of what is in only one of both."""
    now, then = _tables(log, log.snapshot().sequence), _tables(log, sequence)
    touched = None
    for kind, a, b in zip(("anchor", "runbook"), now, then, strict=True):
        a, b = a.select("id"), b.select("id")
        part = a.join(b, "id", "left_anti").unionByName(b.join(a, "id", "left_anti")).select(F.lit(kind).alias("kind"), "id")
        touched = part if touched is None else touched.unionByName(part)
    return log.roll_back(sequence, batch), touched
