"""Snapshot logs and index cycles: commits, conflicts, repeats, roll-back, migration, and a stream of batches."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.vectors import stub_embed
from tessera.operators.chunking import chunk_by_lines
from tessera.sources.snapshots import CommitConflictError, SnapshotLog, index_cycle, index_on_batches
from tessera.streaming.debounce import run_cycles

FILES = "file_path string, mtime_ms long, bytes long, content string"


def chunk(files):
    return chunk_by_lines(files, 2)


def live(spark, **files):
    return spark.createDataFrame([(p.replace("_", "."), m, len(t), t) for p, (m, t) in files.items()], FILES)


def state(log, sequence=None):
    """(file, start, content) of all chunks; each must have one vector."""
    chunks = log.read("chunks", sequence)
    key = ["file_path", "start_line", "end_line"]
    assert log.read("vectors", sequence).count() == chunks.count() == chunks.join(log.read("vectors", sequence), key).where("doc_hash = sha2(content, 256) AND size(vector) = 8").count()
    return sorted((r.file_path, r.start_line, r.content) for r in chunks.collect())


def test_cycles(spark, tmp_path):
    log = SnapshotLog(spark, f"file://{tmp_path}/log")
    assert log.snapshot() is None and log.read("files") is None
    seen = []
    embed = lambda c: stub_embed(8)(c)
    spy = lambda files: seen.append(sorted(r.file_path for r in files.collect())) or chunk(files)
    first = live(spark, a_rs=(1, "one\ntwo\nthree"), b_rs=(1, "x"), c_rs=(1, "gone"))
    assert index_cycle(log, first, "b1", spy, embed).sequence == 1
    assert state(log) == [("a.rs", 1, "one\ntwo"), ("a.rs", 3, "three"), ("b.rs", 1, "x"), ("c.rs", 1, "gone")]
    second = live(spark, a_rs=(2, "one\ntwo"), b_rs=(1, "not read"), d_rs=(5, "new"), e_rs=(1, ""))
    assert index_cycle(log, second, "b2", spy, embed).sequence == 2
    wanted = [("a.rs", 1, "one\ntwo"), ("b.rs", 1, "x"), ("d.rs", 1, "new")]
    assert state(log) == wanted and seen == [["a.rs", "b.rs", "c.rs"], ["a.rs", "d.rs", "e.rs"]]
    assert tuple(log.read("watermark").first()) == (4, 5, sum(map(len, ("one\ntwo", "not read", "new", ""))))
    # a repeated batch, also by another process
    assert index_cycle(SnapshotLog(spark, log.root), first, "b2", spy, embed).sequence == 2 and len(seen) == 2
    assert len(state(log, 1)) == 4
    # a full cycle reads all; what lost its vector gets one again
    third = log.commit({"vectors": log.read("vectors").limit(1)}, "broken")
    assert third.sequence == 3 and log.read("chunks").count() == 3
    index_cycle(log, second, "b3", spy, embed)
    assert state(log) == wanted and seen[2] == []
    index_cycle(log, second, "b4", spy, embed, full=True)
    assert state(log) == [("a.rs", 1, "one\ntwo"), ("b.rs", 1, "not read"), ("d.rs", 1, "new")]
    log.roll_back(2, "back")
    assert state(log) == wanted and log.snapshot().sequence == 6
    index_cycle(log, second.limit(0), "b5", spy, embed)
    assert state(log) == []
    assert log.expire(keep=1) == [1, 2, 3, 4, 5, 6] and state(log) == [] and log.sequences() == [7]


def test_conflicts_and_migration(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "log"))
    row = lambda x: spark.createDataFrame([(x,)], "x int")
    log.commit({"t": row(1), "u": row(9)}, "first")
    log.commit({"t": row(2)}, "second", after=1)
    with pytest.raises(CommitConflictError, match="2"):
        log.commit({"t": row(3)}, "third", after=1)
    assert log.read("t").first().x == 2 and log.read("t", 1).first().x == 1 and log.read("u").first().x == 9
    assert log.commit({"t": row(4)}, "first").sequence == 1 and log.snapshot().sequence == 2
    (tmp_path / "log/manifests/000000000003.json").touch()  # a writer that was lost
    assert log.snapshot().sequence == 2
    with pytest.raises(CommitConflictError, match="3"):
        log.commit({"t": row(3)}, "third")
    assert log.expire() == []
    moved = log.migrate({1: lambda t: t | {"t": t["t"].withColumn("y", F.col("x") + 1)}, 2: lambda t: {"t": t["t"]}}, to=3)
    assert (moved.sequence, moved.format, set(moved.tables)) == (3, 3, {"t"}) and tuple(log.read("t").first()) == (2, 3)
    assert log.migrate({}, to=3).sequence == 3
    with pytest.raises(KeyError):
        log.migrate({}, to=4)


def test_stream_of_batches(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "log"))
    now = {"a_rs": (1, "one"), "b_rs": (1, "two")}
    cycle = index_on_batches(log, "watch", lambda: live(spark, **now), chunk, stub_embed(8))
    events = tmp_path / "events"
    for n in (1, 2):
        spark.createDataFrame([("k", False)], "key string, full_scan boolean").coalesce(1).write.mode("append").parquet(str(events))
        stream = spark.readStream.schema("key string, full_scan boolean").parquet(str(events))
        query = run_cycles(spark, stream, cycle, str(tmp_path / "cp"))
        assert query.awaitTermination(120) and query.exception() is None
        assert log.snapshot().sequence == n
        now["a_rs"] = (2, "other")
    assert state(log) == [("a.rs", 1, "other"), ("b.rs", 1, "two")]
    cycle(spark.createDataFrame([("k", True)], "key string, full_scan boolean"), 1)  # the last batch again
    assert log.snapshot().sequence == 2


def test_chunks_are_written_once(spark, tmp_path):
    """The chunks that a cycle reads again for their vectors are those of its snapshot, which an expiry leaves."""
    live = spark.createDataFrame([("a", 1, 3, "one"), ("b", 1, 3, "two")], "file_path string, mtime_ms long, bytes long, content string")
    chunk = lambda df: df.select("file_path", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "content")
    log = SnapshotLog(spark, str(tmp_path / "log"))
    for batch, state in (("first", live), ("second", live.withColumns({"mtime_ms": F.col("mtime_ms") + 1, "content": F.concat("content", F.lit("!"))}))):
        index_cycle(log, state, batch, chunk, lambda c: F.array(F.length(c).cast("float")))
    written = [p for p in (tmp_path / "log" / "data").rglob("*.parquet") if "content" in spark.read.parquet(str(p)).columns and spark.read.parquet(str(p)).count()]
    assert sum(spark.read.parquet(str(p)).count() for p in written) == 4  # two files in each of two cycles
    log.expire(keep=1)
    assert sorted(r.content for r in log.read("chunks").collect()) == ["one!", "two!"] and log.read("vectors").count() == 2
