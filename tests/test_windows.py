"""Windows with state: gaps, caps, forced triggers, full scans, and a restart from the checkpoint."""

import datetime as dt

import pytest

from tessera.streaming import windows

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "key string, path string, ts timestamp, control boolean"


def at(ms):
    return BASE + dt.timedelta(milliseconds=ms)


@pytest.fixture
def run(spark, tmp_path):
    """Feeds batches of events to a query that is started again for each, and gives all windows so far."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", windows.STATE_STORE)
    (tmp_path / "in").mkdir()
    count = iter(range(99))

    def feed(*rows, most=512):
        spark.createDataFrame([(k, p, at(ms), c) for k, p, ms, c in rows], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{next(count)}"))
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        found = windows.change_windows(stream, most=most, late="0 seconds")
        query = found.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(180)
        out = spark.read.schema(windows.WINDOWS).parquet(str(tmp_path / "out")).collect()
        ms = lambda t: round((t - BASE).total_seconds() * 1000)
        return sorted((r.key, ms(r.first), ms(r.last), r.events, r.reason, r.full_scan, r.paths) for r in out)

    yield feed
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_windows_outlive_restarts(run):
    first = run(("a", "x", 0, None), ("a", "y", 500, False), ("a", "x", 900, None), ("b", "p", 0, None), ("b", None, 600, None))
    assert first == []
    # a goes on in its window, b is forced at once, c has a window of its own
    second = run(("a", "z", 1100, None), ("b", "q", 1000, None), ("b", None, 1100, True), ("b", None, 1110, True), ("c", "u", 1200, None))
    assert second == [("b", 0, 1100, 3, "forced", False, ["", "p", "q"]), ("b", 1110, 1110, 0, "forced", False, [])]
    third = run(("end", "e", 60_000, None))
    assert third == [("a", 0, 1100, 4, "gap", False, ["x", "y", "z"]), *second, ("c", 1200, 1200, 1, "gap", False, ["u"])]


def test_caps_and_full_scans(run):
    found = [w for w in run(*(("a", f"p{i}", i * 600, None) for i in range(9)), *(("b", f"f{i:03}", i, None) for i in range(5)), ("end", "e", 60_000, None), most=4) if w[0] != "end"]
    more = [w for w in run(("end", "e", 120_000, None), most=4) if w[0] != "end"]
    assert found == more  # the end's own window is open
    assert more == [
        ("a", 0, 3000, 6, "cap", True, []), ("a", 3600, 4800, 3, "gap", False, ["p6", "p7", "p8"]), ("b", 0, 4, 5, "gap", True, []),
    ]
