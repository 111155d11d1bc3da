"""Edits and suggestions of a notebook: validation, skipping, adoption, conflicts and roll-back."""

import pytest

from tessera.sources import notebook as nb
from tessera.sources.snapshots import CommitConflictError, SnapshotLog


@pytest.fixture
def log(spark, tmp_path):
    return SnapshotLog(spark, str(tmp_path / "notebook"))


@pytest.fixture
def make(spark):
    def anchors(*rows):
        return spark.createDataFrame([(i, "canon", label, [(f"{i}.rs", 1, 2, None)] if i else [], None) for i, label in rows], nb.ANCHORS)

    def runbooks(*rows):
        return spark.createDataFrame([(i, title, ids, None) for i, title, ids in rows], nb.RUNBOOKS)

    return anchors, runbooks


def labels(log, sequence=None):
    return {r.id: r.label for r in log.read("anchors", sequence).collect()}


def test_suggestions(log, make):
    anchors, runbooks = make
    assert {tuple(r) for r in nb.preview(log, anchors(("a", "A")), runbooks(("r", "R", ["a"]))).collect()} == {("anchor", "a", "create", None), ("runbook", "r", "create", None)}
    assert log.snapshot() is None
    nb.apply_suggestion(log, anchors(("a", "A"), ("b", "B")), runbooks(("r", "R", ["a"])), "s1")
    nb.edit(log, "e1", anchors=anchors(("b", "mine"), ("own", "mine")), runbooks=runbooks(("same", "S", ["b"]), ("other", "O", [])))
    # b was changed by hand, own is no suggestion's; a is as it was written
    more = anchors(("a", "A2"), ("b", "B2"), ("own", "x"), ("c", "C"))
    books = runbooks(("r", "R2", ["c"]), ("same", "S", ["b"]), ("other", "O2", []))
    wanted = {("anchor", "a", "update", None), ("anchor", "b", "skip", nb.NOT_MANAGED), ("anchor", "own", "skip", nb.NOT_MANAGED), ("anchor", "c", "create", None), ("runbook", "r", "update", None), ("runbook", "same", "update", None), ("runbook", "other", "skip", nb.NOT_MANAGED)}
    assert {tuple(r) for r in nb.preview(log, more, books).collect()} == wanted
    nb.apply_suggestion(log, more, books, "s2")
    assert labels(log) == {"a": "A2", "b": "mine", "own": "mine", "c": "C"}
    assert nb.apply_suggestion(log, more, books, "s2").sequence == 3 and log.snapshot().sequence == 3
    nb.apply_suggestion(log, more, books, "s3", force=True)
    assert labels(log)["own"] == "x"
    _, touched = nb.roll_back(log, 1, "back")
    assert {tuple(r) for r in touched.collect()} == {("anchor", "own"), ("anchor", "c"), ("runbook", "same"), ("runbook", "other")} and labels(log) == {"a": "A", "b": "B"}
    with pytest.raises(CommitConflictError):
        nb.apply_suggestion(log, more, books, "late", after=2)
    with pytest.raises(ValueError, match="truncated"):
        nb.apply_suggestion(log, more, books, "cut", truncated=True)


def test_changed_by_hand(log, make, spark):
    anchors, runbooks = make
    nb.apply_suggestion(log, anchors(("a", "A")), runbooks(), "s1")
    kept = log.read("anchors").first()
    nb.edit(log, "e1", anchors=spark.createDataFrame([(kept.id, kept.kind, "by hand", kept.evidence, kept.fingerprint)], nb.ANCHORS))
    assert {tuple(r) for r in nb.preview(log, anchors(("a", "A")), runbooks()).collect()} == {("anchor", "a", "skip", nb.CHANGED)}


def test_errors(log, make, spark):
    anchors, runbooks = make
    nb.apply_suggestion(log, anchors(("a", "A"), ("b", "B")), runbooks(("r", "R", ["a"])), "s1")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    for wrong, message in (
        (lambda: nb.edit(log, "x1", gone_anchors=ids("a")), "unknown anchor: r"), (lambda: nb.edit(log, "x2", gone_anchors=ids("z")), "nothing to delete: z"),
        (lambda: nb.edit(log, "x3", runbooks=runbooks(("q", "Q", ["z"]))), "unknown anchor: q"), (lambda: nb.apply_suggestion(log, anchors(("d", "1"), ("d", "2")), runbooks(), "x4"), "repeated id: d"),
        (lambda: nb.apply_suggestion(log, anchors(("", "1")), runbooks(), "x5"), "blank|sound"), (lambda: nb.apply_suggestion(log, spark.createDataFrame([("e", "k", "l", [("f", 3, 2, None)], None)], nb.ANCHORS), runbooks(), "x6"), "sound evidence: e"),
    ):
        with pytest.raises(Exception, match=message):
            wrong()
    assert log.snapshot().sequence == 1
    nb.edit(log, "ok", gone_anchors=ids("a"), gone_runbooks=ids("r"))
    assert labels(log) == {"b": "B"} and log.read("runbooks").count() == 0
