"""States of working copies and changes between commits, in repositories made for the test."""

import os
import subprocess

import pytest

from tessera.sources import git


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "main"
    root.mkdir()
    env = dict(os.environ, GIT_CONFIG_GLOBAL="/dev/null", GIT_AUTHOR_NAME="a", GIT_AUTHOR_EMAIL="a@b", GIT_COMMITTER_NAME="a", GIT_COMMITTER_EMAIL="a@b")

    def run(*args, at=root):
        return subprocess.run(["git", "-C", str(at), *args], check=True, capture_output=True, text=True, env=env).stdout.strip()

    run("init", "-q", "-b", "main")
    (root / "a.txt").write_text("one line that stays\n" * 5)
    (root / "b.txt").write_text("b")
    run("add", "."), run("commit", "-qm", "first")
    return root, run


def test_copies_and_watermark(spark, repo, tmp_path):
    root, run = repo
    other = tmp_path / "other"
    run("worktree", "add", "-q", "-b", "topic/x", str(other))
    (other / "src").mkdir()
    (other / "src" / "c d.rs").write_text("fn c() {}")
    run("add", ".", at=other), run("commit", "-qm", "second", at=other)
    run("mv", "b.txt", "z.txt", at=other)
    (other / "docs").mkdir()
    (other / "docs" / "n.md").write_text("n")
    asked = git.working_copies(spark, [str(root), str(tmp_path / "none")])
    assert asked.rdd.getNumPartitions() == 2
    rows = {r.branch: r for r in asked.collect()}
    main, topic = rows["main"], rows["topic/x"]
    assert (main.path, main.head, main.dirty, main.dirty_hash, main.dirty_paths, main.ahead, main.behind) == (str(root), run("rev-parse", "HEAD"), False, None, [], 0, 0)
    assert (topic.path, topic.dirty, topic.base, topic.ahead, topic.behind, topic.detached) == (str(other), True, "refs/heads/main", 1, 0, False)
    assert sorted(topic.dirty_paths) == ["b.txt", "docs/", "z.txt"] and topic.last_commit is not None
    assert [(r.path, r.areas) for r in git.copy_areas(asked).collect()] == [(str(other), ["docs"])]
    # the status stays, the hash does not
    (root / "a.txt").write_text("x")
    first = git.git_watermark(spark, str(root)).first()
    (root / "a.txt").write_text("longer")
    second = git.git_watermark(spark, str(root)).first()
    assert first.git_dirty and second.git_dirty and first.git_head == second.git_head and first.dirty_hash != second.dirty_hash
    assert git.git_watermark(spark, str(tmp_path / "none")).count() == 0


def test_changed_paths(spark, repo):
    root, run = repo
    old = run("rev-parse", "HEAD")
    run("mv", "a.txt", "moved.txt")
    (root / "b.txt").write_text("new")
    run("add", "."), run("commit", "-qm", "second")
    rows = lambda *a: [r.path for r in git.changed_paths(spark, [str(root)], *a).orderBy("path").collect()]
    assert rows(old, "HEAD") == ["a.txt", "b.txt", "moved.txt"] and rows("HEAD", "HEAD") == [] and rows(old, "HEAD", 2) == [None] and rows("nowhere", "HEAD") == []
    with pytest.raises(ValueError, match="names no commit"):
        git.changed_paths(spark, [str(root)], "--output=x", "HEAD")
