"""Ignore files: single rules, nesting and negation, and the scan of a tree."""

import pytest

from tessera.sources import files, ignore

RULES = [
    ("*.log", {"a.log", "x/y/b.log"}), ("/a.log", {"a.log"}), ("x/", {"x/y/b.log", "x/c.txt", "z/x/d.txt"}), ("/x/*.txt", {"x/c.txt"}), ("x/**", {"x/y/b.log", "x/c.txt"}), ("**/y", {"x/y/b.log"}),
    ("z/**/d.txt", {"z/d.txt", "z/x/d.txt"}), ("?.txt", {"x/c.txt", "z/x/d.txt", "z/d.txt"}), ("[!c].txt", {"z/x/d.txt", "z/d.txt"}), (r"\#odd", {"#odd"}), (r"\!odd", {"!odd"}), ("a+b(c)", {"a+b(c)"}), ("[open", {"[open"}),
    ("# *.log", set()), ("", set()), ("/", set()), ("*.log\n!a.log", {"x/y/b.log"}), ("x/\n!x/c.txt", {"x/y/b.log", "x/c.txt", "z/x/d.txt"}), ("x/*\n!x/c.txt", {"x/y/b.log"}), ("!a.log\n*.log  ", {"a.log", "x/y/b.log"}),
]
PATHS = ["a.log", "x/y/b.log", "x/c.txt", "z/x/d.txt", "z/d.txt", "#odd", "!odd", "a+b(c)", "[open"]


def left(spark, paths, rule_files):
    rules = ignore.ignore_rules(spark.createDataFrame(rule_files, "file_path string, content string"))
    return {r.file_path for r in ignore.drop_ignored(spark.createDataFrame([(p,) for p in paths], "file_path string"), rules).collect()}


@pytest.mark.parametrize("few", [10_000, 0])
def test_each_rule(spark, few, monkeypatch):
    monkeypatch.setattr(ignore, "FEW_RULES", few)
    # each rule set in a directory of its own
    paths = [f"r{i}/{p}" for i in range(len(RULES)) for p in PATHS]
    found = left(spark, paths, [(f"r{i}/.gitignore", text) for i, (text, _) in enumerate(RULES)])
    assert {i: {p for p in PATHS if f"r{i}/{p}" not in found} for i in range(len(RULES))} == {i: gone for i, (_, gone) in enumerate(RULES)}


def test_nested_files(spark):
    files = [(".gitignore", "*.txt\nkeep/"), ("a/.gitignore", "!*.txt\n"), ("a/b/.gitignore", "c.txt"), ("keep/.gitignore", "!*"), (".git/info/exclude", "*.md\n!x.txt"), (".gitignore", None)]
    assert left(spark, ["x.txt", "a/x.txt", "a/b/x.txt", "a/b/c.txt", "keep/x.py", "a/keep/y.py", "b.md", "ok.py"], files) == {"a/x.txt", "a/b/x.txt", "ok.py"}
    assert left(spark, ["x"], [("y/.gitignore", "*")]) == {"x"}


def test_scan_of_a_tree(spark, tmp_path):
    for name, text in {".gitignore": "*.gen.py\n/out/\n", "src/.gitignore": "!keep.gen.py\n", "src/a.py": "a", "src/b.gen.py": "b", "src/keep.gen.py": "c", "out/d.py": "d", "src/out/e.py": "e", ".git/info/exclude": "secret.py", "secret.py": "s"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    names = lambda **more: {r.file_path for r in files.scan(spark, str(tmp_path), **more).collect()}
    assert names() == {"src/a.py", "src/keep.gen.py", "src/out/e.py"}
    assert names(ignore_files=False) == {"src/a.py", "src/b.gen.py", "src/keep.gen.py", "out/d.py", "src/out/e.py", "secret.py"}
