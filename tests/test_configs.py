"""Entries, steps and flows of configuration files."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import configs

YAML = """%YAML 1.2
---
a: 1 # one
"b c": 'it''s'
url: http://x#y
list:
- x
- k: v
  more: [1, {"z": null}]
-
  - nested
run: |
  first: no key

  second
fold: >-
  one
  two
tail:
    deep: {open
    "q": "a \\"b\\" # c"
"""


def entries(text):
    return [(n, ".".join(k), v) for _, n, k, v in configs._entries(text)]


def test_indented_entries():
    assert entries(YAML) == [
        (3, "a", "1"), (4, "b c", "it's"), (5, "url", "http://x#y"), (6, "list", None), (7, "list.0", "x"), (8, "list.1", None), (8, "list.1.k", "v"), (9, "list.1.more", None),
        (9, "list.1.more.0", "1"), (9, "list.1.more.1", None), (9, "list.1.more.1.z", None), (10, "list.2", None), (11, "list.2.0", "nested"), (12, "run", "first: no key\n\nsecond"),
        (16, "fold", "one two"), (19, "tail", None), (20, "tail.deep", "{open"), (21, "tail.q", 'a "b" # c'),
    ]
    assert entries("") == [] and entries("::\n- \n\t") == [(1, ":", None), (2, ":.0", None)]


plain = st.text("abcxyz/-_", min_size=1, max_size=6).filter(lambda s: not s.startswith("-"))
trees = st.recursive(plain, lambda below: st.lists(below, min_size=1, max_size=3) | st.dictionaries(plain, below, min_size=1, max_size=3), max_leaves=12)


def write(value, indent, out):
    """The value as indented lines."""
    pairs = [(f"{k}:", v) for k, v in value.items()] if isinstance(value, dict) else [("-", v) for v in value]
    for head, v in pairs:
        if isinstance(v, str):
            out.append(" " * indent + f"{head} {v}")
        else:
            out.append(" " * indent + head)
            write(v, indent + 2, out)
    return out


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(plain, trees, min_size=1, max_size=3))
def test_indented_equals_json(tree):
    assert [(k, v) for _, _, k, v in configs._entries("\n".join(write(tree, 0, [])))] == list(configs._flatten(tree, []))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab:-'\"#|>{}[], \n\t\r&*", max_size=60))
def test_any_text_is_read(text):
    list(configs._entries(text))


def test_odd_files(spark):
    rows = [(None, "a: 1", 1), ("x.yaml", None, 2), ("e.yaml", "", 3), ("deep.json", "[" * 100_000, 4), ("long.yaml", "k: " + "v" * 1_000_000, 5), ("x.yaml", "a: 1", 6)]
    files = spark.createDataFrame(rows, "file_path string, content string, keys int")
    found = {(r.file_path, tuple(r["keys"]), len(r.value or "")) for r in configs.config_entries(files).collect()}
    assert {(None, ("a",), 1), ("long.yaml", ("k",), 1_000_000), ("x.yaml", ("a",), 1)} <= found
    assert configs.config_entries(files.limit(0)).count() == 0 and configs.pipeline_steps(files.limit(0)).count() == 0
    assert configs.asyncapi_flows(files, files.select("file_path")).count() == 0 and configs.pipeline_steps(files).count() == 0


def test_flows_at_the_root_and_by_name(spark):
    yaml = "channels:\n  b:\n    publish:\n      message:\n        x: 1\n    subscribe:\n  a:\n    publish: {}\n"
    files = spark.createDataFrame([("asyncapi.yml", yaml), ("s/t/asyncapi.json", json.dumps({"channels": {"z": {"publish": None}}})), ("s/other.yaml", yaml)], "file_path string, content string")
    one, two = (spark.createDataFrame([(p,) for p in paths], "file_path string") for paths in (["s/main.py"], ["s/main.py", "s/a.py", "u/t/main.py"]))
    rows = lambda e, **k: {(r.file_path, r.channel, r.direction, r.actor) for r in configs.asyncapi_flows(files, e, **k).collect()}
    root = {("b", "publish"), ("b", "subscribe"), ("a", "publish")}
    assert rows(one) == {("asyncapi.yml", c, d, "s/main.py") for c, d in root} | {("s/t/asyncapi.json", "z", "publish", "s/main.py")}
    assert rows(two) == {("asyncapi.yml", c, d, None) for c, d in root} | {("s/t/asyncapi.json", "z", "publish", "s/a.py")}
    assert {r[1] for r in rows(one, limit=1)} == {"a", "z"}


def test_steps_of_a_build(spark):
    files = spark.createDataFrame([("Makefile", "test-b:\ntest-a:\nbuild:\nrun:\nlint:\n"), ("ci.yml", "- run: cargo test\n- run: cargo fmt\n- uses: actions/cache@v4\n"), ("README.md", "pip install x\npython -m bench\neval it\n"), ("z.md", "ninja")], "file_path string, content string")
    anchors = spark.createDataFrame([("canon", "README.md", 100), ("howto", "Makefile", 95), ("ci", "ci.yml", 78), ("infra", "z.md", 60)], "kind string, file_path string, priority int")
    found = [(r.kind, r.label, r.file_path) for r in configs.build_steps(files, anchors).collect()]
    assert found == [("setup", "uses actions/cache@v4", "ci.yml"), ("build", "make build", "Makefile"), ("run", "make run", "Makefile"), ("test", "make test-a", "Makefile"), ("lint", "make lint", "Makefile"), ("format", "cargo fmt", "ci.yml")]
    assert configs.build_steps(files, anchors.limit(0)).count() == 0
