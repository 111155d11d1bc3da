"""Operators on literal cases."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import paths, text, vectors
from tessera.operators import actions, anchors, chunking, configs, evaluate, graph, lines, orient, packing, ranking, retrieval, routed, vector
from tessera.profile import GENERAL, BARE, PathRule, load_profile
from tessera.sources import files as sources
from tessera.sources import sinks, stores
from tessera.streaming import debounce

PYTHON = '''import os, sys
from json import loads

# opens things
def open_all(x):
    return loads(os.read(x))


class Box:
    def get(self):
        """Gives it."""
        return open_all(self)

    @property
    def hidden(self):
        return 1
'''
RUST = """use std::collections::{HashMap, HashSet};

/// A box.
struct Box { a: i32 }

impl Box {
    /// Gets.
    pub fn get(&self) -> HashMap {
        helper(self)
    }
}

fn helper(b: &Box) { }
"""


def column(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("query", "kind"), [("", "conceptual"), ("src/main.rs", "path"), ("foo.py", "path"), ("get_user", "identifier"), ("getUser", "identifier"), ("touch_file ttl", "identifier"), ("How does X work", "conceptual"), ("error handling", "conceptual"), ("std::fs", "path"), ("main.rs usage", "path")])
def test_query_kind(spark, query, kind):
    assert column(spark, query, text.query_kind) == kind


def test_query_expansion_starts_with_query_and_is_bounded(spark):
    out = column(spark, "searchIndex error_handling vector", text.expand_query)
    assert out[:6] == ["searchIndex error_handling vector", "search", "index", "error", "handling", "vector"] and len(out) == 15 == len(set(out))


@pytest.mark.parametrize(("path", "kind"), [("a/README.md", "docs"), ("a/tests/x.rs", "test"), ("a/x.toml", "config"), ("a/x.rs", "code"), ("Makefile", "other"), ("tests/a.json", "config")])
def test_path_kind(spark, path, kind):
    assert column(spark, path, paths.path_kind) == kind


@pytest.mark.parametrize(("path", "secret"), [(".env", True), (".env.local", True), (".env.example", False), ("a/key.pem", True), ("a/main.rs", False)])
def test_secret_files(spark, path, secret):
    assert column(spark, path, paths.is_secret_file) is secret


def test_glob_rules(spark):
    assert column(spark, "src/A/b.rs", lambda c: paths.any_rule(c, [PathRule("src/*/*.rs", "glob")]))
    assert not column(spark, "src/a/b/c.rs", lambda c: paths.any_rule(c, [PathRule("src/*/*.rs", "glob")]))
    assert column(spark, "src/a/b/c.rs", lambda c: paths.any_rule(c, [PathRule("src/**/*.rs", "glob")]))


def test_profiles():
    p = load_profile(json.dumps({"name": "mine", "rerank": {"bm25": {"k1": 2.0}}, "paths": {"reject": [{"pattern": "x/", "kind": "prefix"}, {"pattern": " "}]}}))
    assert (p.k1, p.b, p.min_fuzzy, p.reject) == (2.0, BARE.b, 0.15, (PathRule("x/", "prefix"),))
    assert GENERAL.models("conceptual")[0] == "embeddinggemma-300m" and GENERAL.models("other") == ("bge-small",)
    with pytest.raises(ValueError, match="unknown"):
        load_profile(json.dumps({"rerank": {"bm25": {"k2": 1}}}))


def test_python_chunks():
    found = chunking.chunk_source("a/b.py", "python", PYTHON, chunking.ChunkConfig(minimum=1))
    assert [(c["symbol_name"], c["chunk_type"], c["parent_scope"], c["qualified_name"]) for c in found] == [("open_all", "function", None, "open_all"), ("get", "method", "Box", "Box.get")]
    assert found[0]["context_imports"] == ["from json import loads", "import os, sys"] and found[0]["documentation"] == "opens things" and found[1]["documentation"] == "Gives it."


DEEP = ("-" * 200_000 + "1", "f" + "()" * 50_000, "not " * 20_000 + "x")


@pytest.mark.parametrize("text", DEEP)
def test_python_deeper_than_the_parser_is_one_chunk(text):
    found = chunking.chunk_source("a/b.py", "python", text + "\n", chunking.ChunkConfig(overlap="lines:2"))
    assert [(c["chunk_type"], c["start_line"], c["end_line"], c["content"]) for c in found] == [(None, 1, 1, text)]


def test_rust_chunks_and_graph(spark):
    found = chunking.chunk_source("a/b.rs", "rust", RUST, chunking.ChunkConfig(minimum=1))
    assert [(c["symbol_name"], c["qualified_name"]) for c in found] == [("Box", "Box"), ("get", "Box::get"), ("helper", "helper")]
    assert found[1]["context_imports"] == ["use std::collections::{HashMap, HashSet}"]
    files = spark.createDataFrame([("a/b.rs", RUST), ("a/c.py", PYTHON), ("e.py", "")], "file_path string, content string")
    nodes, edges = graph.build_graph(chunking.chunk_files(files, chunking.ChunkConfig(minimum=1)))
    names = {r.node: r.name for r in nodes.collect()}
    assert {(names[r.src], names[r.dst], r.rel) for r in edges.collect()} >= {("get", "helper", "Calls"), ("helper", "Box", "Uses"), ("get", "open_all", "Calls")}


def test_merge_small_and_overlap():
    config = chunking.ChunkConfig(target=20, maximum=40, minimum=1)
    chunk = lambda a, b, n: chunking._chunk("f", "x", a, b, ["word word word word"] * n)
    merged = chunking.merge_small([chunk(1, 1, 9), chunk(2, 2, 9), chunk(9, 9, 9)], config)
    assert [(c["start_line"], c["end_line"]) for c in merged] == [(1, 2), (9, 9)]
    out = chunking.overlap_chunks([chunk(1, 3, 9), chunk(4, 6, 9)], chunking.ChunkConfig(target=20, maximum=40, minimum=1, overlap="lines:2"))
    assert out[1]["start_line"] == 2 and out[1]["content"].count("\n") == 4
    tight = chunking.overlap_chunks([chunk(1, 3, 9), chunk(4, 6, 9)], chunking.ChunkConfig(target=15, maximum=17, minimum=1, overlap="window:100"))
    assert tight[1]["start_line"] == 4


def test_lines(spark):
    files = spark.createDataFrame([("a", "x\ny\nz\n"), ("b", ""), ("c", "\n\nx"), ("d", "x\ny")], "file_path string, content string")
    assert {(r.file_path, r.n, r.line) for r in lines.explode_lines(files).where("file_path = 'a'").collect()} == {("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z")}
    assert lines.explode_lines(files).where("file_path = 'b'").count() == 0
    assert [tuple(r) for r in lines.grep_hunks(files, "x|z", 1, 0).orderBy("file_path").collect()] == [("a", 1, 3, 2), ("c", 2, 3, 1), ("d", 1, 1, 1)]
    assert [r.file_path for r in lines.literal_search(files, "x").collect()] == ["a", "c", "d"]
    cut = {r.file_path: (r.content, r.truncated) for r in lines.line_window(files, 1, 2, 4).collect()}
    assert cut["a"] == ("x\ny", True) and cut["d"] == ("x\ny", False)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 6)), max_size=12))
def test_interval_merge_covers_and_is_idempotent(spark, pairs):
    rows = spark.createDataFrame([("k", a, a + n) for a, n in pairs], "k string, s int, e int")
    once = lines.merge_intervals(rows, ["k"], "s", "e")
    found = sorted((r.s, r.e) for r in once.collect())
    assert {x for a, b in found for x in range(a, b + 1)} == {x for a, n in pairs for x in range(a, a + n + 1)}
    assert all(b + 1 < c for (_, b), (c, _) in zip(found, found[1:], strict=False))
    assert sorted((r.s, r.e) for r in lines.merge_intervals(once, ["k"], "s", "e").collect()) == found


@pytest.mark.parametrize(("semantic", "fuzzy", "passes"), [(None, None, True), (None, 0.1, False), (0.1, None, False), (0.1, 0.1, False), (0.9, 0.1, True), (0.1, 0.9, True), (None, 0.9, True)])
def test_thresholds(spark, semantic, fuzzy, passes):
    rows = spark.createDataFrame([(semantic, fuzzy)], "s double, f double")
    assert rows.where(ranking.passes_thresholds(F.col("s"), F.col("f"), 0.3, 0.42)).count() == passes


def test_normalize(spark):
    rows = [(1, 1, float("nan")), (1, 2, 10.0), (1, 3, 20.0), (2, 1, float("inf")), (2, 2, 5.0), (3, 1, None), (4, 1, 1.0), (4, 2, 1.0)]
    out = {(r.query_id, r.item): r.score for r in ranking.normalize_scores(spark.createDataFrame(rows, "query_id int, item int, score double")).collect()}
    assert out == {(1, 1): 0.0, (1, 2): 0.0, (1, 3): 1.0, (2, 1): 0.0, (2, 2): 1.0, (3, 1): 0.0, (4, 1): 1.0, (4, 2): 1.0}


def test_must_hits(spark):
    chunks = spark.createDataFrame([(1, "x/utils/a.rs"), (2, "b.rs")], "item int, file_path string")
    queries = spark.createDataFrame([(7, ["utility"]), (8, ["other"])], "query_id int, terms array<string>")
    hits = retrieval.must_hits(chunks, queries, GENERAL)
    assert [tuple(r) for r in hits.collect()] == [(7, 1, 1.4)]
    scored = spark.createDataFrame([(7, 2, 5.0), (8, 2, 1.0)], "query_id int, item int, score double")
    assert {tuple(r) for r in retrieval.inject_must_hits(scored, hits, 25.0).collect()} == {(7, 2, 5.0), (7, 1, 42.0), (8, 2, 1.0)}


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0, 0.0])], "vec_id int, embedding array<float>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "query_id int, q array<float>")
    found = [(r.query_id, r.item, r.score) for r in vector.vector_topk(rows, asked, 2).orderBy("query_id", "rank").collect()]
    assert found == [(1, 1, 1.0), (1, 3, 1.0), (2, 1, 0.0), (2, 2, 0.0)]
    v = vectors.stub_vector("x", 16)
    assert np.isclose(np.linalg.norm(v), 1) and (v == vectors.stub_vector("x", 16)).all() and (v != vectors.stub_vector("y", 16)).any()
    assert text.fnv1a64(b"") == 0xCBF29CE484222325 and text.fnv1a64(b"a") == 0xAF63DC4C8601EC8C


def test_graph_paths(spark):
    edges = spark.createDataFrame([("a", "b", "Calls", 1.0), ("b", "c", "Uses", 0.5), ("a", "c", "Calls", 1.0), ("c", "a", "Calls", 1.0), ("c", "c", "Calls", 1.0)], "src string, dst string, rel string, weight double")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.distance) for r in graph.reach(edges, start, 3).collect()} == {("b", 1), ("c", 1)}
    pairs = spark.createDataFrame([("a", "c"), ("b", "a"), ("a", "z")], "source string, target string")
    assert {(r.source, r.target, r.cost, tuple(r.path)) for r in graph.shortest_paths(edges, pairs, 4).collect()} == {("a", "c", 1, ("a", "c")), ("b", "a", 2, ("b", "c", "a"))}
    weights = {(r.source, r.target): r.cost for r in graph.shortest_paths(edges, pairs, 4, cost="weights").collect()}
    assert weights == {("a", "c"): 1, ("b", "a"): 1}
    assert graph.hotspots(edges, 1).first().node == "c"


def test_pack_stops_at_first_overflow():
    items = [{"item": x, "cost": c} for x, c in (("a", 400), ("b", 700), ("c", 10))]
    out = packing.pack_items(items, {"a": [{"item": "r", "relation": "Calls", "cost": 1}]}, 1000, 3)
    assert [o["item"] for o in out] == ["a"] and out[0]["truncated"]
    related = {"a": [{"item": f"t{i}", "relation": "TestedBy", "cost": 1} for i in range(5)] + [{"item": "c", "relation": "Calls", "cost": 1}], "c": [{"item": "t0", "relation": "Calls", "cost": 1}, {"item": "u", "relation": "Calls", "cost": 1}]}
    out = packing.pack_items([items[0], items[2]], related, 1000, 3)
    assert [o["item"] for o in out] == ["a", "c", "t0", "u", "t1"]


def test_context_pack_takes_what_the_whole_queues_give(spark, monkeypatch):
    """The choice among the rows that come to a query's task is that among all of its rows, and these rows are bounded by the pack."""
    rnd, sizes = random.Random(5), []
    first = [(q, f"p{i}", float(rnd.randrange(4)), 10 if q else 300) for q in range(6) for i in range(1 + q)] + [(0, f"p{i}", 9.0, 300) for i in range(1, 200)]
    more = [(q, f"p{rnd.randrange(1 + q)}", f"i{rnd.randrange(40)}" if rnd.random() < 0.5 else f"j{n}", rnd.choice(["Calls", "Extends", "TestedBy", "x"]), float(rnd.randrange(90)), 20) for n in range(6000) for q in [n % 6]]
    more += [(0, f"p{n % 200}", f"k{n}", "Calls", 1.0, 1) for n in range(3000)]
    primaries = spark.createDataFrame(first, "query_id long, item string, rank double, cost long")
    related = spark.createDataFrame(more, "query_id long, primary string, item string, relation string, relevance double, cost long")
    for budget in (130, 400, 2000):
        found = packing.context_pack(primaries, related, max_chars=budget).collect()
        for q in range(6):
            own = [{"item": i, "cost": c} for _, i, _, c in sorted((r for r in first if r[0] == q), key=lambda r: (r[2], r[1]))]
            queues = {}
            for _, p, i, relation, _, c in sorted((r for r in more if r[0] == q), key=lambda r: (-r[4], r[2], r[3], r[5])):
                queues.setdefault(p, []).append({"item": i, "relation": relation, "cost": c})
            wanted = packing.pack_items(own, queues, budget, 3)
            assert [(r["position"], r["item"], r["relation"], r["used"], r["truncated"]) for r in wanted] == [(r.position, r.item, r.relation, r.used, r.truncated) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.position)]
    seen = spark.sparkContext.accumulator(0)
    whole = packing.pack_items

    def counted(own, queues, *limits):
        seen.add(len(own) + sum(map(len, queues.values())))
        return whole(own, queues, *limits)

    monkeypatch.setattr(packing, "pack_items", counted)
    packing.context_pack(primaries.where("query_id = 0"), related.where("query_id = 0"), max_chars=2000).collect()
    assert seen.value <= 8  # six primaries and the one over the budget; all 4,200 rows came before


@settings(max_examples=50)
@given(st.lists(st.text(max_size=20), max_size=20), st.integers(60, 400))
def test_budget_is_never_exceeded(items, budget):
    out = packing.shrink_to({"items": items}, "items", budget)
    assert len(json.dumps(out, ensure_ascii=False)) == out["used_chars"] <= budget
    assert packing.decode_cursor(packing.encode_cursor({"last": "x" * 300})) == {"last": "x" * 300}


def test_references():
    context = {"items": [{"data": {"path": "a/b"}}]}
    assert packing.resolve_refs({"x": [{"$ref": "#/items/0/data/path"}], "y": {"$ref": "#/no", "$default": 3}}, context) == {"x": ["a/b"], "y": 3}
    with pytest.raises(ValueError, match="unresolved"):
        packing.resolve_refs({"$ref": "#/no"}, context)


def test_increments(spark):
    state = lambda *rows: spark.createDataFrame(rows, "file_path string, mtime_ms long")
    stored, live = state(("a", 1), ("b", 2), ("c", 3)), state(("a", 1), ("b", 3), ("d", 1))
    assert {r.file_path for r in sinks.changed_files(live, stored).collect()} == {"b", "d"}
    assert {r.file_path for r in sinks.purge_missing(stored, live).collect()} == {"a", "b"}
    anchors = spark.createDataFrame([("x",), ("y",)], "anchor_id string")
    books = spark.createDataFrame([(["x"],)], "anchor_ids array<string>")
    assert [r.anchor_id for r in sinks.delete_anchors(anchors, anchors.where("anchor_id = 'y'"), books).collect()] == ["x"]
    with pytest.raises(Exception, match="refers to anchor"):
        sinks.delete_anchors(anchors, anchors, books).collect()


def test_scan_and_cases(spark, tmp_path):
    for name, body in (("src/a.rs", "fn a() {}"), ("node_modules/b.js", "x"), (".env", "k=1"), ("docs/c.md", "# c"), ("d.bin", "x"), (".github/ci.yml", "a: 1")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    found = {r.file_path: r.content for r in sources.scan(spark, str(tmp_path)).collect()}
    assert found == {"src/a.rs": "fn a() {}", "docs/c.md": "# c"}
    assert sources.scan(spark, str(tmp_path / ".github")).first().file_path == "ci.yml"
    listed = spark.createDataFrame([(p,) for p in found], "file_path string")
    assert [r.name for r in sources.list_directory(listed, ".").collect()] == ["docs", "src"]
    (tmp_path / "cases.json").write_text(json.dumps({"schema_version": 1, "cases": [{"id": "1", "query": "q", "expected_paths": ["a"]}]}))
    assert sources.load_cases(spark, str(tmp_path / "cases.json")).count() == 1
    (tmp_path / "bad.json").write_text(json.dumps({"schema_version": 1, "cases": []}))
    with pytest.raises(ValueError, match="needs"):
        sources.load_cases(spark, str(tmp_path / "bad.json"))


def test_orientation(spark):
    files = spark.createDataFrame([("README.md", "run `make build`\ninstall it\n"), ("src/main.rs", "fn main() {}"), ("api/openapi.json", "{}"), ("docs/x.md", "y")], "file_path string, content string")
    assert {(r.kind, r.file_path) for r in orient.select_anchors(files).collect()} == {("canon", "README.md"), ("contract", "api/openapi.json"), ("entrypoint", "src/main.rs")}
    assert orient.meaning_pack(files, 40).count() < orient.meaning_pack(files, 4000).count()


def test_tuner_goes_up_at_once_and_down_slowly():
    t = debounce.Tuner()
    assert t.after_cycle(9000, 0, True) == (3000, 12_000)
    assert [t.after_cycle(10, 0, True)[0] for _ in range(3)] == [3000, 3000, 1500]


def test_debounce_stream_equals_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(k, base + dt.timedelta(milliseconds=ms)) for k, times in {"a": (0, 500, 1000, 5000), "b": [i * 600 for i in range(9)]}.items() for ms in times]
    rows.append(("end", base + dt.timedelta(minutes=5)))
    events = spark.createDataFrame(rows, "key string, ts timestamp")
    wanted = {tuple(r) for r in debounce.debounce_batch(events).where("key <> 'end'").collect()}
    assert {(r[0], r[3]) for r in wanted} == {("a", 3), ("a", 1), ("b", 6), ("b", 3)}
    events.where("key <> 'end'").coalesce(1).write.parquet(str(tmp_path / "in/1"))
    events.where("key = 'end'").coalesce(1).write.parquet(str(tmp_path / "in/2"))
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = debounce.debounce_stream(stream).writeStream.format("memory").queryName("batches").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("batches").where("key <> 'end'").collect()} == wanted


@pytest.mark.parametrize(("query", "kind", "found"), [('where is "exact text" in src/a.rs', "quoted", "exact text"), ("see src/a.rs:12 and b.py#L3", "path", "src/a.rs"), ("what calls get_user or getAll", "identifier", "get_user"), ("plain words", None, None)])
def test_anchor_detection(query, kind, found):
    anchor = anchors.detect_anchor(query)
    assert (anchor and anchor.kind, anchor and anchor.text) == (kind, found)


@settings(max_examples=100)
@given(st.text(max_size=40))
def test_anchor_is_within_the_query(query):
    anchor = anchors.detect_anchor(query)
    assert anchor is None or anchor.text in query


def test_directives():
    d = anchors.parse_directives("deep k:3 in:src not:src/x fp:*.rs where is it lit:a: b c")
    assert (d.mode, d.k, d.include, d.exclude, d.pattern, d.text, d.literal) == ("deep", 3, ["src"], ["src/x"], "*.rs", "where is it", "a: b c")
    assert anchors.parse_directives("index:5s x").index_ms == 5000


def test_symbol_anchor(spark):
    cases = {"find get_user2 here": "get_user2", "what does `Foo::barBaz()` do": "barBaz", "plain words only": None, "aB cD": "aB", "ABC x1": "x1", "": None}
    rows = spark.createDataFrame(list(cases.items()), "query string, wanted string").select("query", "wanted", anchors.symbol_anchor(F.col("query")).alias("found")).collect()
    assert [(r.query, r.found) for r in rows] == [(r.query, r.wanted) for r in rows]


def test_direct_matches(spark):
    files = spark.createDataFrame([("src/a/b.rs",), ("x/a/b.rs",), ("src/a/bb.rs",)], "file_path string")
    queries = spark.createDataFrame([(1, "a/b.rs"), (2, "src/a/b.rs"), (3, "bb.r"), (4, "no words"), (5, " './X\\A\\B.rs' "), (6, "/b")], "query_id int, query string")
    found = {(r.query_id, r.file_path, r.tier) for r in anchors.direct_paths(files, queries).collect()}
    # a suffix need not start at a directory
    assert found == {(1, "src/a/b.rs", 1), (1, "x/a/b.rs", 1), (2, "src/a/b.rs", 0), (3, "src/a/bb.rs", 2), (5, "x/a/b.rs", 0), (6, "src/a/b.rs", 2), (6, "x/a/b.rs", 2), (6, "src/a/bb.rs", 2)}
    chunks = spark.createDataFrame([(1, "s/mod.rs", "Engine"), (2, "s/engine.rs", "run"), (3, "t/x.rs", "run"), (4, "s/engine.rs", None)], "item int, file_path string, symbol string")
    asked = spark.createDataFrame([(1, "engine"), (2, "RUN")], "query_id int, query string")
    assert {(r.query_id, r.item) for r in anchors.direct_symbols(chunks, asked).collect()} == {(1, 2), (1, 4), (2, 2), (2, 3)}


def test_guard_and_focus(spark):
    rows = spark.createDataFrame([(1, 0, "a", "has get_user x"), (1, 1, "b", "none"), (2, 0, "c", "forget_user")], "query_id int, rank int, file_path string, content string")
    assert {r.file_path for r in anchors.guard(rows, anchors.Anchor("identifier", "get_user")).collect()} == {"a", "b"}
    related = spark.createDataFrame([(1, "p", "a", 1, 0.5, "no"), (1, "p", "b", 2, 0.9, "word"), (1, "p", "c", 2, 0.8, "no"), (1, "p", "d", 3, 1.0, "word")], "query_id int, primary string, item string, distance int, relevance double, content string")
    assert [r.item for r in anchors.focus_related(related, F.array(F.lit("word"))).orderBy("rank").collect()] == ["b", "a"]
    firsts = [spark.createDataFrame(x, "question_id int, item string") for x in ([(1, "a")], [(1, "b"), (2, "c")])]
    assert {(r.question_id, r.item, r.source) for r in anchors.first_source(firsts).collect()} == {(1, "a", 0), (2, "c", 1)}


def test_graph_boost_and_explain(spark):
    first = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "query_id int, item string, rank int")
    hits = spark.createDataFrame([(1, "b", 0), (1, "c", 1), (1, "x", 2)], "query_id int, item string, rank int")
    out = anchors.graph_boost(first, hits, spark.createDataFrame([("x",)], "item string"), 0.25, 10).orderBy("rank").collect()
    assert [r.item for r in out] == ["b", "a", "c"] and (out[0].score, out[-1].score) == (1.0, 0.0)
    nodes = spark.createDataFrame([("a", "a"), ("test_b", "test_b")], "node string, name string")
    edges = spark.createDataFrame([("test_b", "a", "Calls", 1.0)], "src string, dst string, rel string, weight double")
    of = spark.createDataFrame([("a",)], "node string")
    assert {(r.role, r.node) for r in graph.explain(nodes, edges, of).collect()} == {("definition", "a"), ("dependent", "test_b"), ("test", "test_b")}
    assert [r.node for r in graph.public_nodes(nodes, edges, nodes.withColumn("content", F.lit(""))).collect()] == ["a"]
    assert [r.name for r in graph.key_types(nodes, edges).collect()] == ["a"]


def test_versions_and_health(spark, tmp_path):
    root = str(tmp_path)
    for i in (1, 2):
        sinks.stage_and_commit({"t": spark.range(i)}, root, f"v{i}")
    assert sinks.read_version(spark, root, "t").count() == 2
    sinks.point_to(spark, root, "v1")
    assert sinks.read_version(spark, root, "t").count() == 1
    log = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), True, 10, None), (2, dt.datetime(2024, 1, 2), False, 5, "x"), (3, dt.datetime(2024, 1, 3), True, 30, None)], "cycle int, ts timestamp, ok boolean, duration_ms int, reason string")
    row = sinks.health_snapshot(log).first()
    assert (row.p95_ms, row.failures, row.last_success.day) == (30, ["x"], 3)


def test_more_orientation(spark):
    changes = spark.createDataFrame([("w", "src/a.rs"), ("w", "docs/a.md"), ("w", "docs/b.md"), ("v", "zzz")], "worktree string, path string")
    assert [(r.worktree, r.areas) for r in orient.touched_areas(changes).collect()] == [("w", ["core", "docs"])]
    api = json.dumps({"asyncapi": "2", "channels": {"a/b": {"publish": {}}, "c": {"subscribe": {}, "publish": {}}}})
    files = spark.createDataFrame([("svc/api.json", api), ("compose.yml", "image: redis"), ("x.yaml", "a: kafka")], "file_path string, content string")
    entries = spark.createDataFrame([("svc/main.rs",), ("a/main.rs",)], "file_path string")
    assert {(r.channel, r.direction, r.actor) for r in configs.asyncapi_flows(files, entries).collect()} == {("a/b", "publish", "svc/main.rs"), ("c", "publish", "svc/main.rs"), ("c", "subscribe", "svc/main.rs")}
    assert [(r.protocol, r.confidence) for r in orient.brokers(files).collect()] == [("redis", 0.9), ("kafka", 0.75)]
    assert orient.meaning_focus(files, "svc", 1000).count() >= 1 and orient.evidence_window(files).count() == 0


def test_long_files_are_chunked_whole(spark):
    files = spark.createDataFrame([("long.txt", "\n".join(["word " * 200] * 1100))], "file_path string, content string")
    assert files.where(F.octet_length("content") > 1 << 20).count() == 1
    assert max(r.end_line for r in chunking.chunk_files(files).collect()) == 1100


def test_long_texts_are_searched_whole(spark):
    content = "\n".join(["word " * 200] * 2300 + ["the needle"])
    files = spark.createDataFrame([("long.txt", content)], "file_path string, content string")
    assert len(content) > 2_000_000
    assert [(r.n, r.column) for r in lines.literal_search(files, "needle").collect()] == [(2301, 5)]


def test_layer_roles_go_by_whole_names(spark):
    from tessera.functions.paths import layer_role

    wanted = {
        "cli": "Command-line interface", "CMD": "Command-line interface", "bin": "Command-line interface", "api": "API/Server layer", "Server": "API/Server layer",
        "web": "API/Server layer", "core": "Core library", "lib": "Core library", "src": "Core library", "test": "Test suite", "tests": "Test suite",
        "crates": "Workspace crates", "docs": "Documentation", "doc": "Documentation", "src0": "Module", "combined": "Module", "apis": "Module", "": "Module",
    }
    rows = spark.createDataFrame([(n,) for n in wanted], "name string")
    assert {r.name: r.role for r in rows.select("name", layer_role(rows.name).alias("role")).collect()} == wanted


def test_entry_points_contracts_and_boundaries(spark):
    expected = {
        "main.py": (0, False, None, "cli", 0.55), "src/main.py": (1, False, None, "cli", 0.55), "crates/a/src/main.rs": (2, False, None, "cli", 0.55), "cmd/x/main.go": (2, False, None, "cli", 0.55),
        "svc/api/src/app.py": (2, False, None, "http", 0.7), "src/server.py": (1, False, None, "http", 0.7), "a/cli/src/main.rs": (2, False, None, "cli", 0.7), "src/pkg/__init__.py": (4, False, None, "cli", 0.55),
        "data/src/main.py": (None, False, None, None, None), "src0/x.rs": (None, False, None, None, None), "contracts/main.py": (None, True, "contract", None, None), "results/a.proto": (None, False, None, None, None),
        "a/openapi.yaml": (None, True, "openapi", None, None), "a/x.schema.json": (None, True, "jsonschema", None, None), "docs/spec/asyncapi.yml": (None, True, "asyncapi", "event", 1.0),
        "Cargo.toml": (None, False, None, "config", 1.0), ".env.dist": (None, False, None, "env", 1.0), "migrations/1.sql": (None, False, None, "db", 0.85), "a/b.avsc": (None, False, None, "event", 0.9),
        "k8s/x.yaml": (None, False, None, "config", 0.75), "x.yaml": (None, False, None, None, None), None: (None, False, None, None, None),
    }
    files = spark.createDataFrame([(p,) for p in expected], "file_path string")
    classified = orient.classify_files(files)
    assert {r.file_path: tuple(r)[1:] for r in classified.collect()} == expected
    listed = [(r.boundary, r.file_path) for r in orient.ordered_boundaries(classified).collect()]
    assert listed == sorted(listed, key=lambda x: (orient.BOUNDARY_ORDER.index(x[0]), x[1]))
    # of many infrastructure files the most telling ones are boundaries, ties by path
    many = spark.createDataFrame([(f"k8s/{i:02}/service.yaml",) for i in range(20)] + [("charts/z/Chart.yaml",)], "file_path string")
    assert {r.file_path for r in orient.classify_files(many).where("boundary IS NOT NULL").collect()} == {"charts/z/Chart.yaml", *(f"k8s/{i:02}/service.yaml" for i in range(7))}
    assert orient.classify_files(files.limit(0)).count() == 0


def test_blocks_of_queries_meet_every_row_once(spark):
    rows = spark.createDataFrame([(i % 7, f"t{i % 5}") for i in range(40)], "item int, text string")
    asked = spark.createDataFrame([(q,) for q in range(23)], "query_id int")
    for block in (1000, 10, 1):
        met = ranking.against_all(rows, asked, block)
        assert met.columns == ["item", "text", "query_id"]
        assert sorted(map(tuple, met.collect())) == sorted((i % 7, f"t{i % 5}", q) for i in range(40) for q in range(23))
    assert ranking.against_all(rows, asked.limit(0)).count() == 0


def test_memory_rank_equals_brute_force(spark):
    rng = random.Random(5)
    records = [(i // 6, i % 6, rng.choice(["system", "user", "assistant", "tool"]), rng.choice([None, "", "Red fox", "blue dog", "red dog", "owl"])) for i in range(120)]
    asked = {1: ["red", "dog"], 2: ["owl"], 3: ["absent"], 4: [], 5: ["o"]}
    priority = {"system": 0, "assistant": 1, "user": 2}
    expected = set()
    for q, terms in asked.items():
        scored = [(conv, turn, kind, sum(t in (text or "").lower() for t in terms)) for conv, turn, kind, text in records]
        kept = []
        for conv, turn, kind, _ in sorted(scored, key=lambda r: (r[3] == 0, priority.get(r[2], 99), -r[3], -r[1], r[0])):
            if sum(k == kind for *_, k in kept) < 2:
                kept.append((conv, turn, kind))
        expected |= {(q, conv, turn, n + 1) for n, (conv, turn, _) in enumerate(kept[:3])}
    candidates = spark.createDataFrame(records, "conv_id int, turn int, kind string, text string")
    queries = spark.createDataFrame(list(asked.items()), "query_id int, terms array<string>")
    assert {tuple(r) for r in packing.memory_rank(candidates, queries, priority).collect()} == expected


def test_routed_search(spark):
    chunks = spark.createDataFrame(
        [(1, "a/x.rs", "Engine", "fn engine", "function"), (2, "a/x.rs", "run_it", "fn run_it", "function"), (3, "b/y.md", None, "engine words", None)],
        "item long, file_path string, symbol string, content string, chunk_type string",
    ).withColumns({"documented": F.lit(False), "in_context": F.lit(False)})
    embed = vectors.stub_embed(8)
    stored = chunks.select("item", embed(F.col("content")).alias("embedding"))
    asked = spark.createDataFrame([(1, "a/x.rs"), (2, "how does run_it() work"), (3, " Engine "), (4, "engine words")], "query_id long, query string")
    found = routed.routed_search(chunks, stored, asked, embed, profile=BARE).collect()
    assert {(r.query_id, r.item, r.rank, r.route) for r in found if r.query_id < 4} == {(1, 1, 0, "path"), (1, 2, 1, "path"), (2, 2, 0, "anchor"), (3, 1, 0, "symbol")}
    assert {r.route for r in found if r.query_id == 4} == {"ranked"}
    with pytest.raises(Exception, match="empty query"):
        routed.trimmed(spark.createDataFrame([(1, " ")], "query_id int, query string")).collect()


def test_search_by_text(spark):
    embed = vectors.stub_embed(16)
    words = ["search", "store build", "nothing"]
    stored = spark.createDataFrame(list(enumerate(words)), "vec_id int, w string").select("vec_id", embed(F.col("w")).alias("embedding"))
    asked = spark.createDataFrame([(7, "search")], "query_id int, query string")
    # the expansion of a query is what is embedded
    q = np.float32(vectors.stub_vector("search find query lookup retrieve", 16)).astype(float)
    scores = [float(q @ np.float32(vectors.stub_vector(w, 16)).astype(float)) for w in words]
    best = sorted(range(3), key=lambda i: (-scores[i], i))[:2]
    assert [r.item for r in routed.search_by_text(stored, asked, embed, 2).orderBy("rank").collect()] == best


def test_graph_context_and_impact(spark):
    nodes = spark.createDataFrame([("a1", "f"), ("a2", "f"), ("b", "g"), ("c", "h")], "node string, name string")
    edges = spark.createDataFrame([("a2", "b", "Calls"), ("b", "c", "Calls"), ("a1", "c", "Calls")], "src string, dst string, rel string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert {tuple(r) for r in graph.context_nodes(nodes, edges, names("f"), 1).collect()} == {("f", "a2"), ("f", "b")}
    with pytest.raises(Exception, match="unknown symbol nope"):
        graph.context_nodes(nodes, edges, names("nope"), 1).collect()
    place = "start int, file_path string, line int"
    used, hits = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "b", 2)], place), spark.createDataFrame([(1, "a", 1), (1, "c", 3), (1, "d", 4), (2, "z", 9)], place)
    # two places are left for texts; the first occurrence is known already
    assert {tuple(r) for r in graph.usages_with_text(used, hits, 4).collect()} == {(1, "a", 1, "graph"), (1, "b", 2, "graph"), (1, "c", 3, "text"), (2, "z", 9, "text")}
    assert {tuple(r) for r in graph.usages_with_text(used, hits, 1).where("start = 1").collect()} == {(1, "a", 1, "graph")}


def test_doc_store(spark):
    embed = vectors.stub_embed(4)
    store = spark.createDataFrame([("a", "h1", [1.0, 0.0, 0.0, 0.0]), ("gone", "h", [0.0, 1.0, 0.0, 0.0])], "node string, doc_hash string, vector array<float>")
    docs = spark.createDataFrame([("a", "same", "h1"), ("b", "new", "h2")], "node string, doc string, doc_hash string")
    now = graph.update_doc_store(store, docs, embed)
    assert {(r.node, r.reused) for r in now.collect()} == {("a", True), ("b", False)}
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id int, q array<float>")
    assert graph.search_doc_store(now, asked, 1).first().item == "a"


def test_vector_scan(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "item int, file_path string")
    scan = lambda *rows: stores.vector_scan(spark.createDataFrame(list(rows), "item int, embedding array<float>"), chunks, 2)
    assert [(r.item, r.file_path) for r in scan((1, [0.0, 1.0]), (9, [1.0, 1.0])).collect()] == [(1, "a")]
    for broken in ([1.0], None, [1.0, None], [1.0, float("nan")]):
        with pytest.raises(Exception, match="corrupt vector 2"):
            scan((2, broken)).collect()


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "latency_ms long, bytes long, anchor_hit boolean")
    assert tuple(evaluate.run_summary(none).first()) == (0.0, 0, 0, 0.0, 0, 0, 0, 0.0)
    none = spark.createDataFrame([], "baseline_ms double, context_ms double, overlap double, related double")
    assert tuple(evaluate.compare_summary(none).first()) == (0.0, 0.0, 0.0, 0.0)


def test_task_pack(spark):
    rows = [(1, 0, "primary", "b.rs", "run", None, None), (1, 1, "primary", "a.rs", "", None, None), (1, 2, "primary", "b.rs", None, None, None), (1, 3, "related", "c.rs", "use_it", "Calls", 1)]
    pack = spark.createDataFrame(rows, "query_id int, position int, role string, file_path string, symbol string, relation string, distance int")
    assert [r.why for r in actions.task_items(pack).orderBy("position").collect()] == [
        ["Primary match", "Symbol: run"], ["Primary match"], ["Primary match"], ["Related context", "Symbol: use_it", "Relationship: Calls", "Graph distance: 1"],
    ]
    intents = spark.createDataFrame([(1, " fix it "), (2, "other")], "query_id int, query string")
    found = {r.query_id: (r.digest, r.next_files) for r in actions.task_pack(pack, intents).collect()}
    assert found == {1: ("Intent: fix it. Pack: 3 primary / 1 related. Top files: b.rs, a.rs.", ["b.rs", "a.rs"]), 2: ("Intent: other. Pack: 0 primary / 0 related.", [])}
    with pytest.raises(Exception, match="empty query"):
        actions.task_pack(pack, spark.createDataFrame([(1, None)], "query_id int, query string")).collect()


def test_onboarding_pack(spark):
    files = spark.createDataFrame([("README.md", "hello\nworld"), ("docs/a.md", "x" * 50), ("src/m.py", "1\n2\n3")], "file_path string, content string")
    chunks = spark.createDataFrame([("src/m.py", 1, 3), ("docs/a.md", 1, 1)], "file_path string, start_line int, end_line int")
    full = actions.onboarding_pack(chunks, files, ["docs/a.md", "none.md", "README.md"], ["search", "map"])
    assert [d["file_path"] for d in full["docs"]] == ["docs/a.md", "README.md"] and [m["directory"] for m in full["map"]] == ["src", "docs"] and not full["truncated"]
    kept = lambda n: [len((out := actions.onboarding_pack(chunks, files, ["docs/a.md", "README.md"], ["search", "map"], max_chars=n))[k]) for k in ("map", "next_actions", "docs")] + [out["truncated"]]
    size = full["used_chars"]
    assert kept(size) == [2, 2, 2, False] and kept(size - 1) == [1, 2, 2, True]
    lean = len(json.dumps(full | {"map": [], "next_actions": ["search"]}))
    assert kept(lean)[:3] == [0, 1, 2] and kept(lean - 10)[:3] == [0, 1, 1] and kept(110) == [0, 1, 0, True]
    with pytest.raises(ValueError):
        kept(10)


def test_batch(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    known = {"rows": lambda least: table.where(F.col("n") >= least), "echo": lambda x: x, "fail": lambda: 1 / 0}
    items = [
        {"id": " one ", "action": "rows", "payload": {"least": 2}}, {"id": "two", "action": "echo", "payload": {"x": {"$ref": "#/items/one/data/0/s"}}}, {"id": "", "action": "echo"},
        {"id": "one", "action": "echo", "payload": {"x": 1}}, {"id": "in", "action": "batch"}, {"id": "bad", "action": "fail"}, {"id": "what", "action": "nothing"}, {"id": "end", "action": "echo", "payload": {"x": 5}},
    ]
    out = actions.run_batch(items, known)
    assert [(i["id"], i["status"]) for i in out["items"]] == [("one", "ok"), ("two", "ok"), ("", "error"), ("one", "error"), ("in", "error"), ("bad", "error"), ("what", "error"), ("end", "ok")]
    assert out["items"][0]["data"] == [{"n": 2, "s": "b"}] and out["items"][1]["data"] == "b" and out["used_chars"] == len(json.dumps(out, ensure_ascii=False))
    assert len(actions.run_batch(items, known, stop_on_error=True)["items"]) == 3
    short = actions.run_batch(items, known, max_chars=200)
    assert short["truncated"] and len(short["items"]) < 8 and len(json.dumps(short)) <= 200
    with pytest.raises(ValueError):
        actions.run_batch(items, known, max_chars=5)


def test_read_pack(spark):
    intents = {
        "file": {"file": "a.rs"}, "grep": {"pattern": "x", "file": "a.rs"}, "query": {"query": "find words"}, "onboarding": {"query": "how to run it"}, "recall": {"questions": ["", "who calls it"]}, "memory": {},
    }
    assert {name: actions.read_intent(r) for name, r in intents.items()} == {name: name for name in intents}
    assert actions.read_intent({"cursor": packing.encode_cursor({"tool": "rg"}), "query": "x"}) == "grep"
    with pytest.raises(ValueError):
        actions.read_intent({"cursor": packing.encode_cursor({"tool": "ls"})})
    rows = spark.range(100).orderBy("id")
    out = actions.read_pack({"pattern": "x"}, {"grep": lambda _: rows}, 300)
    assert out["intent"] == "grep" and out["truncated"] and [r["id"] for r in out["items"]] == list(range(len(out["items"])))


def test_gates(spark):
    assert actions.freshness_gate(True, [], "fail") == [] and len(actions.freshness_gate(True, ["mtime"], "warn")) == 1
    assert actions.freshness_gate(False, [], "auto", lambda: (True, [])) == []
    for state in ((False, [], "warn"), (True, ["mtime"], "fail"), (False, [], "auto")):
        with pytest.raises(LookupError):
            actions.freshness_gate(*state)
    assert actions.run_within(spark, 60, lambda check: spark.range(5).count()) == 5
    with pytest.raises(TimeoutError):
        actions.run_within(spark, 0.3, lambda check: spark.range(0, 10**12, 1, 4).selectExpr("sum(hash(id))").collect())
    assert spark.range(3).count() == 3


def test_pages_of_hunks(spark):
    text = "\n".join("hit" if n in (3, 4, 12, 20) else f"line {n}" for n in range(1, 21))
    files = spark.createDataFrame([("b", text), ("a", "x\nhit " + "y" * 50), ("c", ""), ("d", None)], "file_path string, content string")
    rows = lambda *a, **k: [tuple(r)[:4] + (r.complete,) for r in lines.grep_page(files, "hit", 1, 1, *a, **k).orderBy("file_path", "first").collect()]
    whole = [("a", 1, 2, 1, True), ("b", 2, 5, 2, True), ("b", 11, 13, 1, True), ("b", 19, 20, 1, True)]
    assert rows() == whole and rows(3) == whole[:2] and rows(200, 3) == whole[:3]
    assert rows(start=("b", 4)) == [("b", 4, 5, 1, True), *whole[2:]] and rows(start=("b", 21)) == []
    first = lines.grep_page(files, "hit", 1, 1, max_chars=20).collect()
    assert [(r.file_path, r.content, r.complete) for r in first] == [("a", "1:  x\n2:* hit yyyyy", False)]
    cut = lines.grep_page(files, "hit", 1, 1, max_chars=85).orderBy("file_path", "first").collect()
    assert [(r.file_path, r.last, r.n_matches, r.complete) for r in cut] == [("a", 2, 1, True), ("b", 3, 1, False)]
    assert lines.grep_page(files.limit(0), "hit", 1, 1).count() == 0


def test_profiles_keep_graphs_and_templates():
    p = load_profile(json.dumps({
        "graph_nodes": {"enabled": False, "weight": 0.5, "top_k": 3, "max_neighbors_per_relation": 2}, "experts": {"graph_nodes": {"default": ["m"]}},
        "embedding": {"max_chars": 100, "query": {"path": "P {text}"}, "document": {"docs": "{path} {text}"}, "graph_node": {"default": "N {text}"}},
    }))
    assert (p.graph_enabled, p.graph_weight, p.graph_top_k, p.graph_neighbors, p.graph_experts, p.max_chars, p.graph_template) == (False, 0.5, 3, 2, ("m",), 100, "N {text}")
    assert (p.query_template("path"), p.query_template("other"), p.document_template("docs"), p.document_template("other")[:5]) == ("P {text}", "Query: {text}", "{path} {text}", "File:")
    for wrong in ({"graph_nodes": {"top": 1}}, {"embedding": {"max_chars": 0}}, {"embedding": {"query": {"path": "{text} {nope}"}}}, {"embedding": {"schema_version": 2}}, {"experts": {"schema_version": 2}}, {"embedding": {"x": 1}}, {"experts": {"x": {}}}):
        with pytest.raises(ValueError):
            load_profile(json.dumps(wrong))


def test_paths_grow_once_for_all_pairs_of_an_end(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(graph, "held", lambda df, name: (written.setdefault(name, []).append(df.count()), df)[1])
    edges = spark.createDataFrame([(f"o{i}", f"c{i % 3}", "Calls", 1.0) for i in range(30)] + [(f"c{i}", "n", "Calls", 0.5) for i in range(3)], "src string, dst string, rel string, weight double")
    pairs = spark.createDataFrame([(f"o{i}", t) for i in range(30) for t in ("n", "x", "y", "z")], "source string, target string")
    found = graph.shortest_paths(edges, pairs, 3, cost="weights").collect()
    assert {(r.source, r.target, r.cost, r.hops, tuple(r.path)) for r in found} == {(f"o{i}", "n", 1, 2, (f"o{i}", f"c{i % 3}", "n")) for i in range(30)}
    assert written["paths"] == [3, 30, 0]


def test_reach_plans_no_hop_twice(spark):
    edges = spark.createDataFrame([("a", "b", "Calls", 1.0), ("b", "c", "Uses", 1.0)], "src string, dst string, rel string, weight double")
    found = graph.reach(edges, spark.createDataFrame([("a",)], "node string"), 3)
    assert {(r.node, r.distance, tuple(r.path)) for r in found.collect()} == {("b", 1, ("Calls",)), ("c", 2, ("Calls", "Uses"))}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "Join" not in plan


def test_topk_leaves_few_rows_to_spark(spark):
    from tessera.operators.vector import vector_topk

    odd = [(100, None), (101, [1.0]), (102, [None, 1.0]), (103, [float("nan"), 1.0])]
    rows = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(60)] + odd, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, q array<float>")
    found = vector_topk(rows, asked, 3)
    best = {q: [r.item for r in found.where(f"query_id = {q}").orderBy("rank").collect()] for q in (1, 2, 3)}
    assert best == {1: [103, 1, 4], 2: [103, 0, 1], 3: []}  # as cosine() has it, nothing that is no number is zero
    many = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(1200)], "query_id long, q array<float>")
    assert {tuple(r) for r in vector_topk(rows.where("vec_id < 100"), many, 2).groupBy("item", "rank").count().collect()} == {(2, 0, 1200), (5, 1, 1200)}
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString() and "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_hashes_side_by_side():
    from tessera.functions.text import fnv1a64, fnv1a64_all

    data = [b"", b"x", *(bytes([i]) * (i * 7 % 90) for i in range(100))]
    assert fnv1a64_all(data).tolist() == [fnv1a64(d) for d in data]
