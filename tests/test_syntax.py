"""The scanner for Rust, JavaScript and TypeScript, and references in scopes."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import chunking, graph, syntax

RUST = '''//! top
#[derive(Debug)]
pub struct Box<T> { a: Vec<T>, }
/* fn no() { /* nested } */ */
impl<T: Clone> Trait for Box<T> where T: Copy {
    const N: usize = { 3 };
    type Out = Vec<T>;
    /// doc
    pub(crate) async fn get(&self, x: &'static str) -> Option<Box<T>> { let s = r#"fn fake() { "#; let c = '{'; self.foo(); crate::bar(s); println!("{}", 1); Box { a: vec![] } }
    fn other() {}
}
pub mod inner {
    use super::*;

    fn deep() { bar(); }
    mod x;
    mod y { fn deepest() {} }
}
trait Q { fn sig(&self); fn d() {} }
static mut Z: u8 = 1;
const fn cf() -> u8 { 1 }
const K: Foo = Foo { a: 1 };
pub unsafe extern "C" fn ffi(x: u8) { }
struct Unit(u8);
'''
SCRIPT = '''import { a } from "./a";
export class Skipped { m() {} }
class C<T> extends B implements I {
  x = 1;
  private y: Map<string, Foo> = new Map()
  static z;
  static { init(); }
  constructor(private a: string) { super(a); }
  get v(): { a: number } { return `x ${b(`${c("}")}`)} y`; }
  async *gen<T>(q: T): Promise<T> { this.foo(q); if (a) { c(); } }
  sig(): void;
}
function f(a: Foo): Bar { const g = function () { return h(/[/}]{/); }; return new C(a); }
async function g2() {}
function* gen() {}
interface I2 { a(): void }
const enum E { A, B }
const q = class { m() {} };
'''


def test_rust_scopes():
    found = syntax.scopes_of("rust", RUST)
    assert [(s.chunk_type, s.name, s.parent) for s in found] == [
        ("struct", "Box", None), ("const", "N", "Box<T>"), ("impl", "Out", "Box<T>"), ("method", "get", "Box<T>"), ("method", "other", "Box<T>"), ("module", "inner", None), ("function", "deep", None),
        ("module", "x", None), ("module", "y", None), ("function", "deepest", None), ("interface", "Q", None), ("variable", "Z", None), ("function", "cf", None), ("const", "K", None), ("function", "ffi", None), ("struct", "Unit", None),
    ]
    text = [RUST[s.start : s.stop] for s in found]
    assert text[0] == "pub struct Box<T> { a: Vec<T>, }" and text[2] == "type Out = Vec<T>;" and text[3].startswith("pub(crate) async fn get") and text[3].endswith("vec![] } }")
    assert text[5].count("\n") == 6 and text[11] == "static mut Z: u8 = 1;" and text[13] == "const K: Foo = Foo { a: 1 };" and text[15] == "struct Unit(u8);"


def test_script_scopes():
    found = syntax.scopes_of("typescript", SCRIPT)
    assert [(s.chunk_type, s.name, s.parent) for s in found] == [
        *(("variable", n, "C") for n in "xyz"), *(("method", n, "C") for n in ("constructor", "v", "gen")), ("function", "f", None), ("function", "g2", None), ("interface", "I2", None), ("enum", "E", None),
    ]
    text = [SCRIPT[s.start : s.stop] for s in found]
    assert text[:3] == ["x = 1", "private y: Map<string, Foo> = new Map()", "static z"] and text[4].endswith("y`; }") and text[7] == "async function g2() {}" and text[9] == "const enum E { A, B }"


def test_references():
    names = lambda language, text, rel: [n for r, n, _ in syntax.references_of(language, text) if r == rel]
    assert names("rust", RUST, "Calls") == ["foo", "bar", "bar"]
    assert {"Box", "Vec", "Clone", "Copy", "Option", "Foo", "Q", "Unit"} <= set(names("rust", RUST, "Uses"))
    assert names("typescript", SCRIPT, "Calls") == ["init", "b", "c", "foo", "c", "h"]
    assert [n for n in names("typescript", SCRIPT, "Uses") if len(n) > 2] == ["Skipped", "Map", "Foo", "Promise", "Foo", "Bar"]
    assert names("javascript", SCRIPT, "Uses") == []
    assert syntax.references_of("python", "    def f(a: List[int]) -> B:\n        return self.g(h(1))\n") == [("Uses", "List[int]", 9), ("Uses", "B", 23), ("Calls", "g", 37), ("Calls", "h", 44)]
    assert syntax.references_of("python", "def (") == []


@pytest.mark.parametrize("language", ["rust", "javascript", "typescript"])
@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet="{}()[]<>\"'`/*\\;:$#=,.\n fnimplclassmodpub", max_size=60))
def test_any_text_is_read_to_its_end(language, text):
    for s in syntax.scopes_of(language, text):
        assert 0 <= s.start < s.stop <= len(text)
    assert all(text[at : at + len(n)] == n for _, n, at in syntax.references_of(language, text))


def test_chunks_of_braces():
    found = {c["symbol_name"]: c for c in chunking.chunk_source("a/b.rs", "rust", RUST, chunking.ChunkConfig(minimum=1))}
    get = found["get"]
    assert (get["parent_scope"], get["qualified_name"], get["documentation"], get["start_line"], get["end_line"]) == ("Box<T>", "Box<T>::get", "    /// doc", 9, 9)
    assert found["N"]["qualified_name"] == "N" and found["deep"]["documentation"] is None and (found["inner"]["start_line"], found["inner"]["end_line"]) == (12, 18)
    plain = chunking.chunk_source("a/b.ts", "typescript", "const a = 1;\n", chunking.ChunkConfig(minimum=1))
    assert [(c["chunk_type"], c["start_line"], c["end_line"]) for c in plain] == [(None, 1, 1)]


def test_files_deeper_than_the_parser(spark):
    files = spark.createDataFrame([("a.py", "not " * 20_000 + "x\n"), ("b.py", "def f():\n    return g(1, 2) + g(3, 4) + g(5, 6) + g(7, 8)\n")], "file_path string, content string")
    assert {(r.file_path, r.symbol_name) for r in chunking.chunk_files(files).collect()} == {("a.py", None), ("b.py", "f")}
    assert syntax.references_of("python", "f" + "()" * 50_000) == []


def test_graphs_of_chunks(spark):
    columns = "file_path string, start_line int, end_line int, content string, symbol_name string, chunk_type string"
    chunks = [("a.rs", 1, 9, "impl S { fn caller(&self) { self.foo(); } }", "caller", "method"), ("a.rs", 20, 29, "impl S { fn foo(&self) {} }", "foo", "method"), ("b.rs", 1, 2, "fn scoped() { crate::foo(); }", "scoped", "function"), ("c.md", 1, 2, "foo()", None, None)]
    _, edges = graph.build_graph(spark.createDataFrame(chunks, columns))
    assert {tuple(r) for r in edges.collect()} == {("a.rs:1:9", "a.rs:20:29", "Calls", 1.0), ("b.rs:1:2", "a.rs:20:29", "Calls", 1.0)}


def test_innermost_scopes(spark):
    files = spark.createDataFrame([("a.rs", "mod m {\n" + "\n" * 200 + "fn f() { g(); } fn g() {}\n}\nfn h() { f() }"), ("b.rs", ""), ("c.ts", "x()")], "file_path string, content string")
    ends = lambda innermost: {(r.src, r.dst) for r in syntax.build_code_graph(files, innermost)[1].collect()}
    line = "a.rs:202:202"
    assert ends(False) == {("a.rs:1:203", line), (line, line), ("a.rs:204:204", line)}
    assert ends(True) == {(line, line), ("a.rs:204:204", line)}


def test_frequent_names_stay_in_their_tasks(spark, monkeypatch):
    files = spark.createDataFrame([("a.rs", "fn f() { g(); h(); }\nfn k() { g(); g(); }"), ("b.rs", "fn g() {}\nfn h() {}")], "file_path string, content string")
    ends = lambda: sorted((r.src, r.dst) for r in syntax.build_code_graph(files)[1].collect())
    before = ends()
    monkeypatch.setattr(syntax, "OFTEN", 2)
    assert ends() == before == [("a.rs:1:1", "b.rs:1:1"), ("a.rs:1:1", "b.rs:2:2"), ("a.rs:2:2", "b.rs:1:1"), ("a.rs:2:2", "b.rs:1:1")]


def test_chunks_leave_the_worker_in_runs(spark, monkeypatch):
    monkeypatch.setattr(chunking, "OUT_ROWS", 2)
    files = spark.createDataFrame([("a.rs", "\n".join(f"fn f{i}() {{}}" for i in range(7)))], "file_path string, content string")
    assert sorted(r.symbol_name for r in chunking.chunk_files(files).collect()) == [f"f{i}" for i in range(7)]


def test_odd_files_are_chunked():
    """Lines that end in carriage returns, documentation with halves of characters, modules and types of Rust nested deeply, and a script that ends within brackets."""
    config = chunking.ChunkConfig()
    chunks = lambda language, text: chunking.chunk_source("p", language, text, config)
    two = chunks("python", "# a\r\r\ndef f():\r  pass\r\n# b\ndef g():\n  pass\n" + "x = 1\n" * 9)
    assert [(c["symbol_name"], c["start_line"], c["end_line"], c["documentation"]) for c in two] == [("f", 2, 2, "a"), ("g", 4, 5, "b")]
    assert [c["documentation"] for c in chunks("python", 'def f():\n  """a \\ud800 b, long enough for a chunk of its own"""\n')] == ["a ? b, long enough for a chunk of its own"]
    for opening in ("mod a { ", "impl A { "):
        chunks("rust", opening * 1200 + "fn f() { let some = 1; let more = 2; let most = 3; }" + "}" * 1200)
    deep = syntax.scopes_of("rust", "mod a { " * 1200 + "fn f() {}" + "}" * 1200 + " fn g() {}")
    assert len(deep) == 1202 and [s.name for s in deep[-2:]] == ["f", "g"]
    assert len(chunks("typescript", "function f(" * 50)) == 1
    chunks("javascript", "function a(b, c")


def _files(spark):
    rust = "pub enum Red { A }\npub fn open(x: &str) -> Option<Red> { Some(Red::A) }\n"
    rows = [("src/red.rs", rust), *((f"web/c{i}.ts", f"function f{i}(of: Red): number {{ return open(of); }}\n") for i in range(30)), ("doc.ts", "function g() { let a = 'Red'; }\n"), ("other.ts", "function h() { return 1; }\n")]
    return spark.createDataFrame(rows, "file_path string, content string")


def test_scopes_and_references_of_one_reading(spark):
    scopes, references = syntax.code_parts(_files(spark))
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    assert plain(scopes.fillna("")) == plain(syntax.code_scopes(_files(spark)).fillna("")) and plain(references) == plain(syntax.code_references(_files(spark)))


@pytest.mark.parametrize("limit", [5, 200])
def test_report_chunks_the_files_that_it_looks_at(spark, limit, monkeypatch):
    from pyspark.sql import functions as F

    files = _files(spark)
    nodes, edges = syntax.build_code_graph(files)
    chunks = lambda wanted: chunking.chunk_files(files.where(wanted)).select(F.concat_ws(":", "file_path", "start_line", "end_line").alias("node"), "file_path", "start_line", "content")
    read = []
    report = lambda of: sorted(map(str, graph.impact_report(nodes, edges, of, nodes.where("name IN ('Red', 'open')").select("node"), limit=limit).collect()))
    every = report(chunks(F.lit(True)))
    assert report(lambda wanted: (read.append(wanted), chunks(wanted))[1]) == every and len(every) == 2
    looked_at = {r.file_path for r in files.where(read[0]).collect()}
    assert looked_at == ({"src/red.rs"} if limit == 5 else {r.file_path for r in files.collect()} - {"other.ts"})
    monkeypatch.setattr(graph, "FILTERED", 0)
    assert report(lambda wanted: (read.append(wanted), chunks(wanted))[1]) == every and files.where(read[1]).count() == 33
