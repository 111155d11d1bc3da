"""Symbol graphs as two tables: nodes (node, name, ...) and edges (src, dst, rel, weight)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.paths import language_of
from tessera.functions.text import word_position
from tessera.operators.syntax import BRACES, references_of
from tessera.operators.vector import vector_topk
from tessera.sources.work import held

# What a relation counts for relevance, and its rank in orders of paths.
RELEVANCE = {"Calls": 1.0, "Uses": 0.8, "Contains": 0.7, "Extends": 0.6, "Imports": 0.5, "TestedBy": 0.4}
DEPTHS = {"direct": 1, "extended": 2, "deep": 3}
CALL_WEIGHT, USE_WEIGHT = 1.0, 0.5
IMPACT_LIMIT = 200
#: Names and files up to which a report chunks only the files that it looks at.
FILTERED = 200
#: Reverse hops within which tests of a node are looked for.
TEST_HOPS = 3


def build_graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of chunks (file_path, start_line, end_line, content, symbol_name, ...).

    A chunk is a node; what its text calls or names as a type becomes an edge to the last chunk defining that
    name, whatever its file. Parallel and self edges stay; chunks of other languages than Rust, Python, JavaScript and
    TypeScript have none. build_code_graph() does the same from files, without reading nested text again.
    """
    ids = F.concat_ws(":", "file_path", "start_line", "end_line")
    nodes = chunks.select(ids.alias("node"), F.coalesce("symbol_name", F.lit("unknown")).alias("name"), "file_path", "start_line", "end_line", "chunk_type", "content")
    defined = nodes.groupBy("name").agg(F.max_by("node", F.struct("file_path", "start_line")).alias("dst"))

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(node, name, rel) for node, language, text in part.itertuples(index=False) for rel, name, _ in references_of(language, text)]
            yield pd.DataFrame(rows, columns=["node", "name", "rel"])

    source = nodes.select("node", language_of(F.col("file_path")).alias("language"), "content").where(F.col("language").isin(*BRACES, "python"))
    weight = F.when(F.col("rel") == "Calls", F.lit(CALL_WEIGHT)).otherwise(F.lit(USE_WEIGHT))
    named = source.mapInPandas(read, "node string, name string, rel string").withColumn("weight", weight)
    return nodes.drop("content"), named.join(defined, "name").select(F.col("node").alias("src"), "dst", "rel", "weight")


def neighbours(edges: DataFrame, of: DataFrame, forward: bool = True, relation: str | None = None) -> DataFrame:
    """start, node, rel: callees and dependencies of the nodes in `of` (node), or callers and usages."""
    kept = edges.where(F.col("rel") == relation) if relation else edges
    here, there = ("src", "dst") if forward else ("dst", "src")
    return kept.join(of.select(F.col("node").alias(here)), here).select(F.col(here).alias("start"), F.col(there).alias("node"), "rel")


def reach(edges: DataFrame, starts: DataFrame, depth: int, forward: bool = True) -> DataFrame:
    """start, node, distance, path (relations): everything within `depth` hops, at its shortest distance.

    Of equally short paths the first in order of the relations counts. Depths are bounded (1 to 3 in all
    uses), so the joins are unrolled; the frontier is deduplicated before every hop and written after it, so that
    the plan of a hop does not hold those before it.
    """
    here, there = ("src", "dst") if forward else ("dst", "src")
    hops = edges.select(F.col(here).alias("node"), F.col(there).alias("_to"), "rel").distinct()
    frontier = starts.select(F.col("node").alias("start"), "node").distinct().withColumn("distance", F.lit(0)).withColumn("path", F.array().cast("array<string>"))
    seen, out = frontier.select("start", "node"), None
    for _ in range(depth):
        step = frontier.join(hops, "node").select("start", F.col("_to").alias("node"), (F.col("distance") + 1).alias("distance"), F.concat("path", F.array("rel")).alias("path"))
        frontier = held(step.groupBy("start", "node", "distance").agg(F.min("path").alias("path")).join(seen, ["start", "node"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier.select("start", "node"))
        out = frontier if out is None else out.unionByName(frontier)
    return out


def relevance(distance: Column, path: Column) -> Column:
    """Mean weight of the relations of a path, over one more than the distance."""
    weights = F.create_map(*(F.lit(x) for p in RELEVANCE.items() for x in p))
    mean = F.aggregate(F.transform(path, lambda r: F.coalesce(weights[r], F.lit(0.4))), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(path), F.lit(1))
    return mean / (distance + 1)


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int, cost: str = "hops") -> DataFrame:
    """source, target, cost, hops, path (nodes): the cheapest path of at most max_hops edges, ties to the first path in order.

    cost is the number of hops, or with "weights" the sum of the edges' weights cut to integers, none of them negative. Paths grow from
    the distinct ends of that side of the pairs which has fewer, once for all pairs that share one, and meet the pairs at last.
    """
    price = F.lit(1) if cost == "hops" else F.col("weight").cast("int")
    sides = pairs.agg(F.approx_count_distinct("source").alias("source"), F.approx_count_distinct("target").alias("target")).first()
    back = sides.target < sides.source
    start, end, here, there = ("target", "source", "dst", "src") if back else ("source", "target", "src", "dst")
    hops = edges.select(F.col(here).alias("node"), F.col(there).alias("_to"), price.alias("_price")).groupBy("node", "_to").agg(F.min("_price").alias("_price"))
    hops = held(hops, "hops") if max_hops > 1 else hops
    frontier = pairs.select(F.col(start).alias("start")).distinct().select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("cost"), F.array("start").alias("path"))
    found = frontier
    for _ in range(max_hops):
        longer = F.concat(F.array("_to"), "path") if back else F.concat("path", F.array("_to"))
        step = frontier.join(hops, "node").where(~F.array_contains("path", F.col("_to"))).select("start", F.col("_to").alias("node"), (F.col("cost") + F.col("_price")).alias("cost"), longer.alias("path"))
        frontier = held(step.groupBy("start", "node").agg(F.min(F.struct("cost", "path")).alias("b")).select("start", "node", "b.cost", "b.path"), "paths")
        found = found.unionByName(frontier)
    # all paths of a hop are of one length
    best = found.groupBy("start", "node").agg(F.min(F.struct("cost", F.size("path").alias("n"), "path")).alias("b")).select(F.col("start").alias(start), F.col("node").alias(end), "b")
    return best.join(pairs, ["source", "target"], "left_semi").select("source", "target", "b.cost", (F.col("b.n") - 1).alias("hops"), F.col("b.path").alias("path"))


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing calls."""
    return nodes.join(edges.where("rel = 'Calls'").select(F.col("dst").alias("node")), "node", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: in- and out-edges, parallel ones counted each."""
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def hotspots(edges: DataFrame, k: int) -> DataFrame:
    """The k nodes of the largest degree, ties in order of the node."""
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(k)


def graph_docs(nodes: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """node, doc, doc_hash: a text of each node's neighbours, sorted and capped for each direction and relation."""
    names = nodes.select("node", "name")
    sides = None
    for side, here, there in (("out", "src", "dst"), ("in", "dst", "src")):
        own = edges.select(F.col(here).alias("node"), F.col(there).alias("_other"), "rel").join(names.select(F.col("node").alias("_other"), F.col("name").alias("other")), "_other").select("node", "rel", "other", F.lit(side).alias("side"))
        sides = own if sides is None else sides.unionByName(own)
    rank = F.row_number().over(W.partitionBy("node", "side", "rel").orderBy("other"))
    kept = sides.distinct().withColumn("_n", rank).where(F.col("_n") <= cap)
    lines = kept.groupBy("node", "side", "rel").agg(F.array_join(F.array_sort(F.collect_list("other")), ", ").alias("others"))
    body = lines.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("side"), F.lit(" "), F.col("rel"), F.lit(": "), F.col("others")))), "\n").alias("body"))
    doc = F.concat(F.lit("symbol: "), F.col("name"), F.lit("\n"), F.coalesce("body", F.lit("")))
    return names.join(body, "node", "left").select("node", doc.alias("doc"), F.sha2(doc, 256).alias("doc_hash"))


def text_usages(chunks: DataFrame, symbol: str, limit: int = IMPACT_LIMIT) -> DataFrame:
    """file_path, line: the first whole-word occurrence of symbol in each chunk outside Markdown, in order."""
    at = word_position(F.col("content"), symbol)
    before = F.substring("content", F.lit(1), at - 1)
    line = F.col("start_line") + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return chunks.where(~F.col("file_path").rlike(r"\.md$")).where(at > 0).select("file_path", line.alias("line")).orderBy("file_path", "line").limit(limit)


def impact(nodes: DataFrame, edges: DataFrame, of: DataFrame, depth: int) -> DataFrame:
    """start, direct, transitive, files: numbers of direct and further usages and of files they touch."""
    used = reach(edges, of, depth, forward=False).join(nodes.select("node", "file_path"), "node")
    counted = used.groupBy("start").agg(F.count_if(F.col("distance") == 1).alias("direct"), F.count_if(F.col("distance") > 1).alias("transitive"), F.count_distinct("file_path").alias("files"))
    return of.select(F.col("node").alias("start")).join(counted, "start", "left").select("start", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("direct", "transitive", "files")))


def _skipped(name: Column, path: Column) -> Column:
    """Nodes that are no usages: nameless ones and Markdown."""
    return (name == "unknown") | F.lower(path).rlike(r"\.md$")


def word_hits(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """start, file_path, line: the first whole-word occurrence of each name (start, name, node) in each chunk (node, file_path, start_line, content) but its own and Markdown.

    Words of the chunks meet the names by an equi-join, so that only chunks with a name leave their task.
    """
    lines = chunks.where(~F.lower("file_path").rlike(r"\.md$")).select(F.col("node").alias("_chunk"), "file_path", "start_line", F.posexplode(F.split("content", "\n")).alias("_n", "_text"))
    words = lines.select("_chunk", "file_path", (F.col("start_line") + F.col("_n")).alias("line"), F.explode(F.array_distinct(F.split("_text", r"[^A-Za-z0-9_]+"))).alias("name")).where("name <> ''")
    met = words.join(names.select("start", "name", F.col("node").alias("_own")), "name").where("_chunk <> _own")
    return met.groupBy("start", "_chunk", "file_path").agg(F.min("line").alias("line")).select("start", "file_path", "line")


def _looked_at(names: DataFrame, sought: DataFrame) -> Column:
    """Whether a file (file_path, content) is one of those of names (_file), or holds a name of `sought`; all files are, where there are more of either than FILTERED."""
    own, words = (df.select(c).where(F.col(c).isNotNull()).distinct().limit(FILTERED + 1).collect() for df, c in ((names, "_file"), (sought, "name")))
    if max(len(own), len(words)) > FILTERED:
        return F.lit(True)
    holds = F.lit(False)
    for r in words:
        holds = holds | F.contains("content", F.lit(r.name))
    return F.col("file_path").isin([r["_file"] for r in own]) | holds


def impact_report(nodes: DataFrame, edges: DataFrame, chunks: DataFrame | Callable[[Column], DataFrame], of: DataFrame, depth: int = 2, limit: int = IMPACT_LIMIT) -> DataFrame:
    """A row for each node in `of`: start, file_path, line (of its definition), direct, transitive, tests, public, usages, files.

    * nodes: node, name, file_path, start_line; chunks: node, file_path, start_line, content, or a function that gives those of the files
      (file_path, content) that meet a condition, so that only files are chunked whose chunks are looked at: those of the nodes in `of`,
      and those with a name that has places left.
    * direct and transitive list (file_path, line, symbol, rel) in order of file and line, one for each place, `limit` at most; rel of a further
      usage names the relations on the way. Nodes without a name and Markdown are no usages. Places left in direct
      are filled with the first occurrences of the name in other chunks (rel TextMatch), those of known places left out after counting.
    * tests are places (file:line) of tests within three hops, public says whether the definition is, usages and files count direct and transitive.
    """
    info = nodes.select("node", F.col("name").alias("symbol"), "file_path", F.col("start_line").alias("line"))
    place = ["start", "file_path", "line"]
    first = F.row_number().over(W.partitionBy("start").orderBy("file_path", "line"))

    def listed(usages: DataFrame) -> DataFrame:
        """The first places of usages (start, node, rel)."""
        known = usages.join(info, "node").where(~_skipped(F.col("symbol"), F.col("file_path")))
        return known.groupBy(*place).agg(F.min(F.struct("symbol", "rel")).alias("_u")).select(*place, "_u.*").withColumn("_n", first).where(F.col("_n") <= limit).drop("_n")

    direct = held(listed(neighbours(edges, of, forward=False)), "direct")
    names = of.select(F.col("node").alias("start")).join(info.select(F.col("node").alias("start"), F.col("symbol").alias("name"), F.col("file_path").alias("_file"), F.col("line").alias("_line")), "start")
    full = direct.groupBy("start").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= limit).select("start")
    sought = names.join(full, "start", "left_anti")
    if callable(chunks):
        chunks = held(chunks(_looked_at(names, sought)), "chunks")
    hits = usages_with_text(direct, word_hits(chunks, sought.select("start", "name", F.col("start").alias("node"))), limit).where("origin = 'text'")
    direct = direct.unionByName(hits.join(names.select("start", F.col("name").alias("symbol")), "start").select(*place, "symbol", F.lit("TextMatch").alias("rel")))
    used = held(reach(edges, of, max(depth, TEST_HOPS), forward=False), "used")
    further = used.where(F.col("distance").between(2, depth)).select("start", "node", F.array_join("path", " -> ").alias("rel"))
    both = direct.withColumn("_part", F.lit("direct")).unionByName(listed(further).withColumn("_part", F.lit("transitive")))
    usage = F.struct("file_path", "line", "symbol", "rel")
    part = lambda name: F.array_sort(F.collect_list(F.when(F.col("_part") == name, usage))).alias(name)
    lists = both.groupBy("start").agg(part("direct"), part("transitive"), F.count(F.lit(1)).alias("usages"), F.count_distinct("file_path").alias("files"))
    tests = _tests_among(nodes, used.where(F.col("distance") <= TEST_HOPS)).join(info, "node").groupBy("start").agg(F.array_sort(F.collect_set(F.concat_ws(":", "file_path", "line"))).alias("tests"))
    public = public_nodes(nodes, edges, chunks).select(F.col("node").alias("start"), F.lit(True).alias("public"))
    none = "array<struct<file_path:string,line:int,symbol:string,rel:string>>"
    out = names.join(lists, "start", "left").join(tests, "start", "left").join(public, "start", "left")
    return out.select(
        "start", F.col("_file").alias("file_path"), F.col("_line").alias("line"), *(F.coalesce(F.col(c).cast(none), F.array().cast(none)).alias(c) for c in ("direct", "transitive")),
        F.coalesce("tests", F.array().cast("array<string>")).alias("tests"), F.coalesce("public", F.lit(False)).alias("public"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("usages", "files")),
    )


def related_tests(nodes: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    """start, node: nodes within three reverse hops that are tests by their id or name."""
    return _tests_among(nodes, reach(edges, of, TEST_HOPS, forward=False))


def _tests_among(nodes: DataFrame, near: DataFrame) -> DataFrame:
    return near.join(nodes.select("node", "name"), "node").where(F.contains("node", F.lit("test")) | F.startswith("name", F.lit("test_"))).select("start", "node")


def assemble(nodes: DataFrame, edges: DataFrame, of: DataFrame, strategy: str) -> DataFrame:
    """start, node, distance, path, relevance, rank: related nodes in order of relevance, then of the relations on the way."""
    found = reach(edges, of, DEPTHS[strategy]).withColumn("relevance", F.round(relevance(F.col("distance"), F.col("path")), 6))
    place = F.transform("path", lambda r: F.array_position(F.array(*map(F.lit, RELEVANCE)), r))
    rank = F.row_number().over(W.partitionBy("start").orderBy(F.desc("relevance"), "distance", place, "node"))
    return found.join(nodes.select("node"), "node", "left_semi").withColumn("rank", rank)


def public_nodes(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Nodes that are public: used from a test, or with a chunk (node, content) that starts with `pub `."""
    from_tests = edges.where(F.contains("src", F.lit("test"))).select(F.col("dst").alias("node"))
    declared = chunks.where(F.startswith("content", F.lit("pub "))).select("node")
    return nodes.join(from_tests.unionByName(declared).distinct(), "node", "left_semi")


def key_types(nodes: DataFrame, edges: DataFrame, among: int = 20, k: int = 10) -> DataFrame:
    """name, degree: the k names of the largest degree among the first `among` nodes, without tests and nameless ones."""
    top = hotspots(edges, among).join(nodes.select("node", "name"), "node")
    kept = top.where((F.col("name") != "unknown") & ~F.contains(F.lower("node"), F.lit("test")))
    return kept.groupBy("name").agg(F.max("degree").alias("degree")).orderBy(F.desc("degree"), "name").limit(k)


def explain(nodes: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    """start, role, node, rel: definition, dependencies, dependents and tests of the nodes in `of`."""
    own = of.select(F.col("node").alias("start"), F.lit("definition").alias("role"), "node", F.lit(None).cast("string").alias("rel"))
    out = neighbours(edges, of).select("start", F.lit("dependency").alias("role"), "node", "rel")
    back = neighbours(edges, of, forward=False).select("start", F.lit("dependent").alias("role"), "node", "rel")
    tests = related_tests(nodes, edges, of).select("start", F.lit("test").alias("role"), "node", F.lit(None).cast("string").alias("rel"))
    return own.unionByName(out).unionByName(back).unionByName(tests).distinct()


def mermaid(edges: DataFrame, limit: int = 10) -> DataFrame:
    """One row `diagram`: a text graph of the first edges."""
    line = F.concat(F.lit("  "), F.col("src"), F.lit(" -->|"), F.col("rel"), F.lit("| "), F.col("dst"))
    first = edges.orderBy("src", "dst", "rel").limit(limit)
    return first.agg(F.concat(F.lit("graph LR\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("diagram"))


def context_nodes(nodes: DataFrame, edges: DataFrame, names: DataFrame, depth: int) -> DataFrame:
    """name, node: the node of each name (the last one so named) and all within `depth` hops, once each; an unknown name is an error."""
    last = F.row_number().over(W.partitionBy("name").orderBy(F.desc("node")))
    known = nodes.select("name", "node").withColumn("_n", last).where("_n = 1").drop("_n")
    found = names.select("name").distinct().join(known, "name", "left")
    start = F.when(F.col("node").isNull(), F.raise_error(F.concat(F.lit("unknown symbol "), F.coalesce("name", F.lit("null"))))).otherwise(F.col("node"))
    own = found.select("name", start.alias("node"))
    near = reach(edges, own, depth).select(F.col("start").alias("_start"), F.col("node").alias("_to"))
    return own.unionByName(own.join(near, F.col("node") == F.col("_start")).select("name", F.col("_to").alias("node"))).distinct()


def usages_with_text(usages: DataFrame, hits: DataFrame, limit: int = IMPACT_LIMIT) -> DataFrame:
    """start, file_path, line, origin: usages in the graph, then occurrences in texts at other places, `limit` in all.

    As many occurrences are looked at as places are left after the graph's usages, the first in order.
    """
    place = ["file_path", "line"]
    order = F.row_number().over(W.partitionBy("start").orderBy(*place))
    direct = usages.select("start", *place).distinct().withColumn("_n", order).where(F.col("_n") <= limit).drop("_n")
    left = direct.groupBy("start").agg((limit - F.count(F.lit(1))).alias("_left"))
    near = hits.select("start", *place).distinct().withColumn("_n", order).where(F.col("_n") <= limit)
    more = near.join(left, "start", "left").where(F.col("_n") <= F.coalesce("_left", F.lit(limit))).select("start", *place)
    unseen = more.join(direct, ["start", *place], "left_anti")
    return direct.withColumn("origin", F.lit("graph")).unionByName(unseen.withColumn("origin", F.lit("text")))


def update_doc_store(store: DataFrame, docs: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """node, doc_hash, vector, reused: the graph documents (node, doc, doc_hash) with the vectors of `store` (node, doc_hash, vector) where
    neither node nor hash has changed, else embedded anew; nodes that are no more are left out."""
    known = store.select("node", "doc_hash", "vector").dropDuplicates(["node", "doc_hash"])
    kept = docs.join(known, ["node", "doc_hash"]).select("node", "doc_hash", "vector", F.lit(True).alias("reused"))
    fresh = docs.join(known, ["node", "doc_hash"], "left_anti").select("node", "doc_hash", embed(F.col("doc")).alias("vector"), F.lit(False).alias("reused"))
    return kept.unionByName(fresh)


def search_doc_store(store: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, item, score, rank: the nodes whose documents are nearest to each query (query_id, q)."""
    return vector_topk(store.select("node", F.col("vector").alias("embedding")), queries, k, "node")
