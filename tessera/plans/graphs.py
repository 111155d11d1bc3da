"""Queries over a graph of orders, customers, nations and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import stub_embed
from tessera.operators import graph
from tessera.plans.base import CHUNK_LINES, LOWERED, files, table
from tessera.plans.chunks import CHUNKS


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders call customers, customers use nations, nations call regions."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c))

    def part(name, a, b, rel, weight):
        return table(spark, sf_dir, name).select(key(*a).alias("src"), key(*b).alias("dst"), F.lit(rel).alias("rel"), F.lit(weight).alias("weight"))

    return (
        part("orders", ("o", "o_orderkey"), ("c", "o_custkey"), "Calls", 1.0).unionByName(part("customer", ("c", "c_custkey"), ("n", "c_nationkey"), "Uses", 0.5))
        .unionByName(part("nation", ("n", "n_nationkey"), ("r", "n_regionkey"), "Calls", 1.0))
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    ids = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    return ids.select("node", F.col("node").alias("name"), F.substring("node", 1, 2).alias("file_path"))


EDGES = """edges AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'Calls' AS rel, 1.0 AS weight FROM orders
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'Uses', 0.5 FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'Calls', 1.0 FROM nation),
  nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)"""


def _of(spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    return nodes(spark, sf_dir).where(F.startswith("node", F.lit(prefix))).select("node")


def graph_callers(spark, sf_dir):
    return graph.neighbours(edges(spark, sf_dir), _of(spark, sf_dir, "c"), forward=False, relation="Calls").distinct()


def graph_callees(spark, sf_dir):
    return graph.neighbours(edges(spark, sf_dir), _of(spark, sf_dir, "o"), relation="Calls")


def graph_usages(spark, sf_dir):
    return graph.neighbours(edges(spark, sf_dir), _of(spark, sf_dir, "n"), forward=False)


def graph_related_depth2(spark, sf_dir):
    found = graph.assemble(nodes(spark, sf_dir), edges(spark, sf_dir), _of(spark, sf_dir, "o"), "extended")
    return found.select("start", "node", F.col("distance").cast("bigint").alias("distance"), F.array_join("path", ">").alias("path"), "relevance")


def graph_transitive_usages(spark, sf_dir):
    found = graph.reach(edges(spark, sf_dir), _of(spark, sf_dir, "n"), 2, forward=False)
    return found.select("start", "node", F.col("distance").cast("bigint").alias("distance"), F.array_join("path", ">").alias("path"))


def graph_shortest_path(spark, sf_dir):
    o, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "region")
    pairs = o.select(F.concat(F.lit("o"), "o_orderkey").alias("source")).crossJoin(F.broadcast(n.select(F.concat(F.lit("r"), "r_regionkey").alias("target"))))  # the five regions
    found = graph.shortest_paths(edges(spark, sf_dir), pairs, 3, cost="weights")
    return found.select("source", "target", "cost", F.col("hops").cast("bigint").alias("hops"), F.array_join("path", ">").alias("path"))


def graph_entry_points(spark, sf_dir):
    return graph.entry_points(nodes(spark, sf_dir), edges(spark, sf_dir)).select("node")


def graph_hotspots(spark, sf_dir):
    return graph.hotspots(edges(spark, sf_dir), 20)


def graph_stats(spark, sf_dir):
    e = edges(spark, sf_dir)
    return nodes(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("nodes")).unionByName(e.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("edges")))


def impact_summary(spark, sf_dir):
    return graph.impact(nodes(spark, sf_dir), edges(spark, sf_dir), _of(spark, sf_dir, "n"), 2)


def graph_docs(spark, sf_dir):
    return graph.graph_docs(nodes(spark, sf_dir), edges(spark, sf_dir), 12).select("node", "doc")


def graph_mermaid(spark, sf_dir):
    return graph.mermaid(edges(spark, sf_dir))


def text_usages(spark, sf_dir):
    from tessera.operators.chunking import chunk_by_lines

    return graph.text_usages(chunk_by_lines(files(spark, sf_dir), CHUNK_LINES), "token").select("file_path", F.col("line").cast("bigint").alias("line"))


def context_nodes(spark, sf_dir):
    """Symbols of all customers with all within two hops."""
    return graph.context_nodes(nodes(spark, sf_dir), edges(spark, sf_dir), _of(spark, sf_dir, "c").withColumnRenamed("node", "name"), 2)


def impact_usages(spark, sf_dir):
    """Customers use their nation at a line of a file, texts do so by their suppliers."""
    used = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("start"), F.col("c_mktsegment").alias("file_path"), F.col("c_custkey").alias("line"))
    hits = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("start"), F.lit("BUILDING").alias("file_path"), F.col("s_suppkey").alias("line"))
    return graph.usages_with_text(used, hits)


def graph_store_update(spark, sf_dir):
    """Documents of all nodes against a store that was built before orders were known."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    embed = stub_embed(16)
    old = graph.graph_docs(n, e.where("src NOT LIKE 'o%'"), 12).select("node", "doc_hash", embed(F.col("doc")).alias("vector"))
    return graph.update_doc_store(old, graph.graph_docs(n, e, 12), embed).select("node", "doc_hash", "reused")


QUERIES = {f.__name__: f for f in (
    context_nodes, impact_usages, graph_store_update,
    graph_callers, graph_callees, graph_usages, graph_related_depth2, graph_transitive_usages, graph_shortest_path, graph_entry_points, graph_hotspots, graph_stats,
    impact_summary, graph_docs, graph_mermaid, text_usages,
)}


def docs_sql(name: str, edges: str) -> str:
    """A named query of the graph documents over the named edges."""
    return f"""{name}_s AS (SELECT DISTINCT src AS node, rel, dst AS other, 'out' AS side FROM {edges} UNION SELECT DISTINCT dst, rel, src, 'in' FROM {edges}),
        {name}_k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node, side, rel ORDER BY other) AS n FROM {name}_s) WHERE n <= 12),
        {name}_l AS (SELECT node, side || ' ' || rel || ': ' || string_agg(other, ', ' ORDER BY other) AS line FROM {name}_k GROUP BY node, side, rel),
        {name}_b AS (SELECT node, string_agg(line, chr(10) ORDER BY line) AS body FROM {name}_l GROUP BY 1),
        {name} AS (SELECT node, 'symbol: ' || node || chr(10) || coalesce(body, '') AS doc FROM nodes LEFT JOIN {name}_b USING (node))"""


ORACLE_SQL = {
    "graph_callers": f"WITH {EDGES} SELECT DISTINCT dst AS start, src AS node, rel FROM edges WHERE rel = 'Calls' AND dst LIKE 'c%'",
    "graph_callees": f"WITH {EDGES} SELECT src AS start, dst AS node, rel FROM edges WHERE rel = 'Calls' AND src LIKE 'o%'",
    "graph_usages": f"WITH {EDGES} SELECT dst AS start, src AS node, rel FROM edges WHERE dst LIKE 'n%'",
    "graph_related_depth2": f"""WITH RECURSIVE {EDGES}, r AS (SELECT node AS start, node, 0::BIGINT AS distance, '' AS path, 0.0::DOUBLE AS w FROM nodes WHERE node LIKE 'o%' UNION ALL
        SELECT r.start, e.dst, r.distance + 1, CASE WHEN r.path = '' THEN e.rel ELSE r.path || '>' || e.rel END, r.w + CASE e.rel WHEN 'Calls' THEN 1.0 ELSE 0.8 END FROM r JOIN edges e ON e.src = r.node WHERE r.distance < 2)
        SELECT start, node, distance, path, round(w / distance / (distance + 1), 6) AS relevance FROM r WHERE distance > 0""",
    "graph_transitive_usages": f"""WITH RECURSIVE {EDGES}, r AS (SELECT node AS start, node, 0::BIGINT AS distance, '' AS path FROM nodes WHERE node LIKE 'n%' UNION ALL
        SELECT r.start, e.src, r.distance + 1, CASE WHEN r.path = '' THEN e.rel ELSE r.path || '>' || e.rel END FROM r JOIN edges e ON e.dst = r.node WHERE r.distance < 2) SELECT DISTINCT start, node, distance, path FROM r WHERE distance > 0""",
    "graph_shortest_path": """SELECT 'o' || o_orderkey AS source, 'r' || n_regionkey AS target, CAST(2 AS BIGINT) AS cost, CAST(3 AS BIGINT) AS hops,
        'o' || o_orderkey || '>c' || c_custkey || '>n' || n_nationkey || '>r' || n_regionkey AS path FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
    "graph_entry_points": f"WITH {EDGES} SELECT node FROM nodes WHERE node NOT IN (SELECT dst FROM edges WHERE rel = 'Calls')",
    "graph_hotspots": f"WITH {EDGES}, d AS (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) SELECT node, count(*) AS degree FROM d GROUP BY 1 ORDER BY degree DESC, node LIMIT 20",
    "graph_stats": f"WITH {EDGES} SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges",
    "impact_summary": f"""WITH {EDGES}, d AS (SELECT DISTINCT dst AS start, src AS node FROM edges WHERE dst LIKE 'n%'), t AS (SELECT DISTINCT d.start, e.src AS node FROM d JOIN edges e ON e.dst = d.node),
        u AS (SELECT start, node, 1 AS distance FROM d UNION ALL SELECT start, node, 2 FROM t), c AS (SELECT start, count(*) FILTER (distance = 1) AS direct, count(*) FILTER (distance = 2) AS transitive, count(DISTINCT node[1:2]) AS files FROM u GROUP BY 1)
        SELECT node AS start, coalesce(direct, 0) AS direct, coalesce(transitive, 0) AS transitive, coalesce(files, 0) AS files FROM nodes LEFT JOIN c ON c.start = node WHERE node LIKE 'n%'""",
    "graph_docs": f"WITH {EDGES}, {docs_sql('docs', 'edges')} SELECT node, doc FROM docs",
    "graph_store_update": f"""WITH {EDGES}, early AS (SELECT * FROM edges WHERE src NOT LIKE 'o%'), {docs_sql('old', 'early')}, {docs_sql('new', 'edges')}
        SELECT node, sha256(new.doc) AS doc_hash, new.doc = old.doc AS reused FROM new JOIN old USING (node)""",
    "context_nodes": """SELECT 'c' || c_custkey AS name, 'c' || c_custkey AS node FROM customer UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
        UNION SELECT 'c' || c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey
        UNION SELECT 'c' || o_custkey, 'c' || o_custkey FROM orders""",
    "impact_usages": f"""WITH d AS (SELECT *, 'graph' AS origin FROM (SELECT DISTINCT c_nationkey AS start, c_mktsegment AS file_path, c_custkey AS line FROM customer) QUALIFY row_number() OVER (PARTITION BY start ORDER BY file_path, line) <= {graph.IMPACT_LIMIT}),
        h AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY line) AS n FROM (SELECT DISTINCT s_nationkey AS start, 'BUILDING' AS file_path, s_suppkey AS line FROM supplier))
        SELECT * FROM d UNION ALL SELECT start, file_path, line, 'text' FROM h LEFT JOIN (SELECT start, count(*) AS used FROM d GROUP BY 1) USING (start)
        WHERE n <= {graph.IMPACT_LIMIT} - coalesce(used, 0) AND NOT EXISTS (SELECT 1 FROM d WHERE d.start = h.start AND d.file_path = h.file_path AND d.line = h.line)""",
    "graph_mermaid": f"WITH {EDGES}, f AS (SELECT * FROM edges ORDER BY src, dst, rel LIMIT 10) SELECT 'graph LR' || chr(10) || string_agg('  ' || src || ' -->|' || rel || '| ' || dst, chr(10) ORDER BY '  ' || src || ' -->|' || rel || '| ' || dst) AS diagram FROM f",
    "text_usages": f"""WITH {CHUNKS}, l AS (SELECT file_path, start_line, {LOWERED.format('content')} AS low FROM chunks WHERE NOT ends_with(file_path, '.md')),
        h AS (SELECT file_path, start_line, regexp_extract(chr(10) || low || ' ', '(?s)^(.*?[^a-z0-9_])token[^a-z0-9_]', 1) AS before FROM l)
        SELECT file_path, start_line + len(string_split(before, chr(10))) - 2 AS line FROM h WHERE before <> '' ORDER BY file_path, line LIMIT 200""",
}
