"""Queries over files and their rules, and over source files written from the tables: regions and nations with their suppliers in Rust, customers with their orders in TypeScript.

The files grow with the tables, and what stands in them is known from the tables, so that SQL gives the same chunks and edges without reading code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunking, graph, syntax
from tessera.plans.base import FILES, files, table
from tessera.sources import ignore
from tessera.sources.work import held

REGION = """pub trait Keeper{r} {
    fn load(&self);
}
pub enum Region{r} { Open, Closed }
pub fn open_{r}(text: &str) -> Option<Region{r}> { Some(Region{r}::Open) }
"""
NATION = """//! Nation {k}
use crate::region_{r}::open_{r};

/// Suppliers of nation {k}
pub struct Nation{k}<'a> {
    name: &'a str, // }
}

impl<'a> Keeper{r} for Nation{k}<'a> {
    const SIZE: usize = { {k} };
    fn load_{k}(&self) -> Option<Region{r}> {
        let text = r#"fn fake() { "} "#; let c = '{'; /* { /* } */ */
        println!("{}", text);
        crate::region_{r}::open_{r}(text)
    }
}

pub mod suppliers_{k} {
    use super::*;
"""
SUPPLIER = "    pub fn supplier_{s}(n: &Nation{k}) -> i64 { n.load_{k}(); 1 }\n"
CUSTOMER = """import { load } from "./nation";
export class Wrapped{c} { run() { return 1; } }
class Customer{c} {
  private balance: number = 1;
  static total(of: Order{c}): string { return `${label("}")} {`; }
}
interface Order{c} { id: number }
"""
ORDER = "function order_{o}(of: Order{c}): number { return Customer{c}.total(of).length + load_{k}(of); }\n"


def _written(text: str, **columns: str) -> Column:
    """The text with columns in the places of their letters."""
    out = F.lit(text)
    for letter, name in columns.items():
        out = F.replace(out, F.lit("{" + letter + "}"), F.col(name).cast("string"))
    return out


def _parts(rows: DataFrame, key: str, line: Column, by: str) -> DataFrame:
    """The lines of each key's rows, in order of `by`, as one text."""
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("by"), line.alias("line")))), lambda x: x["line"]), "").alias("body"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, content: a file for each region, nation and customer; one of a nation or customer is as long as its suppliers or orders."""
    of = lambda name: table(spark, sf_dir, name)
    body = F.coalesce("body", F.lit(""))
    regions = of("region").select(_written("src/region_{r}.rs", r="r_regionkey").alias("file_path"), _written(REGION, r="r_regionkey").alias("content"))
    suppliers = _parts(of("supplier"), "s_nationkey", _written(SUPPLIER, s="s_suppkey", k="s_nationkey"), "s_suppkey")
    nations = of("nation").join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(
        _written("src/nation_{k}.rs", k="n_nationkey").alias("file_path"), F.concat(_written(NATION, k="n_nationkey", r="n_regionkey"), body, F.lit("}\n")).alias("content")
    )
    customer = of("customer").select("c_custkey", "c_nationkey")
    orders = _parts(of("orders").join(customer, F.col("o_custkey") == F.col("c_custkey")), "c_custkey", _written(ORDER, o="o_orderkey", c="c_custkey", k="c_nationkey"), "o_orderkey")
    customers = customer.join(orders, "c_custkey", "left").select(_written("web/customer_{c}.ts", c="c_custkey").alias("file_path"), F.concat(_written(CUSTOMER, c="c_custkey"), body).alias("content"))
    return regions.unionByName(nations).unionByName(customers)


def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed chunks of all those files."""
    found = chunking.chunk_files(code_files(spark, sf_dir))
    line = lambda c: F.col(c).cast("bigint").alias(c)
    return found.select("file_path", "chunk_type", "symbol_name", "parent_scope", "qualified_name", "documentation", line("start_line"), line("end_line"))


def _edges(spark: SparkSession, sf_dir: str, innermost: bool) -> DataFrame:
    _, edges = syntax.build_code_graph(code_files(spark, sf_dir), innermost)
    return edges.groupBy("src", "dst", "rel").agg(F.count(F.lit(1)).alias("n"))


def code_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and uses among the scopes of all those files; a module has those of its functions too."""
    return _edges(spark, sf_dir, False)


def code_graph_innermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the innermost scopes."""
    return _edges(spark, sf_dir, True)


def impact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usages of all regions and of the methods of all nations, with their digests."""
    written = held(code_files(spark, sf_dir), "code-files")
    nodes, edges = syntax.build_code_graph(written)
    nodes, edges = held(nodes, "code-nodes"), held(edges, "code-edges")
    chunks = lambda wanted: chunking.chunk_files(written.where(wanted)).select(F.concat_ws(":", "file_path", "start_line", "end_line").alias("node"), "file_path", "start_line", "content")
    of = nodes.where("name LIKE 'Region%' OR name LIKE 'load_%'").select("node")
    found = graph.impact_report(nodes, edges, chunks, of)
    shown = lambda c: F.sha2(F.array_join(F.transform(c, lambda u: F.concat_ws(":", u["file_path"], u["line"], u["symbol"], u["rel"])), ","), 256).alias(c)
    return found.select("start", F.col("line").cast("bigint").alias("line"), F.size("direct").cast("bigint").alias("n_direct"), F.size("transitive").cast("bigint").alias("n_transitive"), shown("direct"), shown("transitive"), F.size("tests").cast("bigint").alias("n_tests"), "public", "usages", "files")


ROOT_RULES = """# what is made anew
*.yaml
!doc_*5.yaml
/src1/en/
**/es/doc_*7.rs
src2/**/doc_1*.py

doc_[0-3]?.md
"""
SOURCE_RULES = "fr/*  \n!fr/doc_*3.py\n!doc_2?.md\n"


def ignored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files that rules at the root and in the directory of each source leave."""
    named = files(spark, sf_dir)
    nested = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.concat("source", F.lit("/.gitignore")).alias("file_path"), F.lit(SOURCE_RULES).alias("content")).distinct()
    rules = ignore.ignore_rules(nested.unionByName(spark.createDataFrame([(".gitignore", ROOT_RULES)], nested.schema)))
    return ignore.drop_ignored(named.select("doc_id", "file_path"), rules).select("doc_id", "file_path")


QUERIES = {f.__name__: f for f in (code_chunks, code_graph, code_graph_innermost, impact_report, ignored_files)}

#: What the files hold, from the tables: file, type, name, parent, qualified name, documentation, lines.
_SCOPES = """s AS (
  SELECT 'src/region_' || r_regionkey || '.rs' AS file_path, 'interface' AS chunk_type, 'Keeper' || r_regionkey AS symbol_name, NULL AS parent_scope, 'Keeper' || r_regionkey AS qualified_name, NULL AS documentation, 1 AS start_line, 3 AS end_line FROM region
  UNION ALL SELECT 'src/region_' || r_regionkey || '.rs', 'enum', 'Region' || r_regionkey, NULL, 'Region' || r_regionkey, NULL, 4, 4 FROM region
  UNION ALL SELECT 'src/region_' || r_regionkey || '.rs', 'function', 'open_' || r_regionkey, NULL, 'open_' || r_regionkey, NULL, 5, 5 FROM region
  UNION ALL SELECT 'src/nation_' || n_nationkey || '.rs', 'struct', 'Nation' || n_nationkey, NULL, 'Nation' || n_nationkey, '/// Suppliers of nation ' || n_nationkey, 5, 7 FROM nation
  UNION ALL SELECT 'src/nation_' || n_nationkey || '.rs', 'const', 'SIZE', 'Nation' || n_nationkey || '<''a>', 'SIZE', NULL, 10, 10 FROM nation
  UNION ALL SELECT 'src/nation_' || n_nationkey || '.rs', 'method', 'load_' || n_nationkey, 'Nation' || n_nationkey || '<''a>', 'Nation' || n_nationkey || '<''a>::load_' || n_nationkey, NULL, 11, 15 FROM nation
  UNION ALL SELECT 'src/nation_' || n_nationkey || '.rs', 'module', 'suppliers_' || n_nationkey, NULL, 'suppliers_' || n_nationkey, NULL, 18, 20 + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) FROM nation
  UNION ALL SELECT 'src/nation_' || s_nationkey || '.rs', 'function', 'supplier_' || s_suppkey, NULL, 'supplier_' || s_suppkey, NULL, 19 + n, 19 + n FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)
  UNION ALL SELECT 'web/customer_' || c_custkey || '.ts', 'variable', 'balance', 'Customer' || c_custkey, 'balance', NULL, 4, 4 FROM customer
  UNION ALL SELECT 'web/customer_' || c_custkey || '.ts', 'method', 'total', 'Customer' || c_custkey, 'total', NULL, 5, 5 FROM customer
  UNION ALL SELECT 'web/customer_' || c_custkey || '.ts', 'interface', 'Order' || c_custkey, NULL, 'Order' || c_custkey, NULL, 7, 7 FROM customer
  UNION ALL SELECT 'web/customer_' || c_custkey || '.ts', 'function', 'order_' || o_orderkey, NULL, 'order_' || o_orderkey, NULL, 7 + n, 7 + n
    FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS n FROM orders JOIN customer ON c_custkey = o_custkey)
)"""
#: Names of both ends, relation and number of references; a module repeats those of its functions.
_NAMED = """e AS (
  SELECT 'Keeper' || r_regionkey AS a, 'Keeper' || r_regionkey AS b, 'Uses' AS rel, 1 AS n, true AS inner_too FROM region
  UNION ALL SELECT 'Region' || r_regionkey, 'Region' || r_regionkey, 'Uses', 1, true FROM region
  UNION ALL SELECT 'open_' || r_regionkey, 'Region' || r_regionkey, 'Uses', 1, true FROM region
  UNION ALL SELECT 'Nation' || n_nationkey, 'Nation' || n_nationkey, 'Uses', 1, true FROM nation
  UNION ALL SELECT 'load_' || n_nationkey, 'Region' || n_regionkey, 'Uses', 1, true FROM nation
  UNION ALL SELECT 'load_' || n_nationkey, 'open_' || n_regionkey, 'Calls', 1, true FROM nation
  UNION ALL SELECT 'supplier_' || s_suppkey, 'Nation' || s_nationkey, 'Uses', 1, true FROM supplier
  UNION ALL SELECT 'supplier_' || s_suppkey, 'load_' || s_nationkey, 'Calls', 1, true FROM supplier
  UNION ALL SELECT 'suppliers_' || s_nationkey, 'Nation' || s_nationkey, 'Uses', count(*), false FROM supplier GROUP BY s_nationkey
  UNION ALL SELECT 'suppliers_' || s_nationkey, 'load_' || s_nationkey, 'Calls', count(*), false FROM supplier GROUP BY s_nationkey
  UNION ALL SELECT 'Order' || c_custkey, 'Order' || c_custkey, 'Uses', 1, true FROM customer
  UNION ALL SELECT 'order_' || o_orderkey, 'Order' || c_custkey, 'Uses', 1, true FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'order_' || o_orderkey, 'total', 'Calls', 1, true FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'order_' || o_orderkey, 'load_' || c_nationkey, 'Calls', 1, true FROM orders JOIN customer ON c_custkey = o_custkey
), i AS (SELECT symbol_name AS name, max_by(file_path || ':' || start_line || ':' || end_line, file_path) AS id FROM s GROUP BY 1)"""
#: Members named `total` stand in each customer's file and use its interface; the name stands for the last of them.
_TOTALS = "SELECT file_path || ':5:5' AS src, file_path || ':7:7' AS dst, 'Uses' AS rel, 1 AS n FROM s WHERE symbol_name = 'total'"

#: Usages by the tables: suppliers, modules and orders call a nation's method, which uses its region; places in order, the first 200.
_IMPACT = """l AS (
  SELECT n_nationkey AS k, n_regionkey AS r, 'src/nation_' || n_nationkey || '.rs' AS file_path, 18 AS line, 'suppliers_' || n_nationkey AS symbol FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
  UNION ALL SELECT n_nationkey, n_regionkey, 'src/nation_' || n_nationkey || '.rs', 19 + row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey), 'supplier_' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT n_nationkey, n_regionkey, 'web/customer_' || c_custkey || '.ts', 7 + row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey), 'order_' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
), u AS (
  SELECT 'src/nation_' || k || '.rs:11:15' AS start, 'direct' AS part, file_path, line, symbol, 'Calls' AS rel FROM l
  UNION ALL SELECT 'src/region_' || r || '.rs:4:4', 'transitive', file_path, line, symbol, 'Uses -> Calls' FROM l
  UNION ALL SELECT 'src/region_' || n_regionkey || '.rs:4:4', 'direct', 'src/nation_' || n_nationkey || '.rs', 11, 'load_' || n_nationkey, 'Uses' FROM nation
  UNION ALL SELECT 'src/region_' || r_regionkey || '.rs:4:4', 'direct', 'src/region_' || r_regionkey || '.rs', 4, 'Region' || r_regionkey, 'Uses' FROM region
  UNION ALL SELECT 'src/region_' || r_regionkey || '.rs:4:4', 'direct', 'src/region_' || r_regionkey || '.rs', 5, 'open_' || r_regionkey, 'Uses' FROM region
), c AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY start, part ORDER BY file_path, line) <= 200),
a AS (
  SELECT start, count(*) FILTER (part = 'direct') AS n_direct, count(*) FILTER (part = 'transitive') AS n_transitive, count(*) AS usages, count(DISTINCT file_path) AS files,
         string_agg(file_path || ':' || line || ':' || symbol || ':' || rel, ',' ORDER BY file_path, line) FILTER (part = 'direct') AS direct, string_agg(file_path || ':' || line || ':' || symbol || ':' || rel, ',' ORDER BY file_path, line) FILTER (part = 'transitive') AS transitive
  FROM c GROUP BY start
), d AS (SELECT 'src/nation_' || n_nationkey || '.rs:11:15' AS start, 11 AS line, false AS public FROM nation UNION ALL SELECT 'src/region_' || r_regionkey || '.rs:4:4', 4, true FROM region)
SELECT start, line::BIGINT AS line, coalesce(n_direct, 0) AS n_direct, coalesce(n_transitive, 0) AS n_transitive, sha256(coalesce(direct, '')) AS direct, sha256(coalesce(transitive, '')) AS transitive, 0::BIGINT AS n_tests, public, coalesce(usages, 0) AS usages, coalesce(files, 0) AS files
FROM d LEFT JOIN a USING (start)"""

ORACLE_SQL = {
    "impact_report": f"WITH {_IMPACT}",
    # rules from the last to the first; a directory that is ignored comes before all of them
    "ignored_files": f"""WITH {FILES}, f AS (SELECT files.doc_id, files.file_path, coalesce(source, '') AS source, coalesce(lang, '') AS lang, regexp_extract(files.file_path, '[^/]*$') AS name FROM files JOIN documents USING (doc_id))
        SELECT doc_id, file_path FROM f WHERE NOT CASE
          WHEN source = 'src1' AND lang = 'en' THEN true
          WHEN source <> '' AND regexp_matches(name, '^doc_2.[.]md$') THEN false
          WHEN source <> '' AND lang = 'fr' THEN NOT regexp_matches(name, '^doc_.*3[.]py$')
          WHEN regexp_matches(name, '^doc_[0-3].[.]md$') THEN true
          WHEN source = 'src2' AND regexp_matches(name, '^doc_1.*[.]py$') THEN true
          WHEN lang = 'es' AND regexp_matches(name, '^doc_.*7[.]rs$') THEN true
          WHEN regexp_matches(name, '^doc_.*5[.]yaml$') THEN false
          ELSE ends_with(name, '.yaml') END""",
    "code_chunks": f"WITH {_SCOPES} SELECT * FROM s",
    **{
        name: f"WITH {_SCOPES}, {_NAMED} SELECT x.id AS src, y.id AS dst, rel, n FROM e JOIN i x ON x.name = a JOIN i y ON y.name = b {where} UNION ALL {_TOTALS}"
        for name, where in (("code_graph", ""), ("code_graph_innermost", "WHERE inner_too"))
    },
}
