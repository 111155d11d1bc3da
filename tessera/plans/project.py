"""Queries over files of builds and services written from the tables: contracts of nations with their suppliers, entry points, and build files of customers with their orders.

What stands in the files is known from the tables, so that SQL gives the same rows without reading them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import configs, packs
from tessera.plans.base import table
from tessera.plans.code import _parts, _written

YAML = "# contract of {k}\nasyncapi: '2.6.0'\ninfo: {\"title\": \"channels: none\"}\nservers:\n  first:\n    url: mq:9092 # {k}\n    protocol: \"{p}\"\n  second: {\"protocol\": \"other\"}\nchannels:\n"
CHANNEL = "  \"supplier/{s}\":\n    description: |\n      publish:\n        none\n{b}"
SIDE = "    {d}:\n      message:\n        tags:\n        - name: x\n        - subscribe\n"
JSON = '{"asyncapi": "2.6.0", "servers": {"b": {"protocol": "other"}, "a": {"protocol": "{p}"}}, "channels": {{c}}}'
PROTOCOLS = ("Kafka", "amqp", "nats", "mqtt")
# lines of a script of commands, of a makefile and names of scripts; an order takes that of its key
COMMANDS = (
    "      - uses: actions/checkout@v4", "# cargo run", "  - run: cargo build --release", "$ pytest -q", "words of a customer", "python3 tool.py", "./recheck.sh", "run: ruff .",
    "npx prettier -w .", "make check", "uses: own/deploy@v1", "python tool/bench.py", "criterion evaluate", "npm install",
)
TARGETS = ("build:", "test-unit: build", "\tcargo test --all", "my target: x", "fmt:", "smoke-all:", "bench :", ".PHONY: all", "dev:", "# lint:", "dev: again")
SCRIPTS = ("build", "start", "pretest", "test:ci", "gate", "lint", "format", "eval-all", "prepare")


def _pick(values: tuple[str, ...], key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _sides(line) -> Column:
    """What `line` makes of the directions of a supplier."""
    return F.concat(F.when(F.col("s_suppkey") % 2 == 0, line("publish")).otherwise(""), F.when(F.col("s_suppkey") % 3 == 0, line("subscribe")).otherwise(""))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, content: a contract for each nation with suppliers, in YAML for an even one, else in JSON."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").where("s_nationkey IS NOT NULL")
    yaml = suppliers.withColumn("b", _sides(lambda d: F.lit(SIDE.replace("{d}", d))))
    yaml = _parts(yaml, "s_nationkey", _written(CHANNEL, s="s_suppkey", b="b"), "s_suppkey")
    sides = F.array_join(F.filter(F.array(F.when(F.col("s_suppkey") % 2 == 0, F.lit('"publish": {}')), F.when(F.col("s_suppkey") % 3 == 0, F.lit('"subscribe": null'))), lambda x: x.isNotNull()), ", ")
    entry = F.concat(F.lit('"supplier/'), F.col("s_suppkey").cast("string"), F.lit('": {'), sides, F.lit("}"))
    json = suppliers.groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list(entry)), ", ").alias("c"))
    met = table(spark, sf_dir, "nation").join(yaml, F.col("n_nationkey") == F.col("s_nationkey")).drop("s_nationkey").join(json, F.col("n_nationkey") == F.col("s_nationkey"))
    met = met.withColumn("p", _pick(PROTOCOLS, "n_nationkey"))
    even = F.col("n_nationkey") % 2 == 0
    path = _written("r_{r}/svc_{k}/asyncapi.{e}", r="n_regionkey", k="n_nationkey", e="e")
    content = F.when(even, F.concat(_written(YAML, k="n_nationkey", p="p"), F.col("body"))).otherwise(_written(JSON, p="p", c="c"))
    return met.withColumn("e", F.when(even, "yaml").otherwise("json")).select(path.alias("file_path"), content.alias("content"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path: an entry point for all nations but every fourth."""
    return table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 3").select(_written("r_{r}/svc_{k}/src/main.rs", r="n_regionkey", k="n_nationkey").alias("file_path"))


def asyncapi_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configs.asyncapi_flows(contracts(spark, sf_dir), entries(spark, sf_dir))


def config_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries contracts have of each sort of key, numbers of suppliers and items left out of the keys."""
    found = configs.config_entries(contracts(spark, sf_dir))
    shape = F.regexp_replace(F.array_join("keys", "."), r"supplier/\d+", "supplier")
    return found.groupBy("file_path", shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"))


def build_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, content: a workflow, makefile or package.json for each customer with orders, a line or script for each order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").where("o_custkey IS NOT NULL")
    form = F.col("o_custkey") % 3
    line = F.when(form == 0, _pick(COMMANDS, "o_orderkey")).when(form == 1, _pick(TARGETS, "o_orderkey")).otherwise(F.concat(F.lit('"'), _pick(SCRIPTS, "o_orderkey"), F.lit('": "x"')))
    body = orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]).alias("_l"))
    name = F.when(form == 0, "ci.yml").when(form == 1, "Makefile").otherwise("package.json")
    content = F.when(form == 2, F.concat(F.lit('{"scripts": {'), F.array_join(F.array_distinct("_l"), ", "), F.lit("}}"))).otherwise(F.array_join("_l", "\n"))
    return body.select(F.concat(F.lit("c_"), F.col("o_custkey").cast("string"), F.lit("/"), name).alias("file_path"), content.alias("content"))


def pipeline_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configs.pipeline_steps(build_files(spark, sf_dir)).withColumn("n", F.col("n").cast("bigint"))


def orientation_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack of all these files."""
    mains = entries(spark, sf_dir).withColumn("content", F.lit("fn main() {}\n"))
    return packs.orientation_pack(contracts(spark, sf_dir).unionByName(mains).unionByName(build_files(spark, sf_dir)), "contracts of nations", 3000, "tables")


def pack_shrinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack for each customer, with a claim for each order, within 330 characters."""
    o = F.col("o_orderkey")
    of = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    pack = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    tag = of([t for t, _ in PACK_TAGS], o % len(PACK_TAGS))
    turn = F.floor(o / len(PACK_TAGS))
    kind = F.when(tag == "STEP", of(("setup", "test", "odd", "run"), turn % 4)).when(tag == "CONTRACT", of(("openapi", "proto", "contract"), turn % 3)).when(tag == "ANCHOR", of(("canon", "contract", "infra"), turn % 3)).otherwise("x")
    file = of(PACK_FILES, o % len(PACK_FILES))
    part = lambda name, value, coded: F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(coded).alias("coded"))
    orders = table(spark, sf_dir, "orders").where("o_custkey IS NOT NULL")
    claims = orders.select(pack("o_custkey").alias("pack_id"), of([s for _, s in PACK_TAGS], o % len(PACK_TAGS)).alias("section"), o.alias("place"), tag.alias("tag"), kind.alias("kind"), file.alias("file"), F.array(part("kind", kind, False), part("file", file, True)).alias("parts"))
    heads = table(spark, sf_dir, "customer").select(pack("c_custkey").alias("pack_id"), F.lit("r").alias("root"), F.lit("q").alias("query"))
    proofs = F.array(*(F.struct(F.lit(f).alias("file"), F.lit(i).alias("place")) for i, f in enumerate(PACK_FILES[:-1])))
    evidence = heads.select("pack_id", F.explode(proofs).alias("e")).select("pack_id", "e.file", F.lit("x").alias("kind"), F.lit(1).alias("first"), (F.col("e.place") + 10).alias("last"), F.lit(None).cast("string").alias("sha256"), "e.place")
    return packs.shrink_packs(heads, claims, evidence, 330)


PACK_TAGS = (("ANCHOR", "ANCHORS"), ("STEP", "CANON"), ("BOUNDARY", "BOUNDARIES"), ("AREA", "MAP"), ("MAP", "MAP"), ("ENTRY", "ENTRYPOINTS"), ("CONTRACT", "CONTRACTS"), ("FLOW", "FLOWS"), ("BROKER", "BROKERS"))
PACK_FILES = ("f0.md", "f1.rs", "f2/README.md", "f3.json", "f4.toml")

QUERIES = {f.__name__: f for f in (asyncapi_flows, config_entries, pipeline_steps, orientation_pack, pack_shrinking)}

_OWN = "SELECT n_nationkey AS k, n_regionkey AS r, 'r_' || n_regionkey || '/svc_' || n_nationkey AS dir FROM nation"
_SIDES = "s_suppkey % 2 = 0 AND d = 'publish' OR s_suppkey % 3 = 0 AND d = 'subscribe'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


# place of an order's line, and the step that it is, worked out by hand
_SAID = ((0, "setup", "uses actions/checkout@v4", 0.7), (2, "build", "cargo build --release", 0.75), (3, "test", "pytest -q", 0.75), (5, "run", "python3 tool.py", 0.75), (7, "lint", "ruff .", 0.75),
         (8, "format", "npx prettier -w .", 0.75), (9, "test", "make check", 0.75), (11, "run", "python tool/bench.py", 0.75), (12, "eval", "criterion evaluate", 0.75), (13, "setup", "npm install", 0.75))
_MADE = ((0, "build", "build"), (1, "test", "test-unit"), (4, "format", "fmt"), (5, "test", "smoke-all"), (6, "eval", "bench"), (8, "run", "dev"), (10, "run", "dev"))
_NAMED = ((0, "build", "build"), (1, "run", "start"), (3, "test", "test:ci"), (4, "test", "gate"), (5, "lint", "lint"), (6, "format", "format"), (7, "eval", "eval-all"))

ORACLE_SQL = {
    "asyncapi_flows": f"""WITH o AS ({_OWN}), a AS (SELECT dir, r FROM o WHERE k % 4 <> 3),
        c AS (SELECT s_nationkey AS k, s_suppkey, 'supplier/' || s_suppkey AS channel FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY channel) <= 10)
        SELECT o.dir || '/asyncapi.' || CASE WHEN k % 2 = 0 THEN 'yaml' ELSE 'json' END AS file_path, channel, d AS direction, CASE k % 4 WHEN 0 THEN 'kafka' WHEN 1 THEN 'amqp' WHEN 2 THEN 'nats' ELSE 'mqtt' END AS protocol,
          coalesce(CASE WHEN k % 4 <> 3 THEN o.dir END, (SELECT min(dir || '/src/main.rs') FROM a WHERE a.r = o.r)[:-13]) || '/src/main.rs' AS actor
        FROM c JOIN o USING (k), (VALUES ('publish'), ('subscribe')) v(d) WHERE {_SIDES}""",
    "config_entries": f"""WITH o AS ({_OWN} WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)), p AS (SELECT *, dir || '/asyncapi.' || CASE WHEN k % 2 = 0 THEN 'yaml' ELSE 'json' END AS file_path,
          CASE k % 4 WHEN 0 THEN 'Kafka' WHEN 1 THEN 'amqp' WHEN 2 THEN 'nats' ELSE 'mqtt' END AS protocol FROM o),
        s AS (SELECT file_path, k, d FROM p JOIN supplier ON s_nationkey = k, (VALUES ('publish'), ('subscribe')) v(d) WHERE {_SIDES}),
        r AS (SELECT file_path, unnest(['asyncapi', 'info', 'info.title', 'servers', 'servers.first', 'servers.first.url', 'servers.first.protocol', 'servers.second', 'servers.second.protocol', 'channels']) AS shape,
            unnest(['2.6.0', NULL, 'channels: none', NULL, NULL, 'mq:9092', protocol, NULL, 'other', NULL]) AS value FROM p WHERE k % 2 = 0
          UNION ALL SELECT file_path, unnest(['asyncapi', 'servers', 'servers.a', 'servers.a.protocol', 'servers.b', 'servers.b.protocol', 'channels']), unnest(['2.6.0', NULL, NULL, protocol, NULL, 'other', NULL]) FROM p WHERE k % 2 = 1
          UNION ALL SELECT file_path, unnest(CASE WHEN k % 2 = 0 THEN ['channels.supplier', 'channels.supplier.description'] ELSE ['channels.supplier'] END), unnest(CASE WHEN k % 2 = 0 THEN [NULL, 'publish:' || chr(10) || 'none'] ELSE [NULL] END)
            FROM p JOIN supplier ON s_nationkey = k
          UNION ALL SELECT file_path, 'channels.supplier.' || d || unnest(CASE WHEN k % 2 = 0 THEN ['', '.message', '.message.tags', '.message.tags.0', '.message.tags.0.name', '.message.tags.1'] ELSE [''] END),
            unnest(CASE WHEN k % 2 = 0 THEN [NULL, NULL, NULL, NULL, 'x', 'subscribe'] ELSE [NULL] END) FROM s)
        SELECT file_path, shape, count(*) AS n, max(value) AS value FROM r GROUP BY file_path, shape""",
    "pipeline_steps": f"""WITH l AS (SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_custkey IS NOT NULL),
        said(i, kind, label, confidence) AS (VALUES {_values(_SAID)}), made(i, kind, label) AS (VALUES {_values(_MADE)}), named(i, kind, label) AS (VALUES {_values(_NAMED)}),
        f AS (SELECT c, n, kind, label, confidence FROM l JOIN said ON o % {len(COMMANDS)} = i WHERE c % 3 = 0 QUALIFY row_number() OVER (PARTITION BY c, kind ORDER BY n) = 1)
        SELECT 'c_' || c || '/ci.yml' AS file_path, n, kind, label, confidence::DOUBLE AS confidence FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY c ORDER BY n) <= {configs.MAX_STEPS})
        UNION ALL SELECT 'c_' || c || '/Makefile', min(n), kind, 'make ' || label, 0.9::DOUBLE FROM l JOIN made ON o % {len(TARGETS)} = i WHERE c % 3 = 1 GROUP BY c, kind, label
        UNION ALL SELECT DISTINCT 'c_' || c || '/package.json', NULL::BIGINT, kind, 'npm run ' || label, 0.85::DOUBLE FROM l JOIN named ON o % {len(SCRIPTS)} = i WHERE c % 3 = 2""",
    "pack_shrinking": """WITH cl AS (SELECT 'c' || o_custkey AS p, o_orderkey AS o, ['ANCHOR', 'STEP', 'BOUNDARY', 'AREA', 'MAP', 'ENTRY', 'CONTRACT', 'FLOW', 'BROKER'][o_orderkey % 9 + 1] AS tag,
          [1, 2, 3, 4, 4, 6, 7, 8, 9][o_orderkey % 9 + 1] AS sec, o_orderkey // 9 AS turn, o_orderkey % 5 AS f FROM orders WHERE o_custkey IS NOT NULL),
        ck AS (SELECT *, CASE tag WHEN 'STEP' THEN ['setup', 'test', 'odd', 'run'][turn % 4 + 1] WHEN 'CONTRACT' THEN ['openapi', 'proto', 'contract'][turn % 3 + 1] WHEN 'ANCHOR' THEN ['canon', 'contract', 'infra'][turn % 3 + 1] ELSE 'x' END AS kind
          FROM cl SEMI JOIN (SELECT 'c' || c_custkey AS p FROM customer) USING (p) WHERE f < 4 OR tag NOT IN ('BOUNDARY', 'ENTRY', 'CONTRACT')),
        cn AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY sec, o) AS n, list_position(['MAP', 'SYM', 'FLOW', 'BROKER', 'ENTRY', 'CONTRACT', 'BOUNDARY', 'STEP', 'AREA', 'ANCHOR'], tag) AS pol,
          CASE tag WHEN 'STEP' THEN CASE kind WHEN 'setup' THEN 100 WHEN 'test' THEN 40 WHEN 'run' THEN 60 ELSE 95 END
            WHEN 'CONTRACT' THEN greatest(CASE kind WHEN 'openapi' THEN 40 WHEN 'proto' THEN 55 ELSE 75 END, CASE f WHEN 0 THEN 95 WHEN 2 THEN 110 ELSE 0 END) ELSE 0 END AS loss FROM ck),
        ct AS (SELECT *, row_number() OVER (PARTITION BY p, tag ORDER BY loss DESC, n DESC) AS turn_, count(*) OVER (PARTITION BY p, tag) - [0, 0, 0, 0, 2, 1, 0, 1, 1, 3][pol] AS gone FROM cn),
        cv AS (SELECT *, CASE WHEN turn_ <= gone THEN row_number() OVER (PARTITION BY p ORDER BY turn_ <= gone DESC, pol, turn_) ELSE 9999999 END AS life FROM ct),
        d AS (SELECT p, f, max(life) AS life, row_number() OVER (PARTITION BY p ORDER BY f) - 1 AS d FROM cv GROUP BY p, f),
        names(f, name) AS (VALUES (0, 'f0.md'), (1, 'f1.rs'), (2, 'f2/README.md'), (3, 'f3.json'), (4, 'f4.toml')),
        heads AS (SELECT 'c' || c_custkey AS p FROM customer),
        ev AS (SELECT p, f, life, 'EV ev' || f || ' kind=x file=d' || d || ' L1-L' || (f + 10) AS line, 'D d' || d || ' "' || name || '"' AS word, 'NBA evidence_fetch {"items":[{"file":"' || name || '","start_line":1,"end_line":' || (f + 10) || '}]}' AS nba
          FROM d JOIN names USING (f)),
        top AS (SELECT p, unnest([0, 1, 2]) AS n, unnest(['CPV1', 'ROOT_FP r', 'QUERY "q"']) AS line FROM heads),
        body AS (SELECT p, sec + 1 AS s, n, tag || ' kind=' || kind || ' file=d' || d || CASE WHEN f < 4 THEN ' ev=ev' || f ELSE '' END AS line, cv.life FROM cv JOIN d USING (p, f)
          UNION ALL SELECT p, 1, f, word, life FROM ev UNION ALL SELECT p, 98, f, line, life FROM ev WHERE f < 4),
        l AS (SELECT * FROM body UNION ALL SELECT p, s, -1, 'S ' || CASE s WHEN 1 THEN 'DICT' WHEN 98 THEN 'EVIDENCE' ELSE ['ANCHORS', 'CANON', 'BOUNDARIES', 'MAP', 'OUTPUTS', 'ENTRYPOINTS', 'CONTRACTS', 'FLOWS', 'BROKERS'][s - 1] END, max(life) FROM body GROUP BY p, s
          UNION ALL SELECT p, 0, n, line, 9999999 FROM top
          UNION ALL SELECT heads.p, 99, 0, coalesce(arg_min(nba, f), 'NBA map'), 9999999 FROM heads LEFT JOIN (SELECT * FROM ev WHERE f < 4) e ON e.p = heads.p GROUP BY heads.p),
        cuts AS (SELECT p, CASE WHEN (SELECT sum(length(line) + 1) FROM l WHERE l.p = h.p) <= 330 THEN 0 ELSE min(life) FILTER (life < 9999999 AND rest <= 330) END AS cut
          FROM (SELECT p, life, coalesce(sum(sum(length(line) + 1)) OVER (PARTITION BY p ORDER BY life DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM l GROUP BY p, life) h GROUP BY p),
        best AS (SELECT p, arg_min(f, (CASE WHEN tag = 'STEP' THEN 1 WHEN tag = 'ANCHOR' AND kind = 'canon' THEN 2 WHEN tag = 'CONTRACT' THEN 3 WHEN tag = 'ANCHOR' AND kind = 'contract' THEN 4 WHEN tag = 'ENTRY' THEN 5
              WHEN tag = 'ANCHOR' THEN 7 ELSE 99 END * 1000 + CASE WHEN tag <> 'STEP' THEN 500 ELSE CASE kind WHEN 'test' THEN 0 WHEN 'run' THEN 20 WHEN 'odd' THEN 55 ELSE 60 END END)::BIGINT * 1000000 + CASE WHEN tag = 'STEP' THEN f * 10000 ELSE 0 END + n) AS f
          FROM cv JOIN cuts USING (p) WHERE cut IS NULL AND life = 9999999 AND f < 4 GROUP BY p),
        few AS (SELECT p, unnest([1, 2, 3, 4, 5]) AS n, unnest(['S DICT', word, 'S EVIDENCE', line, nba]) AS line FROM ev JOIN best USING (p, f)),
        kept AS (SELECT p, s, n, line FROM l JOIN cuts USING (p) WHERE life > cut
          UNION ALL SELECT p, 0, n, line FROM top SEMI JOIN (SELECT p FROM cuts WHERE cut IS NULL) USING (p) UNION ALL SELECT p, 1, n, line FROM few
          UNION ALL SELECT p, 99, 0, 'NBA map' FROM cuts ANTI JOIN best USING (p) WHERE cut IS NULL)
        SELECT p AS pack_id, row_number() OVER (PARTITION BY p ORDER BY s, n, line) AS ord, line FROM kept""",
}
