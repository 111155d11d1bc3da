"""Queries of the whole search, its summaries, and the scans of stored chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.vectors import stub_embed
from tessera.operators import evaluate, routed
from tessera.plans import lifecycle
from tessera.plans.base import FILES, LOWERED, QUERIES as QUERY_TABLE, files, queries, table
from tessera.plans.scalars import any_sql
from tessera.plans.search import DIMENSION, _CHUNKS, chunks, hybrid_sql, vectors
from tessera.profile import GENERAL
from tessera.sources import stores

_FORMS = 5


def named_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose symbols are made of their ids."""
    return chunks(spark, sf_dir).withColumn("symbol", F.concat(F.lit("Item_"), F.col("item")))


def mixed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries of all forms in turn: a path, a file name, a symbol in a sentence, a symbol, words."""
    form = F.col("query_id") % _FORMS
    path = F.coalesce("file_path", F.lit("no/such.file"))
    asked = queries(spark, sf_dir).join(files(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "file_path"), "query_id", "left")
    query = (
        F.when(form == 0, path).when(form == 1, F.substring_index(path, "/", -1)).when(form == 2, F.concat(F.lit("what does Item_"), "query_id", F.lit("() do")))
        .when(form == 3, F.concat(F.lit(" item_"), "query_id")).otherwise(F.col("query"))
    )
    return asked.select("query_id", query.alias("query"))


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


def direct_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that are answered without ranking."""
    return _placed(routed.direct_hits(named_chunks(spark, sf_dir), routed.trimmed(mixed_queries(spark, sf_dir))))


def routed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All queries; a query has the vector of its id."""
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("item"), "embedding")
    asked = mixed_queries(spark, sf_dir).join(v.select(F.col("item").alias("query_id"), F.col("embedding").alias("q")), "query_id", "left")
    return _placed(routed.routed_search(named_chunks(spark, sf_dir), v, asked, None))


def search_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanded queries against documents, both embedded by the stub."""
    embed = stub_embed(DIMENSION)
    stored = files(spark, sf_dir).select("doc_id", embed(F.col("content")).alias("embedding"))
    return _placed(routed.search_by_text(stored, queries(spark, sf_dir), embed, 10, "doc_id"))


def _primaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as primaries of their source's query, scored by length."""
    return files(spark, sf_dir).select(F.substring_index("file_path", "/", 1).alias("query_id"), "doc_id", "file_path", F.lit(1).alias("start_line"), F.length("content").cast("bigint").alias("score"))


def primaries_code_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed.arrange_primaries(_primaries(spark, sf_dir), 20, include_docs=False).select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))


def primaries_docs_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed.arrange_primaries(_primaries(spark, sf_dir), 20, prefer_code=False).select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))


def section_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the hints themselves as queries."""
    listed = [(-1 - i, needle) for i, needle in enumerate(n for needles in text.SECTION_HINTS.values() for n in needles)]
    asked = files(spark, sf_dir).select("doc_id", "content").unionByName(spark.createDataFrame(listed, "doc_id long, content string"))
    return asked.select("doc_id", *(c.alias(name) for name, c in text.section_hints(F.col("content")).items()))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases of a run: some have no anchor, some an anchor that no result has."""
    hit = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False)
    cases = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("latency_ms"), F.col("o_orderkey").alias("bytes"), hit.alias("anchor_hit"))
    return evaluate.run_summary(cases).select("*").withColumns({c: F.round(c, 6) for c in ("mean_latency_ms", "mean_bytes", "anchorless_rate")})


def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of two runs; a case takes its number of milliseconds, or twice that."""
    case = F.col("case_id")
    cases = lifecycle.compare_overlap(spark, sf_dir).select(case.cast("double").alias("baseline_ms"), (2 * case).cast("double").alias("context_ms"), "overlap", (case % 3).cast("double").alias("related"))
    return evaluate.compare_summary(cases).select(*(F.round(c, 6).alias(c) for c in ("avg_baseline_ms", "avg_context_ms", "avg_overlap_ratio", "avg_related_chunks")))


def map_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of all paths, by their length."""
    directory = F.regexp_replace("file_path", "/?[^/]*$", "")
    return _ratio(evaluate.map_noise(lifecycle.layout(spark, sf_dir).select(F.length("file_path").alias("case_id"), directory.alias("directory"))), "ratio")


def _ratio(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.round(column, 6))


def token_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = evaluate.token_saved(F.length("content"), 3 * F.length("file_path"), F.col("doc_id") % 1000)
    return files(spark, sf_dir).select("doc_id", F.round(saved, 6).alias("saved"))


def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = files(spark, sf_dir).select(F.col("doc_id").alias("item"), "file_path")
    return stores.corpus_scan(stored, vectors(spark, sf_dir).select(F.col("vec_id").alias("item")))


def vector_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = files(spark, sf_dir).select(F.col("doc_id").alias("item"), "file_path")
    return stores.vector_scan(vectors(spark, sf_dir).select(F.col("vec_id").alias("item"), "embedding"), stored, DIMENSION).select("item", "file_path", F.size("embedding").cast("bigint").alias("dimension"))


QUERIES = {f.__name__: f for f in (
    direct_routes, routed_search, search_by_text, primaries_code_first, primaries_docs_first, section_hints, run_summary, compare_summary, map_noise, token_saved,
    corpus_scan, vector_scan,
)}

_NAMED = _CHUNKS.replace("nullif(regexp_extract(content, '([A-Z][a-z]+)', 1), '')", "'Item_' || doc_id")
# the words of the other forms never reach the ranking
_WORDS = QUERY_TABLE.replace("FROM benchmark)", f"FROM benchmark WHERE item_id % {_FORMS} = {_FORMS - 1})")
_LOW = LOWERED.format("c.file_path")
_DIRECT = f"""dq AS (SELECT item_id AS query_id, item_id % {_FORMS} AS form, {LOWERED.format('f.file_path')} AS path, 'item_' || item_id AS name FROM benchmark JOIN files f ON doc_id = item_id WHERE item_id % {_FORMS} < {_FORMS - 1}),
  dp AS (SELECT query_id, c.item, c.file_path, 'path' AS route, CASE WHEN {_LOW} = n THEN 0 WHEN ends_with({_LOW}, n) THEN 1 ELSE 2 END AS tier
    FROM (SELECT query_id, CASE form WHEN 0 THEN path ELSE regexp_extract(path, '[^/]*$') END AS n FROM dq WHERE form < 2) JOIN chunks c ON contains({_LOW}, n) WHERE NOT {any_sql(GENERAL.reject, _LOW)}),
  ds AS (SELECT query_id, c.item, c.file_path, CASE form WHEN 2 THEN 'anchor' ELSE 'symbol' END AS route FROM dq JOIN chunks c ON lower(c.symbol) = name WHERE form >= 2 AND NOT {any_sql(GENERAL.reject, _LOW)}),
  da AS (SELECT query_id, item, file_path, route FROM dp QUALIFY tier = min(tier) OVER (PARTITION BY query_id) UNION ALL SELECT * FROM ds),
  direct AS (SELECT query_id, item, round(1 - 0.001::DOUBLE * rank, 6) AS score, rank, route FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file_path, item) - 1 AS rank FROM da) WHERE rank < 10)"""


def _primaries_sql(docs_place: int, docs: str) -> str:
    return f"""WITH {FILES}, f AS (SELECT string_split(file_path, '/')[1] AS query_id, doc_id, file_path, length(content) AS score,
        CASE WHEN ends_with(file_path, '.md') THEN {docs_place} WHEN ends_with(file_path, '.txt') THEN {docs_place} WHEN ends_with(file_path, '.yaml') THEN 3 ELSE 1 END AS place FROM files {docs})
        SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY place, score DESC, file_path) - 1 AS rank FROM f QUALIFY rank < 20"""


def _hints_sql() -> str:
    listed = [n for needles in text.SECTION_HINTS.values() for n in needles]
    flags = ", ".join("(" + " OR ".join(f"contains(low, '{n}')" for n in needles) + f") AS {name}" for name, needles in text.SECTION_HINTS.items())
    return f"""WITH {FILES}, a AS (SELECT doc_id, lower(content) AS low FROM files UNION ALL SELECT * FROM (VALUES {', '.join(f"({-1 - i}, '{n}')" for i, n in enumerate(listed))}) v(doc_id, low)) SELECT doc_id, {flags} FROM a"""


_SOURCES = "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL"
_LAYOUT = f"""listed AS (SELECT unnest(string_split('{' '.join(lifecycle.LAYOUT.split())}', ' ')) AS p),
  paths AS (SELECT p AS file_path FROM listed UNION SELECT source || '/' || p FROM ({_SOURCES}), listed UNION SELECT regexp_replace(url, '^[a-z]+://', '') FROM pages WHERE url IS NOT NULL)"""
_BAD_NAMES = "'dist', 'build', 'out', 'target', 'node_modules', 'data', 'dataset', 'datasets', 'artifacts', 'results', 'corpus'"
_MORE_NAMES = "'.worktrees', '.cache', '.venv', '.mypy_cache', '.pytest_cache', '.ruff_cache'"

ORACLE_SQL = {
    "direct_routes": f"WITH {_NAMED}, {_DIRECT} SELECT * FROM direct",
    "routed_search": hybrid_sql(False, _NAMED, f"{_WORDS}, {_DIRECT}").replace("SELECT * FROM rr WHERE rank < 10", "SELECT *, 'ranked' AS route FROM rr WHERE rank < 10 UNION ALL SELECT * FROM direct"),
    "primaries_code_first": _primaries_sql(5, "WHERE NOT ends_with(file_path, '.md') AND NOT ends_with(file_path, '.txt')"),
    "primaries_docs_first": _primaries_sql(0, ""),
    "section_hints": _hints_sql(),
    "run_summary": """SELECT round(avg(o_custkey), 6) AS mean_latency_ms, quantile_disc(o_custkey, 0.5) AS p50_latency_ms, quantile_disc(o_custkey, 0.95) AS p95_latency_ms, round(avg(o_orderkey), 6) AS mean_bytes,
        count(*) FILTER (o_orderstatus IN ('F', 'P')) AS anchor_cases, count(*) FILTER (o_orderstatus = 'F') AS anchor_hit_cases, count(*) FILTER (o_orderstatus = 'P') AS anchorless_cases,
        round(coalesce(count(*) FILTER (o_orderstatus = 'P') / nullif(count(*) FILTER (o_orderstatus IN ('F', 'P')), 0), 0), 6)::DOUBLE AS anchorless_rate FROM orders""",
    "compare_summary": f"""SELECT round(avg(case_id), 6) AS avg_baseline_ms, round(avg(2 * case_id), 6) AS avg_context_ms, round(avg(overlap), 6) AS avg_overlap_ratio, round(avg(case_id % 3), 6) AS avg_related_chunks
        FROM ({lifecycle.ORACLE_SQL['compare_overlap']})""",
    "map_noise": f"""WITH {_LAYOUT}, d AS (SELECT length(file_path) AS case_id, {LOWERED.format("regexp_replace(file_path, '/?[^/]*$', '')")} AS dir FROM paths),
        m AS (SELECT case_id, list_contains([{_BAD_NAMES}, {_MORE_NAMES}], regexp_extract(dir, '[^/]*$')) OR (contains(dir, '/') AND list_contains([{_BAD_NAMES}, '.worktrees', '.cache'], string_split(dir, '/')[1])) AS bad FROM d)
        SELECT case_id, count(*) AS entries, count(*) FILTER (bad) AS noise, round(count(*) FILTER (bad) / count(*), 6) AS ratio FROM m GROUP BY 1""",
    "token_saved": f"WITH {FILES} SELECT doc_id, round(1 - length(content) / nullif(greatest(3 * length(file_path), doc_id % 1000), 0), 6) AS saved FROM files",
    "corpus_scan": f"WITH {FILES} SELECT doc_id AS item, file_path FROM files SEMI JOIN (SELECT vec_id AS doc_id FROM embeddings WHERE embedding IS NOT NULL) USING (doc_id)",
    "vector_scan": f"WITH {FILES} SELECT doc_id AS item, file_path, len(embedding) AS dimension FROM files JOIN embeddings ON vec_id = doc_id WHERE embedding IS NOT NULL",
}
