"""How the input tables stand for files, queries and graphs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.work import importable

#: Spark 4.1 takes a union of tables that are partitioned alike for partitioned itself and leaves out shuffles that its own plan of rrf_multi needs.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"

#: Lines of a chunk of the line-count chunker: a tenth of the target tokens, ten at least.
TARGET_TOKENS = 512
CHUNK_LINES = max(TARGET_TOKENS // 10, 10)
QUERY_WORDS = 6
_EXTENSIONS = {"en": ".md", "fr": ".py", "de": ".yaml", "es": ".rs"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    spark.conf.set(UNION_PARTITIONING, "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """doc_id, file_path, content, and more columns of documents: each document as a file of its source and language."""
    ext = F.lit(".txt")
    for lang, suffix in _EXTENSIONS.items():
        ext = F.when(F.col("lang") == lang, suffix).otherwise(ext)
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id"), ext))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("file_path"), F.coalesce("text", F.lit("")).alias("content"), *more)


FILES = """files AS (
  SELECT doc_id, concat_ws('/', source, lang, 'doc_' || doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.py' WHEN 'de' THEN '.yaml' WHEN 'es' THEN '.rs' ELSE '.txt' END) AS file_path,
         coalesce(text, '') AS content FROM documents)"""

LINES = FILES + """, lines AS (
  SELECT doc_id, file_path, unnest(l) AS line, generate_subscripts(l, 1) AS n
  FROM (SELECT doc_id, file_path, CASE WHEN content = '' OR ends_with(content, chr(10)) THEN (string_split(content, chr(10)))[:-2] ELSE string_split(content, chr(10)) END AS l FROM files))"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: the longest words of each benchmark item."""
    from tessera.functions.text import keywords

    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), keywords(F.coalesce("text", F.lit("")), QUERY_WORDS).alias("query"))


LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "list_filter(regexp_split_to_array(" + LOWERED + ", '[^a-z0-9]+'), lambda x: length(x) >= 3)"


def words_sql(column: str) -> str:
    return WORDS.format(column)


QUERIES = f"""queries AS (
  SELECT item_id AS query_id, array_to_string(list_transform(list_sort(list_transform(list_distinct({words_sql("coalesce(text, '')")}), lambda x: {{'l': -length(x), 'w': x}}))[1:{QUERY_WORDS}], lambda s: s.w), ' ') AS query
  FROM benchmark)"""
