"""Maps, overviews and statistics over chunks and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.paths import directory_key, layer_role


def directory_map(chunks: DataFrame, depth: int) -> DataFrame:
    """directory, chunks, files, lines and the share of all lines; totals are one row beside the groups."""
    lines = F.col("end_line") - F.col("start_line") + 1
    grouped = chunks.groupBy(directory_key(F.col("file_path"), depth).alias("directory")).agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("file_path").alias("files"), F.sum(lines).cast("bigint").alias("lines")
    )
    whole = F.sum("lines").over(W.partitionBy(F.lit(1)))  # over directories, not chunks
    return grouped.withColumn("coverage", F.round(F.floor(F.col("lines") * 10000 / whole) / 100, 6))


def directory_symbols(chunks: DataFrame, symbol: str, depth: int, k: int = 5) -> DataFrame:
    """The k symbols of each directory that cover most: sum over files of their lines in the largest chunk over the file's lines."""
    lines = F.col("end_line") - F.col("start_line") + 1
    rows = chunks.select(directory_key(F.col("file_path"), depth).alias("directory"), "file_path", F.col(symbol).alias("symbol"), lines.alias("n"), F.col("end_line").alias("last"))
    size = rows.groupBy("directory", "file_path").agg(F.max("last").alias("size"))
    per_file = rows.where("symbol IS NOT NULL").groupBy("directory", "file_path", "symbol").agg(F.max("n").alias("n"))
    scored = per_file.join(size, ["directory", "file_path"]).groupBy("directory", "symbol").agg(F.sum(F.least("n", "size") / F.col("size")).alias("score"))
    scored = scored.withColumn("score", F.round("score", 6))
    rank = F.row_number().over(W.partitionBy("directory").orderBy(F.desc("score"), "symbol"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def overview(chunks: DataFrame) -> DataFrame:
    """layer, role, files: distinct files of each top-level directory."""
    nested = chunks.where(F.contains("file_path", F.lit("/"))).withColumn("layer", F.substring_index("file_path", "/", 1))
    return nested.groupBy("layer").agg(F.count_distinct("file_path").alias("files")).withColumn("role", layer_role(F.col("layer")))


def index_stats(chunks: DataFrame, language: str) -> DataFrame:
    """Files, chunks and lines by language."""
    lines = F.col("end_line") - F.col("start_line") + 1
    return chunks.groupBy(language).agg(F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("chunks"), F.sum(lines).cast("bigint").alias("lines"))


def repo_signals(files: DataFrame) -> DataFrame:
    """One row of conditional counts over files: what kind of repository this is."""
    path = F.lower("file_path")
    manifest = path.rlike(r"(^|/)(cargo\.toml|package\.json|pyproject\.toml|go\.mod)$")
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(path.rlike(r"\.(md|mdx|rst)$")).alias("docs"), F.count_if(path.rlike(r"\.(ya?ml|toml|json)$")).alias("configs"),
        F.count_if(path.rlike(r"\.(rs|py|go|ts|js|java)$")).alias("code"), F.count_if(path.rlike(r"(^|/)(data|datasets)/|\.(csv|parquet|jsonl)$")).alias("data"),
        F.count_distinct(F.when(manifest, F.regexp_extract("file_path", "^(.*/)?[^/]*$", 1))).alias("manifest_scopes"),
    )


def rolling_percentile(rows: DataFrame, key: str, order: list[str], value: str, window: int, share: float) -> DataFrame:
    """Nearest-rank percentile of the last `window` values of each key."""
    last = W.partitionBy(key).orderBy(*order).rowsBetween(-(window - 1), 0)
    values = F.array_sort(F.collect_list(value).over(last))
    place = F.ceil(F.size(values) * F.lit(share)).cast("int")
    return rows.withColumn("p", F.element_at(values, F.greatest(place, F.lit(1))))
