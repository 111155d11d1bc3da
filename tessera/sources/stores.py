"""Reading stored chunks and vectors back beside each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_scan(chunks: DataFrame, index: DataFrame, id_col: str = "item") -> DataFrame:
    """The stored chunks that the canonical index (id_col, ...) knows."""
    return chunks.join(index.select(id_col), id_col, "left_semi")


def vector_scan(vectors: DataFrame, chunks: DataFrame, dimension: int, id_col: str = "item") -> DataFrame:
    """Stored vectors (id_col, embedding) with the columns of their chunks; a null vector, one of another dimension or with a null component is an error, one without chunk is left out."""
    sound = F.col("embedding").isNotNull() & (F.size("embedding") == dimension) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("corrupt vector "), F.col(id_col).cast("string"))).cast("array<float>"))
    return chunks.join(vectors.select(id_col, checked.alias("embedding")), id_col)


def missing_chunks(vectors: DataFrame, chunks: DataFrame, id_col: str = "item") -> DataFrame:
    """Ids of vectors whose chunk is gone."""
    return vectors.select(id_col).join(chunks.select(id_col), id_col, "left_anti")
