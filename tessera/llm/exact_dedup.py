"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a parquet table bucketed and sorted by digest, so that later batches meet it in a
sort-merge anti-join that moves only the batch. New digests are appended; the index can be opened
again by its path in another session.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table, without, work_path

#: Buckets of a new index: one for each BUCKET_ROWS of the digests that it is made for (some 50 bytes each), within these bounds.
BUCKET_ROWS, FEWEST, MOST = 2_000_000, 32, 50_000


class DigestIndex:
    """Digest -> document that stays, kept in `path`, hash-bucketed into sorted buckets.

    A new index has as many buckets as the digests that it is made for (`rows`) need, or `buckets`;
    the number is kept with it. A digest is in the index once at most. Appends go through Spark's
    committer, so that a lost executor leaves either the whole batch or nothing. close() takes the
    index out of the session's catalog; its files stay.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, rows: int = 0):
        self.spark, self.path = spark, path
        kept = f"{path}/_buckets"  # not part of the table, as its name starts with a low line
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(kept)
        if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
            spark.range(1).select(F.lit(buckets or min(MOST, max(FEWEST, -(-rows // BUCKET_ROWS)))).alias("buckets")).write.parquet(kept)
        self.buckets = buckets = spark.read.parquet(kept).first()[0]
        self.name = f"digest_index_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, fresh: DataFrame) -> None:
        """Adds rows (digest, keep_id); each bucket is written by one task as one sorted file."""
        rows = fresh.select("digest", F.col("keep_id").cast("bigint").alias("keep_id"))
        (
            rows.repartition(self.buckets, "digest").write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, as bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicates a batch within itself and against `index`, and appends its new digests.

    Returns a row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    * Texts are equal when identical; a null text is the empty text.
    * Of equal texts in a batch the largest id stays; a text that the index has already keeps the
      document named there, and none of the batch's rows of it stay.
    * group_size counts the batch's rows of the text. Rows that repeat an id and its text are the
      same document: each is returned, with the same values.
    * A null id stays only if all ids of the text are null; such rows can't be told apart and all
      stay, with a null keep_id.
    * An empty table gives an empty result; other columns are not read. Texts are read whole, of any
      length, and only their digests move.
    * One text may be a third of all rows: it is pre-aggregated before the shuffle, and the join
      that hands results back has plain exchanges on both sides, whose large partitions Spark splits.
    """
    digests = materialize(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_digest(F.col(text_col)).alias("digest")), "digests")
    batch = materialize(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-batch")
    index.append(batch.hint("merge").join(index.read().select("digest"), "digest", "left_anti"))
    keepers = materialize(batch.select("digest", "group_size").hint("merge").join(index.read(), "digest"), "digest-keepers")
    return digests.join(keepers, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns."""
    dropped = exact_dedup(docs, index, id_col, text_col).where(~F.col("kept"))
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    return without(docs, dropped, (F.col(id_col).cast("bigint"), "doc_id"), (digest, "text_sha256"))


def dedup_in_batches(docs: DataFrame, path: str, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As exact_dedup(), of a table that comes in batches of falling ids: each is held against the index at `path` as the batches before it have left it.

    * The largest id of a text is in the batch that comes first with it, so that the result is that of one batch; group_size counts the rows
      of all batches. Batches are cut at quantiles of the ids, and rows without an id come in the last one.
    * The index is opened anew for each batch. A batch's results are written before the next one starts, so that a lost executor repeats one batch
      at most. Repeated rows, ties, nulls, empty tables and further columns: see exact_dedup().
    """
    spark = docs.sparkSession
    key = F.col(id_col).cast("bigint")
    shares = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx(key, shares, 1000)).first()[0] if shares else None
    cuts = sorted(set(found or ()), reverse=True)
    uppers, rows = [None, *cuts], docs.count()
    out = None
    for i, upper in enumerate(uppers):
        own = F.lit(True) if upper is None else key < upper
        lower = cuts[i] if i < len(cuts) else None
        own = (own & (key >= lower)) if lower is not None else own | key.isNull() if upper is not None else own
        index = DigestIndex(spark, path, rows=rows)
        found = materialize(exact_dedup(docs.where(own), index, id_col, text_col), "digest-results")
        index.close()
        out = found if out is None else out.unionByName(found)
    sizes = materialize(out.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size")), "digest-sizes")
    return out.drop("group_size").join(sizes, "text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents, in two batches against one index."""
    return dedup_in_batches(table(spark, sf_dir, "documents"), work_path(spark, "digest-index"))


OP3_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
