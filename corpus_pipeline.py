"""From raw documents to token ids: five stages, each a whole-table operator of the training-data subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import saved, table, work_path
from tessera.llm.exact_dedup import DigestIndex, drop_copies
from tessera.llm.mixing import mix_documents
from tessera.llm.ngram_join import drop_near_copies
from tessera.llm.pieces import token_rows
from tessera.llm.quality import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts are scored as empty ones, and without usable labels all stay."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays; null counts as empty, rows that repeat an id and its text are one document, a text without any id stays."""
    index = DigestIndex(spark, work_path(spark, "digest-index"), rows=docs.count())
    kept = drop_copies(docs, index)
    index.close()
    return kept


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the one with the least id stays; texts without words and rows without id stay, and so do all texts of that least id."""
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target weights of sources, languages and topics, small cells more than once; null source and language are values of their own."""
    return mix_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids; null and empty texts have none, and columns of the added names are replaced."""
    return token_rows(docs)


STAGES = [("quality", quality), ("exact dedup", exact), ("near copies", near), ("mixing", mix), ("pieces", pieces)]

#: The classifier and the tokeniser have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again for the next; what a stage leaves on its way is deleted.

    Texts are taken whole, of any length; further columns go along; an empty table gives an empty one.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
