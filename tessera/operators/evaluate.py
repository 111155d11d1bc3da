"""Evaluation of ranked results against expected items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_cases(results: DataFrame, expected: DataFrame) -> DataFrame:
    """case_id, mrr, recall, overlap: results (case_id, item, rank from 0) against expected (case_id, item).

    An item that occurs in several results counts at its first rank. overlap is found over found, missed and wrong.
    """
    best = results.groupBy("case_id", "item").agg(F.min("rank").alias("rank"))
    wanted = expected.select("case_id", "item").distinct()
    both = best.withColumn("_p", F.lit(1)).join(wanted.withColumn("_e", F.lit(1)), ["case_id", "item"], "full_outer")
    hit = F.col("_p").isNotNull() & F.col("_e").isNotNull()
    first = F.min(F.when(hit, F.col("rank") + 1))
    found, n = F.count_if(hit), F.count("_e")
    scored = both.groupBy("case_id").agg(first.alias("_first"), found.alias("_found"), n.alias("_n"), F.count(F.lit(1)).alias("_all"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return scored.where("_n > 0").select("case_id", F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"), share("_found", "_n").alias("recall"), share("_found", "_all").alias("overlap"))


def summarize(cases: DataFrame) -> DataFrame:
    """One row: means of the metrics, and nearest-rank percentiles of recall."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY recall)")
    return cases.agg(F.count(F.lit(1)).alias("cases"), *(F.avg(c).alias(f"mean_{c}") for c in ("mrr", "recall", "overlap")), rank(0.5).alias("p50_recall"), rank(0.95).alias("p95_recall"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """case_id, delta_mrr, delta_recall, winner: run b against run a, by MRR, then recall; a case of one run only is an error."""
    both = a.select("case_id", F.col("mrr").alias("_a"), F.col("recall").alias("_ra")).join(b.select("case_id", F.col("mrr").alias("_b"), F.col("recall").alias("_rb")), "case_id", "full_outer")
    checked = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("the runs have different cases"))).otherwise(F.col("_b") - F.col("_a"))
    winner = F.when(F.col("_b") > F.col("_a"), "b").when(F.col("_b") < F.col("_a"), "a").when(F.col("_rb") > F.col("_ra"), "b").when(F.col("_rb") < F.col("_ra"), "a").otherwise("tie")
    return both.select("case_id", checked.alias("delta_mrr"), (F.col("_rb") - F.col("_ra")).alias("delta_recall"), winner.alias("winner"))


def precision_at_k(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """case_id, precision: share of the first k rows returned that are relevant, without deduplication."""
    top = results.where(F.col("rank") < k)
    hit = top.join(relevant.select("case_id", "item").distinct().withColumn("_hit", F.lit(1)), ["case_id", "item"], "left")
    return hit.groupBy("case_id").agg((F.count("_hit") / F.count(F.lit(1))).alias("precision"))


def overlap_with_baseline(a: DataFrame, b: DataFrame, limit: int) -> DataFrame:
    """case_id, overlap: items of both result lists over the limit."""
    return a.select("case_id", "item").intersect(b.select("case_id", "item")).groupBy("case_id").agg((F.count(F.lit(1)) / limit).alias("overlap"))


def run_summary(cases: DataFrame) -> DataFrame:
    """One row for a run (latency_ms, bytes, anchor_hit; null for cases without an anchor): means, nearest-rank percentiles, and the share of anchors that no result has."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency_ms)").cast("bigint")
    anchored, hit = F.count("anchor_hit"), F.count_if(F.col("anchor_hit"))
    none = F.lit(0.0)
    return cases.agg(
        F.coalesce(F.avg("latency_ms"), none).alias("mean_latency_ms"), F.coalesce(rank(0.5), F.lit(0)).alias("p50_latency_ms"), F.coalesce(rank(0.95), F.lit(0)).alias("p95_latency_ms"),
        F.coalesce(F.avg("bytes"), none).alias("mean_bytes"), anchored.alias("anchor_cases"), hit.alias("anchor_hit_cases"), (anchored - hit).alias("anchorless_cases"),
        F.when(anchored > 0, (anchored - hit) / anchored).otherwise(none).alias("anchorless_rate"),
    )


def compare_summary(cases: DataFrame) -> DataFrame:
    """One row for compared queries (baseline_ms, context_ms, overlap, related): means, zeros for no query."""
    names = {"baseline_ms": "avg_baseline_ms", "context_ms": "avg_context_ms", "overlap": "avg_overlap_ratio", "related": "avg_related_chunks"}
    return cases.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(name) for c, name in names.items()))


# Directories that are noise in a map, by their last name, and those under which all are.
NOISE_NAMES = (
    "dist", "build", "out", "target", "node_modules", "data", "dataset", "datasets", "artifacts", "results", "corpus",
    ".worktrees", ".cache", ".venv", ".mypy_cache", ".pytest_cache", ".ruff_cache",
)
NOISE_ROOTS = ("dist", "build", "out", "target", "node_modules", "data", "dataset", "datasets", "artifacts", "results", "corpus", ".worktrees", ".cache")


def is_noise_directory(directory: Column) -> Column:
    """Whether a directory says nothing about the code."""
    low = F.regexp_replace(F.translate(F.regexp_replace(directory, r"^\s+|\s+$", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"^(\./)+", "")
    return F.substring_index(low, "/", -1).isin(*NOISE_NAMES) | (F.contains(low, F.lit("/")) & F.substring_index(low, "/", 1).isin(*NOISE_ROOTS))


def map_noise(rows: DataFrame) -> DataFrame:
    """case_id, entries, noise, ratio: of the directories in each case's map, how many are noise."""
    noise = F.count_if(is_noise_directory(F.col("directory")))
    return rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("entries"), noise.alias("noise"), (noise / F.count(F.lit(1))).alias("ratio"))


def token_saved(used: Column, evidence: Column, anchors: Column) -> Column:
    """Share of characters that a pack saves against reading its evidence or its anchors, whichever is more; null without either."""
    baseline = F.greatest(evidence, anchors)
    return F.when(baseline > 0, 1 - used / baseline)
