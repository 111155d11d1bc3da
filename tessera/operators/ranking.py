"""Rank fusion, normalisation, thresholds and ordered selection, per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RRF_K, ADAPTIVE_K = 60, 100
MIN_DELTA, FLOAT32_EPSILON = 1e-6, 1.1920929e-07
QUERY_BLOCK = 1000
# Related items of a primary by relation.
RELATION_CAPS = {"Calls": 6, "Uses": 6, "Contains": 4, "Extends": 3}
OTHER_CAP = 2


def against_all(rows: DataFrame, queries: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """Every row beside every query of a stated set, block by block.

    One block of queries is broadcast. Of more, rows go to every block by an equi-join on block and slice,
    so that a block is met by as many tasks as there are slices; rows are sliced by a hash of all they hold.
    """
    copies, asked = dealt(rows, queries, block)
    one = queries.count() <= block
    return copies.join(F.broadcast(asked) if one else asked, ["_block", "_slice"]).drop("_block", "_slice")


def dealt(rows: DataFrame, queries: DataFrame, block: int = QUERY_BLOCK, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """rows and queries with _block and _slice, so that those of equal ones meet; of several blocks each has `least` slices of the rows or more."""
    blocks = max(1, -(-queries.count() // block))
    slices = 1 if blocks == 1 else max(least, -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks))
    keys = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("_block", F.pmod(F.hash(*queries.columns), F.lit(blocks))).withColumn("_slice", keys(slices))
    copies = rows.withColumn("_slice", F.pmod(F.xxhash64(*rows.columns), F.lit(slices)).cast("int")).withColumn("_block", keys(blocks))
    return copies, asked


def ranked(rows: DataFrame, by: list[str | Column], *order: Column | str) -> DataFrame:
    """rows with `rank`, from 0."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)


def top_k(rows: DataFrame, by: list[str], k: int | Column, *order: Column | str) -> DataFrame:
    """The first k rows of each group, with `rank` from 0; Spark cuts within tasks before it shuffles."""
    return ranked(rows, by, *order).where(F.col("rank") < k)


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, item, fused: weighted reciprocal rank fusion of lists (query_id, item, rank from 0, weight)."""
    return lists.groupBy("query_id", "item").agg(F.sum(F.col("weight") / (k + F.col("rank") + 1)).alias("fused"))


def normalize_scores(rows: DataFrame, score: str = "score") -> DataFrame:
    """Min-max per query: scores that are not finite count as the least, equal ones as 1, without a finite one all are 0."""
    s = F.col(score)
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))
    bounds = rows.groupBy("query_id").agg(F.min(F.when(finite, s)).alias("_lo"), F.max(F.when(finite, s)).alias("_hi"), F.max(~finite).alias("_odd"))
    lo, hi = F.col("_lo"), F.col("_hi")
    value = (
        F.when(lo.isNull(), 0.0).when(F.col("_odd") & (hi - lo < FLOAT32_EPSILON), F.when(finite, 1.0).otherwise(0.0))
        .when(hi - lo < MIN_DELTA, 1.0).otherwise((F.when(finite, s).otherwise(lo) - lo) / (hi - lo))
    )
    return rows.join(bounds, "query_id").withColumn(score, value).drop("_lo", "_hi", "_odd")


def passes_thresholds(semantic: Column, fuzzy: Column, min_semantic: float, min_fuzzy: float) -> Column:
    """Dropped are candidates of which no signal is met but for absent ones; those without any signal pass."""
    sem, fuz = semantic >= min_semantic, fuzzy >= min_fuzzy
    return ~F.coalesce(
        (sem.isNull() & ~fuz) | (~sem & fuz.isNull()) | (~sem & ~fuz), F.lit(False)
    )


def running_budget(rows: DataFrame, by: list[str], cost: str, budget: int, *order: Column | str) -> DataFrame:
    """Rows in order up to the first that takes the running cost over the budget; adds `used`."""
    used = F.sum(cost).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", used).where(F.col("used") <= budget)


def relation_cap(relation: Column) -> Column:
    out = F.lit(OTHER_CAP)
    for name, cap in RELATION_CAPS.items():
        out = F.when(relation == name, cap).otherwise(out)
    return out


def round_robin(related: DataFrame, per_primary: int) -> DataFrame:
    """Related rows (query_id, primary_rank, relation, related_id, relevance) in turns: each primary gives one a round.

    Capped by relation and by primary; `turn` is the round, rows are taken by (turn, primary_rank).
    """
    best = [F.desc("relevance"), "related_id"]
    capped = ranked(related, ["query_id", "primary_rank", "relation"], *best).where(F.col("rank") < relation_cap(F.col("relation")))
    turns = ranked(capped.drop("rank"), ["query_id", "primary_rank"], *best).where(F.col("rank") < per_primary)
    return turns.withColumnRenamed("rank", "turn")
