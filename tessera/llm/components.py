"""Connected components by alternating large-star and small-star steps, as joins over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, to_keys


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) of every node on an edge (a, b); label is the least node of its component.

    Nodes are 64-bit integers; edges with a null are left out, repeated ones and loops count once. An
    edge list of a component shrinks to a star. The hubs of the stars are met by to_keys(), so that a
    node of any degree spreads over tasks. Each round is written to the shared folder.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    stars = materialize(pairs, "edges")
    last = None
    while (now := _fingerprint(stars)) != last:
        last = now
        both = stars.where("hi <> lo")
        both = both.unionByName(both.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        large = _to_least(both, "large").where("lo > hi").select(F.col("lo").alias("hi"), F.least("hi", "least").alias("lo"))
        large = materialize(large.distinct(), "large-star")
        pairs = F.array(*(F.struct(F.col(n).alias("hi"), F.col("least").alias("lo")) for n in ("hi", "lo")))
        small = _to_least(large, "small").select(F.inline(pairs)).where("hi <> lo")
        loops = stars.where("hi = lo")
        stars = materialize(small.unionByName(loops).distinct(), "small-star")
    # a node with a loop has its own label as well
    roots = stars.select(F.col("lo").alias("node"), F.col("lo").alias("label"))
    labels = stars.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(roots)
    return labels.groupBy("node").agg(F.min("label").alias("label"))


def _to_least(edges: DataFrame, name: str) -> DataFrame:
    """edges (hi, lo) with `least`, the least lo of their hi."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"), F.count(F.lit(1)).alias("degree"))
    return to_keys(edges, materialize(least, f"least-{name}"), "hi", "degree").drop("degree")


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())
