"""Graph indexes against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ann, vector


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + rng.normal(size=24)).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(3000 + i, [1.0] * 24) for i in range(400)]  # equal ones
    odd = [(9001, None), (9002, [0.0] * 24), (9003, [1.0] * 3), (None, [1.0] * 24), (5, [9.0] * 24)]
    return spark.createDataFrame([*rows, *odd[:-1]], "item long, vector array<float>").repartition(4).cache()


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where("item % 40 = 7 AND item < 3400").select(F.col("item").alias("query_id"), F.col("vector").alias("q"))


def recall(spark, found, vectors, queries, k=10):
    exact = vector.vector_topk(vectors.where("item IS NOT NULL AND size(vector) = 24").select(F.col("item").alias("vec_id"), F.col("vector").alias("embedding")), queries, k)
    least = {r.query_id: round(r.score, 5) for r in exact.groupBy("query_id").agg(F.min("score").alias("score")).collect()}
    rows = found.collect()
    assert len({(r.query_id, r.item) for r in rows}) == len(rows) and all(r.rank < k for r in rows)
    return sum(r.score >= least[r.query_id] - 1e-4 for r in rows) / (k * len(least))  # any of equal vectors will do


def test_recall_with_bounded_candidates(spark, vectors, queries, monkeypatch):
    index = ann.build_index(vectors, 24, cell_rows=500)
    assert index.nodes.groupBy("cell").count().count() >= 4 and index.nodes.select("item").distinct().count() == 3400
    found = ann.search(index, queries, 10)
    assert recall(spark, found, vectors, queries) >= 0.9
    assert found.agg(F.max("met")).first()[0] <= ann.PROBES * (ann.BEAM + ann.LAYER**2) * ann.MOST
    narrow = ann.search(index, queries, 10, beam=40, probes=2)
    assert narrow.agg(F.max("met")).first()[0] < found.agg(F.max("met")).first()[0]
    monkeypatch.setattr(ann, "FLAT_PIVOTS", 2)  # pivots have an index of their own
    assert recall(spark, ann.search(index, queries, 10), vectors, queries) >= 0.9


def test_odd_queries(spark, vectors):
    index = ann.build_index(vectors, 24)
    asked = spark.createDataFrame([(1, [0.0] * 24), (2, None), (3, [1.0] * 5), (4, [1.0] * 24)], "query_id long, q array<float>")
    rows = sorted((r.query_id, r.rank, r.item, round(r.score, 4)) for r in ann.search(index, asked, 3).collect())
    assert rows[:3] == [(1, 0, 0, 0.0), (1, 1, 1, 0.0), (1, 2, 2, 0.0)] and [r[0] for r in rows[3:]] == [4] * 3 and all(r[3] == 1 for r in rows[3:])
    empty = ann.build_index(vectors.limit(0), 24)
    assert ann.search(empty, asked, 3).count() == 0


def test_remove_rebuild_and_add(spark, vectors, queries):
    index = ann.build_index(vectors, 24, cell_rows=1000)
    few = ann.remove(index, vectors.where("item % 10 = 3").select("item"), tombstones=1)
    assert few.nodes.where("dead").select("item").distinct().count() == 340
    left = vectors.where("item % 10 <> 3")
    assert recall(spark, ann.search(few, queries, 10), left, queries) >= 0.9
    many = ann.remove(few, vectors.where("item % 2 = 0").select("item"), tombstones=1)
    assert many.nodes.where("dead").count() == 0 and many.nodes.select("item").distinct().count() == 3400 - 340 - 1700
    kept = ann.remove(index, vectors.where("item % 2 = 0").select("item"), tombstones=10_000)
    assert kept.nodes.where("dead").select("item").distinct().count() == 1700
    back = ann.add(many, vectors.where("item % 2 = 0 AND item < 3400"))
    now = vectors.where("item % 10 <> 3")
    assert back.nodes.where("NOT dead").select("item").distinct().count() == 3400 - 340 and recall(spark, ann.search(back, queries, 10), now, queries) >= 0.9
    other = spark.createDataFrame([(7, [5.0] + [0.0] * 23)], "item long, vector array<float>")
    assert ann.search(ann.add(back, other), other.select(F.lit(1).alias("query_id"), F.col("vector").alias("q")), 1).first().item == 7


def test_probes_rise_until_the_recall_is_reached(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=24).astype(np.float32).tolist()) for i in range(1500)]
    index = ann.build_index(spark.createDataFrame(rows, "item long, vector array<float>"), 24, cell_rows=50)
    monkeypatch.setattr(ann, "CALIBRATION", 40)
    fitted = ann.calibrated(index)
    assert index.probes == ann.PROBES < fitted.probes <= index.pivots.count()
    asked = spark.createDataFrame(rows[::50], "query_id long, q array<float>")
    exact = vector.vector_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), asked, 10)
    assert vector.recall_at_k(ann.search(fitted, asked, 10), exact).first().recall >= 0.9


def test_equal_vectors_by_their_ids(spark):
    rng = np.random.default_rng(6)
    some = rng.normal(size=(40, 24)).astype(np.float32)
    rows = [(i, some[i * 7 % 40].tolist()) for i in range(40 * 25)]
    vectors = spark.createDataFrame(rows, "item long, vector array<float>")
    index = ann.remove(ann.build_index(vectors, 24, cell_rows=600), vectors.where("item % 3 = 0"), tombstones=1000)
    index = ann.add(index, vectors.where("item % 9 = 0"))
    left = vectors.where("item % 3 <> 0 OR item % 9 = 0")
    asked = left.where("item % 20 = 0").select(F.col("item").alias("query_id"), F.col("vector").alias("q"))
    exact = vector.vector_topk(left.select(F.col("item").alias("vec_id"), F.col("vector").alias("embedding")), asked, 30)
    plain = lambda df: sorted((r.query_id, r.rank, r.item, r.score) for r in df.select("query_id", "rank", "item", "score").collect())
    assert plain(ann.search(index, asked, 30)) == plain(exact)  # more than the copies of one vector


def test_added_vectors_that_are_no_numbers_take_no_part(spark):
    index = ann.build_index(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "item long, vector array<float>"), 2)
    odd = spark.createDataFrame([(30, [1.0, float("nan")]), (31, [1.0, None]), (32, [2.0, 1.0])], "item long, vector array<float>")
    assert [r.item for r in ann.add(index, odd).nodes.where("item >= 30").select("item").distinct().collect()] == [32]


def test_fusion_of_models_has_one_row_for_a_pair(spark, sf_dir):
    from tessera.plans.registry import QUERIES

    rows = QUERIES["rrf_multi"](spark, sf_dir).collect()
    assert len({(r.query_id, r.item) for r in rows}) == len(rows) > 0


def plain(df):
    return sorted((r.query_id, r.rank, r.item, r.score) for r in df.select("query_id", "rank", "item", "score").collect())


def test_small_cells_are_compared_whole(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=48).astype(np.float32).tolist()) for i in range(6000)]
    vectors = spark.createDataFrame(rows, "item long, vector array<float>")
    asked = vectors.where("item % 100 = 3").select(F.col("item").alias("query_id"), F.col("vector").alias("q"))
    exact = plain(vector.vector_topk(vectors.select(F.col("item").alias("vec_id"), F.col("vector").alias("embedding")), asked, 10))
    index = ann.build_index(vectors, 48, cell_rows=1500)
    found = ann.search(index, asked, 10, probes=100)
    assert plain(found) == exact and found.agg(F.min("met")).first()[0] == index.nodes.count() == 12_000
    monkeypatch.setattr(ann, "WALKED", 0)
    met = lambda: ann.search(index, asked, 10, probes=100)
    assert len(set(plain(met())) & set(exact)) >= 0.6 * len(exact) and met().agg(F.max("met")).first()[0] < 2 * 6000


@pytest.mark.parametrize("groups", [1, 5])
def test_queries_go_to_the_groups_of_their_cells(groups):
    cells = np.array([-(2**62), -5, 0, 7, 2**31, 2**62])
    assert set(ann._group_of(cells, groups)) <= set(range(groups))


def test_groups_of_cells_agree(spark):
    cells = [-(2**63), -5, 0, 7, 2**31 - 1, 2**31, 2**63 - 1, *range(50, 90)]
    rows = spark.createDataFrame([(c,) for c in cells], "cell long").select("cell", ann._group(F.col("cell"), 7).alias("g")).collect()
    assert [r.g for r in rows] == ann._group_of(np.array([r.cell for r in rows]), 7).tolist()


def test_nearest_equals_all_pairs(monkeypatch):
    monkeypatch.setattr(vector, "TILE", 400)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6))
    x[50:90] = x[:40]  # equal ones
    x[90], x[91], x[92, 0], x[93, 0], x[94], x[95] = 0, x[3] * 1e-200, np.nan, np.inf, x[4] * 1e200, x[5] * 1e-30
    q = np.concatenate([x[[0, 3, 60, 90, 91, 93, 94, 95]], rng.normal(size=(30, 6))])
    whole, q_whole = rng.random(300) > 0.1, np.arange(len(q)) != 9
    keys = rng.permutation(300)
    best = vector.Nearest(q, 7, q_whole)
    for at in (*range(0, 300, 70), 0):  # the first ones are met twice
        best.meet(x[at : at + 70], keys[at : at + 70], whole=whole[at : at + 70])
    asks, found, scores, null = best.rows()
    with np.errstate(all="ignore"):
        for i in range(len(q)):
            size = vector._norms(q[i : i + 1]) * vector._norms(x)
            score = np.where(size == 0, 0.0, vector._pairs(q, x, np.full(300, i), np.arange(300)) / size)
            order = np.where(whole & q_whole[i], np.where(np.isnan(score), np.inf, score), -np.inf)
            top = np.lexsort((keys, -order))[:7]
            assert found[asks == i].tolist() == keys[top].tolist() and null[asks == i].tolist() == (order[top] == -np.inf).tolist()
            np.testing.assert_array_equal(scores[asks == i][~null[asks == i]], score[top][order[top] > -np.inf])
