"""Closed itemsets and their rules against brute force over all subsets."""

import random
from itertools import combinations

import numpy as np
import pytest

from tessera.llm.itemsets import SuffixClass, digest_rules, frequent_itemsets

SCHEMA = "b long, i long, item string, n string, last string, t string"


def brute(rows, least, parts, confidence=60):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    n = {}
    for items in baskets.values():
        for k in range(1, len(items) + 1):
            for x in combinations(sorted(items), k):
                n[x] = n.get(x, 0) + 1
    frequent = {x: s for x, s in n.items() if s >= least and s * parts >= len(baskets)}
    out = {}
    for x, s in frequent.items():
        if not any(len(y) == len(x) + 1 and set(x) < set(y) and frequent[y] == s for y in frequent):
            rest = [(c, n[tuple(i for i in x if i != c)], n[c,]) for c in x] if len(x) > 1 else []
            out[x] = (s, [(c, a, m) for c, a, m in rest if 100 * s >= confidence * a and s * len(baskets) > a * m])
    return out


def found(spark, rows, **options):
    df = frequent_itemsets(spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA), "b", "i", **options)
    return {tuple(r["items"]): (r.support, [tuple(x) for x in r.rules]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_dense_baskets_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(b, rng.choice([1, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9])) for b in range(60) for _ in range(rng.randrange(9))]
    rows += [(100 + b, i) for b in range(12) for i in (1, 3, 20, 21, 22)] + [(None, 1), (1, None), (None, None)] + rows[:20]
    wanted = brute(rows, 3, 25)
    assert len(wanted) > 50 and any(len(x) > 3 for x in wanted) and any(len(r[1]) > 1 for r in wanted.values())
    assert found(spark, rows, least=3, parts=25) == wanted


def test_a_large_basket_and_equal_ones(spark):
    rows = [(1, i) for i in range(300)] + [(b, i) for b in range(2, 40) for i in range(14)]  # 2^14 subsets of one closed set
    assert found(spark, rows, least=5, parts=1000) == {
        tuple(range(14)): (39, [])
    }
    assert found(spark, rows + [(50, 0), (51, 0)], least=5, parts=1000).keys() == {(0,), tuple(range(14))}


def test_nothing(spark):
    df = digest_rules(frequent_itemsets(spark.createDataFrame([], SCHEMA), "b", "i"))
    assert df.columns == ["items", "n_items", "support", "n_rules", "best_item", "rules_sha256"] and df.count() == 0
    assert found(spark, [(1, 1), (2, None)]) == {}


def test_lists_of_nodes():
    # prefixes ab, abc, b, ac with 3, 2, 1, 1 baskets
    tree = SuffixClass(np.array([1, 2, 1, 2, 3, 2, 1, 3]), np.array([2, 5, 6, 8]), np.array([3, 2, 1, 1]), 1)
    at = [tree.place[i] for i in (1, 2, 3)]
    assert sorted(tree.items[:2]) == [1, 2] and tree.items[2] == 3
    assert [tree.support([p]) for p in at] == [6, 6, 3]
    assert tree.support(at[:2]) == 5 and tree.support(at) == 2 and tree.support([at[1], at[2]]) == 2
    pre, post, n, _ = tree.lists[at[2]]
    assert len(pre) == len(post) == 2 and sorted(n.tolist()) == [1, 2]
