"""Alignment points against a plain dynamic programme."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import alignment as al
from tessera.operators import retrieval


def plain_bonus(text, j):
    kind = lambda c: "space" if c in " \t\n\v\f\r" else "digit" if c in "0123456789" else "upper" if al.lowered(c) != c else "lower" if c in "abcdefghijklmnopqrstuvwxyz" or ord(c) > 127 else "separator" if c in al.SEPARATORS else "other"
    own, before = kind(text[j]), kind(text[j - 1]) if j else "space"
    if own == "space":
        return al.AFTER_SPACE
    if own in ("separator", "other"):
        return al.AFTER_OTHER
    if before in ("space", "separator", "other"):
        return {"space": al.AFTER_SPACE, "separator": al.AFTER_SEPARATOR, "other": al.AFTER_OTHER}[before]
    return al.NEW_CASE if (own == "upper" and before == "lower") or (own == "digit" and before != "digit") else 0


def plain(text, word):
    """Best points: cell (i, j) has character i of the word on place j, its points and the bonus of its run."""
    x = al.lowered(text) if al.lowered(word) == word else text
    cells, best = {}, 0
    for j in range(len(text)):
        own = plain_bonus(text, j)
        for i, c in enumerate(word):
            if x[j] != c:
                continue
            if not i:
                cells[i, j] = (al.POINTS + al.FIRST * own, own)
                continue
            gaps = []  # a gap's cost never takes points below 0, at whatever place of it
            for last in range(j - 1):
                if (i - 1, last) in cells:
                    left = max(0, cells[i - 1, last][0] - al.GAP)
                    for _ in range(j - last - 2):
                        left = max(0, left - al.LONGER)
                    gaps.append(left)
            options = [(max(gaps) + own, 0, own)] if gaps else []
            if (i - 1, j - 1) in cells:
                points, run = cells[i - 1, j - 1]
                run = max(run, al.IN_RUN)
                run = own if own >= al.AFTER_OTHER and own > run else run
                options.append((points + max(run, own), 1, run))
            if options:
                top = max(o[0] for o in options)
                chosen = min((o for o in options if o[0] == top), key=lambda o: o[1])
                cells[i, j] = (top + al.POINTS, chosen[2])
        best = max(best, cells.get((len(word) - 1, j), (0,))[0])
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abAB1_/ .é", max_size=14), min_size=1, max_size=6), st.text(alphabet="abAB1_/.é", min_size=1, max_size=4))
def test_points_equal_plain_programme(texts, word):
    found = al.Targets(texts).points(word, np.arange(len(texts)))
    assert np.maximum(found, 0).tolist() == [plain(t, word) for t in texts]


def test_order_of_matches():
    best = lambda query, *texts: sorted(texts, key=lambda t: -al.batch_points([[t]], [query.split()])[0, 0])
    assert best("sr", "xsxr", "search_result")[0] == "search_result"
    assert best("index", "i_n_d_e_x", "reindex", "src/index.rs")[0] == "src/index.rs"
    assert al.batch_points([["Foo"], ["foo"]], [["Fo"], ["fo"], ["fo", "x"]]).tolist()[2] == [0]
    assert al.batch_points([["foo"]], [["Fo"]]).tolist() == [[0]] and al.batch_points([["Foo"]], [["fo"]])[0, 0] > 0
    assert al.preview("é" * 150) == "é" * 100 and al.preview("a" + "é" * 150) == "a" + "é" * 99


@pytest.mark.parametrize("block", [1000, 2])
def test_fuzzy_match(spark, block, monkeypatch):
    monkeypatch.setattr(al, "QUERY_BLOCK", block)
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcd_/ ") for _ in range(n))
    rows = [(i, text(9), rng.choice([None, "abc", text(5)]), text(260)) for i in range(60)]
    chunks = spark.createDataFrame(rows, "item long, file_path string, symbol string, content string").repartition(3)
    queries = [(1, "abc"), (2, "a d"), (3, " "), (4, "zz"), (5, "dcba a")]
    found = retrieval.fuzzy_match(chunks, spark.createDataFrame(queries, "query_id long, query string"), 1000, aligned=True).collect()
    for query_id, query in queries:
        sums = {i: max((sum(p) if all(p := [plain(t, w) for w in query.split()]) else 0) for t in (path, symbol or "", al.preview(content))) if query.split() else 0 for i, path, symbol, content in rows}
        most = max(sums.values(), default=0)
        wanted = {i: 1.0 if (rows[i][2] or "").lower() == query.lower() else s / most for i, s in sums.items() if s}
        assert {r.item: r.fuzzy for r in found if r.query_id == query_id} == pytest.approx(wanted)
    assert retrieval.fuzzy_match(chunks.limit(0), spark.createDataFrame(queries, "query_id long, query string"), 9, aligned=True).count() == 0


def test_only_texts_with_all_words_are_aligned(monkeypatch):
    seen = []
    aligned = al.Targets._aligned
    monkeypatch.setattr(al.Targets, "_aligned", staticmethod(lambda x, bonus, needle: (seen.append(len(x)), aligned(x, bonus, needle))[1]))
    texts = ["alpha beta", "alpha", "beta", "Alpha gamma", ""]
    points = al.batch_points([texts], [["alpha", "beta"], ["Alpha"], ["zz"], []])
    assert seen == [1, 1, 1] and (points > 0).tolist() == [[True, False, False, False, False], [False, False, False, True, False], [False] * 5, [False] * 5]
    assert [(i, r.tolist()) for i, r in al.matches(["abc", "acb"], [["ab"], ["abc"], ["d"]])] == [(0, [0, 1]), (1, [0])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB1_/ .é", max_size=40), min_size=1, max_size=5), st.text(alphabet="abAB1_/.é", min_size=1, max_size=9))
def test_texts_aligned_together_and_alone_are_equal(texts, word):
    together = al.Targets(texts).points(word, np.arange(len(texts)))
    assert together.tolist() == [al.Targets([t]).points(word, np.arange(1))[0] for t in texts] and np.maximum(together, 0).tolist() == [plain(t, word) for t in texts]


def test_tasks_give_what_can_be_first(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcd_/ ") for _ in range(n))
    rows = [(i, text(6), "ab c" if i in (7, 70) else None, text(60)) for i in range(400)]
    chunks = spark.createDataFrame(rows, "item long, file_path string, symbol string, _preview string")
    queries = spark.createDataFrame([(1, "ab c"), (2, "dab")], "query_id long, query string")
    every, cut = al.aligned_pairs(chunks, queries), al.aligned_pairs(chunks, queries, 3)
    first = lambda df, q: sorted(((-r._exact, -r._points, r.item) for r in df.where(f"query_id = {q}").collect()))[:3]
    assert all(first(cut, q) == first(every, q) for q in (1, 2)) and cut.count() < every.count() / 2
    most = lambda df: sorted((r.query_id, r["max(_points)"]) for r in df.groupBy("query_id").agg({"_points": "max"}).collect())
    assert most(cut) == most(every) and every.rdd.getNumPartitions() > 1


def test_one_row_group_is_dealt_to_many_tasks(spark):
    chunks = spark.createDataFrame([(i, "abc", None, "abc") for i in range(50)], "item long, file_path string, symbol string, _preview string").coalesce(1)
    found = al.aligned_pairs(chunks, spark.createDataFrame([(1, "abc")], "query_id long, query string"))
    assert found.rdd.getNumPartitions() == al.TASKS * spark.sparkContext.defaultParallelism and found.count() == 50
