"""Shards, automata and phrases against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import phrases
from tessera.llm.phrases import SuffixAutomaton, mine_phrases, phrase_counts, words_of

SCHEMA = "doc_id long, text string, lang string, phrase string, words string, n string, f string, shard string"


def pieces_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]


def grams(rows, depth=4):
    out, n = {}, Counter()
    for text, lang in rows:
        for words in pieces_of(text):
            n[lang or "und"] += len(words)
            for i in range(len(words)):
                for k in range(1, min(depth, len(words) - i) + 1):
                    out.setdefault(lang or "und", Counter())[tuple(words[i : i + k])] += 1
    return out, n


def brute(rows, top, least, subsumed=80):
    counts, n = grams(rows)
    out = []
    for lang, f in counts.items():
        found = {x: a for x, a in f.items() if len(x) > 1 and a >= least}
        inside = lambda x, y: len(x) < len(y) and any(y[i : i + len(x)] == x for i in range(len(y)))
        kept = [x for x in found if not any(inside(x, y) and 100 * found[y] >= subsumed * found[x] for y in found)]
        best = {x: min((2_000_000 * f[x] // (f[x[:k]] + f[x[k:]]), k) for k in range(1, len(x))) for x in kept}
        order = sorted(kept, key=lambda x: (-best[x][0], -f[x], " ".join(x).encode()))[:top]
        out += [(lang, i, " ".join(x), f[x], f[x[: best[x][1]]], f[x[best[x][1] :]], n[lang], best[x][0]) for i, x in enumerate(order, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["a", "b", "c", "Dd", "é", "ÉA", "x-y", "0", "\x1c", "😀"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!?"]) for _ in range(n))
    rows = [(text(rng.randrange(60)), rng.choice(["en", "fr", None])) for _ in range(80)]
    return [*rows, *rows[:9], (None, "en"), ("", None), (" .\t", "xx"), ("la la la la la la", "und"), (text(5000), "en"), ("word " * 3000, "de")]


def table_of(spark, rows):
    return spark.createDataFrame([(i % 7, t, lang, "x", "x", "x", "x", "x") for i, (t, lang) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("size", [40, 250_000])
def test_phrases_equal_plain_counts(spark, rows, size, monkeypatch):
    monkeypatch.setattr(phrases, "RANGE_BYTES", 1000)
    monkeypatch.setattr(phrases, "SHARD_WORDS", size)
    docs = table_of(spark, rows).repartition(3)
    counts, n = phrase_counts(docs, least=3)
    wanted, total = grams(rows)
    assert {(r.lang, r.phrase): (r.words, r.f) for r in counts.collect()} == {
        (lang, " ".join(x)): (len(x), a) for lang, f in wanted.items() for x, a in f.items() if a >= 3
    }
    assert {r.lang: r.n for r in n.collect() if r.n} == {k: v for k, v in total.items() if v}
    found = sorted(tuple(r) for r in mine_phrases(docs, top=20, least=3).collect())
    assert len(found) > 40 and found == brute(rows, 20, 3)


def test_no_phrases(spark):
    empty = mine_phrases(table_of(spark, [("x", "en")]).limit(0))
    assert empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and empty.count() == 0
    assert mine_phrases(table_of(spark, [(None, None), ("one two", "en")])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 5))
def test_states_hold_all_substrings(ids, depth):
    automaton = SuffixAutomaton(np.array(ids, np.int64), np.arange(len(ids)) == 0, 4, depth)
    found, ends_of = Counter(), {}
    for ends, shortest, n, k in automaton.states():
        for end, least, count in zip(ends.tolist(), shortest.tolist(), n.tolist(), strict=True):
            for j in range(least, k + 1):
                word = tuple(ids[end - j + 1 : end + 1])
                assert word not in found and len(word) == j
                found[word] = count
                ends_of[word] = (end, k)
    wanted = Counter(tuple(ids[i : i + k]) for k in range(1, depth + 1) for i in range(len(ids) - k + 1))
    assert found == wanted


def test_words_of_slices():
    words, new = words_of(pa.array(["zz", "A b.C", None, "", " d\te!", "F"]).slice(1))
    assert words.to_pylist() == [b"a", b"b", b"c", b"d", b"e", b"f"] and new.tolist() == [True, False, True, True, False, True]
    assert [len(x) for x in words_of(pa.array([], pa.string()))] == [0, 0]
