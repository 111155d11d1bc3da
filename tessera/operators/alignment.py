"""Fuzzy matching by alignment: dynamic programming over Arrow batches, behind a filter by characters.

A query's words are matched one by one as subsequences of a target. A match counts POINTS for each character and a bonus
for where it stands: after a space or at the start, after a separator, at a change of case or to digits, or right after the character
before; a gap costs. The best alignment counts, and the words' points add up. Words without upper case match any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from tessera.operators.ranking import QUERY_BLOCK

# Points of a character and of its place, costs of a gap's first and further characters.
POINTS, GAP, LONGER = 16, 3, 1
AFTER_SPACE, AFTER_SEPARATOR, AFTER_OTHER, NEW_CASE, IN_RUN, FIRST = 10, 9, 8, 5, 4, 2
SEPARATORS = "/,:;|"
PREVIEW_BYTES = 200
NONE = -(10**6)
#: Tasks a core.
TASKS = 4
#: Places of texts that are aligned together, and what lies between texts in sums over their places.
CELLS, APART = 1 << 16, 1 << 40


def preview(text: str) -> str:
    """The characters that end within the first PREVIEW_BYTES bytes."""
    return text[:PREVIEW_BYTES].encode("utf-8", "replace")[:PREVIEW_BYTES].decode("utf-8", "ignore")


def lowered(text: str) -> str:
    """The text in lower case, character by character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Subsequences:
    """Where each character of an alphabet stands next after each place of texts, which are rows of characters padded beyond their length."""

    def __init__(self, x: np.ndarray, length: np.ndarray, alphabet: set[str]) -> None:
        n, self.width = x.shape
        codes = np.array(sorted(map(ord, alphabet)), np.uint32)
        self.place = {chr(c): i for i, c in enumerate(codes.tolist())}
        at = np.minimum(np.searchsorted(codes, x), max(len(codes) - 1, 0))
        known = (codes[at] == x) & (np.arange(self.width) < length[:, None]) if len(codes) else np.zeros(x.shape, bool)
        # after[p, i, row]: the place after the next character i from p on; width + 1 if there is none
        self.after = np.full((self.width + 2, len(codes), n), self.width + 1, np.int16 if self.width < 32_000 else np.int32)
        for p in range(self.width - 1, -1, -1):
            self.after[p] = self.after[p + 1]
            rows = np.flatnonzero(known[:, p])
            self.after[p, at[rows, p], rows] = p + 1

    def holding(self, words: list[str], rows: np.ndarray) -> np.ndarray:
        """Those of `rows` whose texts hold each of the words as a subsequence."""
        for word in words:
            at = np.zeros(len(rows), np.int64)
            for c in word:
                if not len(rows):
                    return rows
                at = self.after[at, self.place[c], rows]
                alive = at <= self.width
                if not alive.all():
                    rows, at = rows[alive], at[alive]
        return rows


#: Entries of a table of next places, which bounds the texts that are looked at together.
NEXT_PLACES = 1 << 24


def pieces(texts: list[str], alphabet: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts, with their starts, whose table of next places stays within NEXT_PLACES, or of one text."""
    start, width = 0, 0
    for i, t in enumerate(texts):
        wider = max(width, len(t))
        if i > start and (i - start + 1) * (wider + 2) * max(alphabet, 1) > NEXT_PLACES:
            yield start, texts[start:i]
            start, wider = i, len(t)
        width = wider
    if start < len(texts):
        yield start, texts[start:]


def characters(texts: list[str]) -> np.ndarray:
    """Texts as rows of characters, padded by zeros."""
    width = max(map(len, texts), default=0)
    return np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(texts), width)


def matches(texts: list[str], queries: list[list[str]]) -> Iterator[tuple[int, np.ndarray]]:
    """(query, places of texts): which texts hold each of a query's words as a subsequence; queries without any are left out."""
    alphabet = set("".join(w for words in queries for w in words))
    for start, part in pieces(texts, len(alphabet)):
        x = characters(part)
        table, every = Subsequences(x, np.array([len(t) for t in part]), alphabet), np.arange(len(part))
        for i, words in enumerate(queries):
            if len(rows := table.holding(words, every)):
                yield i, rows + start


class Targets:
    """Texts of a batch as matrices of characters, the places' bonuses, and a mask of the characters of each."""

    def __init__(self, texts: list[str]) -> None:
        self.exact, self.low = characters(texts), characters([lowered(t) for t in texts])
        self.length = np.array([len(t) for t in texts], np.int64)
        self.bonus = self._bonuses()

    def _bonuses(self) -> np.ndarray:
        x = self.exact
        space = (x == 32) | ((x >= 9) & (x <= 13))
        digit = (x >= 48) & (x <= 57)
        upper = self.low != x
        word = digit | ((self.low >= 97) & (self.low <= 122)) | (x > 127)
        separator = np.isin(x, [ord(c) for c in SEPARATORS])
        before = lambda kind, start: np.concatenate([np.full((len(x), 1), start), kind[:, :-1]], axis=1) if x.shape[1] else kind
        turned = (upper & before(word & ~upper & ~digit, False)) | (digit & ~before(digit, False))
        inner = np.where(before(space, True), AFTER_SPACE, np.where(before(separator, False), AFTER_SEPARATOR, np.where(~before(word, True), AFTER_OTHER, np.where(turned, NEW_CASE, 0))))
        return np.where(word, inner, np.where(space, AFTER_SPACE, AFTER_OTHER)).astype(np.int32)

    def points(self, word: str, rows: np.ndarray) -> np.ndarray:
        """Points of a word's best alignment with the texts in `rows`, NONE where it is no subsequence."""
        if not len(rows):
            return np.zeros(0, np.int32)
        x, needle = self.low if lowered(word) == word else self.exact, np.array([ord(c) for c in word], np.uint32)
        width = int(self.length[rows].max())
        step = max(1, CELLS // max(width, 1))
        return np.concatenate([self._aligned(x[rows[at : at + step], :width], self.bonus[rows[at : at + step], :width], needle) for at in range(0, len(rows), step)])

    @staticmethod
    def _aligned(x: np.ndarray, bonus: np.ndarray, needle: np.ndarray) -> np.ndarray:
        """Character by character of the needle, on the places that hold it and can be reached: points with it there, and the run's bonus.

        A gap's cost grows evenly, so the best place before one is a running maximum over a text's places.
        """
        n, width = x.shape
        x, bonus = np.ascontiguousarray(x), np.ascontiguousarray(bonus).ravel()
        place = here = run = row = None
        for c in needle:
            found = np.flatnonzero(x == c)
            own, its = bonus[found].astype(np.int64), found // max(width, 1)
            at = found + 2 * its  # a place of all texts, which are two apart
            if place is None:
                place, here, run, row = at, POINTS + FIRST * own, own, its
                continue
            if not len(place):
                break
            # points and what a gap to this place would save, texts apart by more than these can be
            best = np.maximum.accumulate(here + LONGER * place + row * APART)
            after = np.searchsorted(place, at - 1)  # places before the last one
            gap, next_ = np.maximum(after - 1, 0), np.minimum(after, len(place) - 1)
            far, near = (after > 0) & (row[gap] == its), place[next_] == at - 1
            apart = np.where(far, np.maximum(best[gap] - its * APART - LONGER * (at - 2) - GAP, 0) + own, NONE)
            carried = np.maximum(np.maximum(run[next_], IN_RUN), np.where(own >= AFTER_OTHER, own, 0))
            joined = np.where(near, here[next_] + np.maximum(carried, own), NONE)
            kept = np.flatnonzero(far | near)
            place, here, run, row = at[kept], (np.maximum(joined, apart) + POINTS)[kept], np.where(joined > apart, carried, own)[kept], its[kept]
        out = np.full(n, NONE, np.int32)
        if len(place):
            rows, starts = np.unique(row, return_index=True)
            out[rows] = np.maximum.reduceat(here, starts)
        return out


def batch_points(columns: list[list[str]], queries: list[list[str]]) -> np.ndarray:
    """points[query, row]: the best target's sum over the query's words, 0 where no target has all of them.

    Only texts that hold all words of a query as subsequences are aligned with them.
    """
    out = np.zeros((len(queries), len(columns[0])), np.int64)
    exact, low = ([[w for w in words if (lowered(w) == w) == small] for words in queries] for small in (False, True))
    cased = any(map(any, exact))
    for texts in columns:
        targets = Targets(texts)
        # words in upper case are looked for in texts as they stand
        held = {(i, r) for i, rows in matches(texts, exact) for r in rows.tolist()} if cased else None
        for i, rows in matches([lowered(t) for t in texts], low):
            if held is not None and exact[i]:
                rows = np.array([r for r in rows.tolist() if (i, r) in held], np.int64)
            total = np.zeros(len(rows), np.int64)
            for word in queries[i]:
                found = targets.points(word, rows)
                total = np.where((total >= 0) & (found >= 0), total + found, NONE)
            out[i, rows] = np.maximum(out[i, rows], total)
    return out


class Best:
    """Which matches of a task can be among the first `limit` of a query by exactness and points, ties all of them; those of most points always stay."""

    def __init__(self, queries: int, limit: int) -> None:
        self.keys, self.most = np.full((queries, limit), -1, np.int64), np.zeros(queries, np.int64)

    def staying(self, at: np.ndarray, points: np.ndarray, exact: np.ndarray) -> np.ndarray:
        """Of matches (queries' places in order, points) those that stay."""
        keys = points + (exact.astype(np.int64) << 40)
        starts = np.searchsorted(at, np.arange(len(self.keys) + 1))
        for i in np.unique(at).tolist():
            own = slice(starts[i], starts[i + 1])
            both = np.concatenate([self.keys[i], keys[own]])
            self.keys[i] = np.partition(both, len(both) - self.keys.shape[1])[len(both) - self.keys.shape[1] :]
            self.most[i] = max(self.most[i], points[own].max())
        least = self.keys.min(axis=1) if self.keys.shape[1] else np.full(len(self.keys), np.iinfo(np.int64).max)
        return (keys >= least[at]) | (points >= self.most[at])


def aligned_pairs(small: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """query_id, item, _points, _exact of all matches of chunks (item, file_path, symbol, _preview) and queries (query_id, query).

    Queries go to the tasks in blocks of QUERY_BLOCK, each of which reads the chunks once, dealt out by their items, as a small file of many
    chunks would be one task; only matches come back, and with a limit of each query's only those that can be among its first in a task.
    """
    schema = StructType([queries.schema["query_id"], small.schema["item"], StructField("_points", IntegerType()), StructField("_exact", BooleanType())])
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    dealt = small.select("item", "file_path", "symbol", "_preview").repartition(TASKS * small.sparkSession.sparkContext.defaultParallelism, "item")
    out = None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else queries
        asked = [(r.query_id, r.query, r.query.split()) for r in own.select("query_id", "query").collect()]

        def run(parts: Iterator[pd.DataFrame], asked=asked) -> Iterator[pd.DataFrame]:
            best = None if limit is None else Best(len(asked), limit)
            low = [query.lower() for _, query, _ in asked]
            for part in parts:
                symbols = part["symbol"].fillna("").tolist()
                columns = [part["file_path"].fillna("").tolist(), symbols, [preview(t) for t in part["_preview"].fillna("")]]
                points = batch_points(columns, [words for _, _, words in asked]) if len(part) and asked else np.zeros((0, 0), np.int64)
                at, rows = np.nonzero(points)
                symbols = [t.lower() for t in symbols]
                exact, points = np.array([symbols[r] == low[i] for i, r in zip(at.tolist(), rows.tolist(), strict=True)], bool), points[at, rows]
                if best is not None:
                    stay = best.staying(at, points, exact)
                    at, rows, points, exact = at[stay], rows[stay], points[stay], exact[stay]
                yield pd.DataFrame({"query_id": [asked[i][0] for i in at], "item": part["item"].to_numpy()[rows], "_points": points.astype("int32"), "_exact": exact})

        found = dealt.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out
