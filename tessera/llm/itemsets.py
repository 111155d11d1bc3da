"""Closed frequent itemsets of baskets and their rules, by N-lists of prefix trees, one suffix class at a time.

Items are ordered by falling support (ties: rising id). The class of an item holds, of every basket
with it, the items before it, so that each itemset is counted in the class of its last item alone.
A class is a prefix tree whose nodes have pre- and post-order codes; the N-list of an item is the
list of its nodes, and lists are merged linearly by the containment of codes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_groups, bounded, importable, materialize, table

#: An itemset is frequent with so many baskets at least, and with one in PARTS of all baskets.
LEAST, PARTS = 5, 20_000
#: A rule holds for 60 of 100 baskets with its left side at least.
CONFIDENCE = 60
#: Rows of a frequent item's many baskets are dealt over so many parts of its join with the items.
SALTS = 32

NList = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # pre, post, baskets, digest of the baskets


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scattered over their whole range."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SuffixClass:
    """The prefix tree of one class: prefixes are lists of items, each with a number of baskets."""

    def __init__(self, items: np.ndarray, ends: np.ndarray, counts: np.ndarray, least: int) -> None:
        """items: those of all prefixes on end, of which the n-th ends before ends[n]. Only items of `least` baskets or more are kept."""
        rows = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        ids, at = np.unique(items, return_inverse=True)
        n = np.bincount(at, weights=counts[rows], minlength=len(ids)).astype(np.int64)
        order = np.lexsort((ids, -n))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        kept = n[at] >= least
        at, rows = place[at[kept]], rows[kept]
        #: Item ids by falling number of baskets within the class; a place in this list stands for the item.
        self.items = ids[order][: int((n >= least).sum())].tolist()
        self.place = {item: i for i, item in enumerate(self.items)}
        by_row = np.lexsort((at, rows))
        paths: dict[tuple[int, ...], list[int]] = {}
        at, rows = at[by_row], rows[by_row]
        cut = np.flatnonzero(np.diff(rows)) + 1
        digests = _mixed(np.arange(len(ends)))
        for path, row in zip(np.split(at, cut), rows[np.concatenate(([0], cut))] if len(rows) else (), strict=False):
            total = paths.setdefault(tuple(path.tolist()), [0, 0])
            total[0] += int(counts[row])
            total[1] += int(digests[row])
        self._code(paths)

    def _code(self, paths: dict[tuple[int, ...], list[int]]) -> None:
        """Numbers the nodes before and after their descendants; paths in order make a walk of the tree."""
        nodes: dict[int, list[list[int]]] = defaultdict(list)  # by item, in pre-order
        stack: list[tuple[int, list[int]]] = []
        pre = post = 0
        for path in sorted(paths):
            shared = 0
            while shared < min(len(stack), len(path)) and stack[shared][0] == path[shared]:
                shared += 1
            while len(stack) > shared:
                stack.pop()[1][1] = post
                post += 1
            for item in path[shared:]:
                node = [pre, 0, 0, 0]
                pre += 1
                nodes[item].append(node)
                stack.append((item, node))
            n, digest = paths[path]
            for _, node in stack:
                node[2] += n
                node[3] += digest
        while stack:
            stack.pop()[1][1] = post
            post += 1
        mask = (1 << 64) - 1
        self.lists: dict[int, NList] = {
            item: (
                np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.int64),
                np.array([x[2] for x in own], np.int64), np.array([x[3] & mask for x in own], np.uint64),
            )
            for item, own in nodes.items()
        }

    @staticmethod
    def merged(above: NList, below: NList) -> NList | None:
        """Nodes of `above` that contain nodes of `below`, with what those hold; both lists rise by pre."""
        at = np.searchsorted(above[0], below[0]) - 1
        inside = (at >= 0) & (above[1][at] > below[1])
        at = at[inside]
        if not len(at):
            return None
        first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
        own = at[first]
        return above[0][own], above[1][own], np.add.reduceat(below[2][inside], first), np.add.reduceat(below[3][inside], first)

    def support(self, places: list[int]) -> int:
        """Baskets of the class that hold all these items, by merging their lists from the last one up."""
        places = sorted(places)
        found: NList | None = self.lists[places[-1]]
        for item in reversed(places[:-1]):
            found = found and self.merged(self.lists[item], found)
        return int(found[2].sum()) if found else 0

    def closed(self, total: int, least: int) -> Iterator[tuple[list[int], int]]:
        """Itemsets (places) that no further item of the class has in all their baskets, with their baskets.

        The empty itemset has `total` baskets. Extensions go from the last item up, so that of
        two sets of the same baskets the larger comes first, and a set within one found before ends its branch.
        """
        found: dict[tuple[int, int], list[frozenset[int]]] = defaultdict(list)
        singles = [(i, self.lists[i]) for i in range(len(self.items))]
        whole = [i for i, own in singles if int(own[2].sum()) == total]
        yield whole, total
        rest = [(i, own) for i, own in reversed(singles) if i not in set(whole)]
        todo = [([*whole, i], own, rest[at + 1 :]) for at, (i, own) in enumerate(rest)][::-1]
        while todo:
            places, own, above = todo.pop()
            n, digest = int(own[2].sum()), int(own[3].sum(dtype=np.uint64))
            longer = [(i, both) for i, lists in above if (both := self.merged(lists, own))]
            in_all = {i for i, both in longer if int(both[2].sum()) == n}
            mine = frozenset(places) | in_all
            if any(mine <= x for x in found[n, digest]):
                continue
            found[n, digest].append(mine)
            yield sorted(mine), n
            branch = [(i, both) for i, both in longer if i not in in_all and int(both[2].sum()) >= least]
            names = dict(above)
            todo += [([*mine, i], both, [(j, names[j]) for j, _ in branch[at + 1 :]]) for at, (i, both) in enumerate(branch)][::-1]


#: sups and rest go with items: an item's support, and that of the others (null for the last one in order).
CLOSED = "last long, items array<long>, sups array<long>, rest array<long>, support long, root boolean"
CLOSED_ARROW = pa.schema([
    ("last", pa.int64()), ("items", pa.list_(pa.int64())), ("sups", pa.list_(pa.int64())), ("rest", pa.list_(pa.int64())), ("support", pa.int64()), ("root", pa.bool_()),
])
ASKED_ARROW = pa.schema([("items", pa.list_(pa.int64())), ("support", pa.int64())])


def _class_of(group: pa.Table, least: int) -> tuple[SuffixClass, np.ndarray, np.ndarray]:
    """The tree of a class, and its items and their supports."""
    prefixes = group.column("prefix").combine_chunks()
    flat = prefixes.flatten()
    items, sups = (flat.field(i).to_numpy(zero_copy_only=False) for i in (1, 0))
    ends = np.cumsum(prefixes.value_lengths().to_numpy(zero_copy_only=False))
    return SuffixClass(items, ends, group.column("n").to_numpy(), least), items, -sups


def _mine(least: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for last, group in arrow_groups(batches, "last"):
            own = int(group.column("last_n")[0].as_py())
            tree, items, sups = _class_of(group, least)
            support = dict(zip(items.tolist(), sups.tolist(), strict=True)) | {last: own}
            rows = []
            for at, (places, n) in enumerate(tree.closed(own, least)):
                ids = sorted([last, *(tree.items[p] for p in places)])
                if len(ids) > 1:
                    without = lambda i, places=places: tree.support([p for p in places if tree.items[p] != i]) if len(places) > 1 else own
                    rows.append((last, ids, [support[i] for i in ids], [None if i == last else without(i) for i in ids], n, at == 0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), CLOSED_ARROW.types, strict=True)], schema=CLOSED_ARROW)

    return run


def _answer(least: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for last, group in arrow_groups(batches, "last"):
            asked = [x for x in group.column("asked").to_pylist() if x is not None]
            tree, _, _ = _class_of(group.filter(group.column("asked").is_null()), least)
            found = [tree.support([tree.place[i] for i in items if i != last]) for items in asked]
            yield pa.RecordBatch.from_arrays([pa.array(asked, ASKED_ARROW.types[0]), pa.array(found, pa.int64())], schema=ASKED_ARROW)

    return run


def _key(items: Column | str) -> Column:
    return F.array_join(F.transform(items, lambda i: i.cast("string")), ",")


def frequent_itemsets(
    lines: DataFrame, basket_col: str, item_col: str, least: int = LEAST, parts: int = PARTS, confidence: int = CONFIDENCE
) -> DataFrame:
    """Closed itemsets with support >= least and support * parts >= baskets; rows: items (ascending), support, baskets, rules.

    * rules has a struct (c, a, s) for each item c, ascending, of an itemset of two or more, with
      100 * support >= confidence * a and support * baskets > a * s, where a is the support of the
      other items and s that of c. Products are decimals, so that none overflows.
    * Rows with a null basket or item are left out; rows that repeat both count once; ids are read as long. Ties of support in the order
      of items go by id and don't change the result. An empty table gives an empty result; other columns are not read.
    * An itemset is closed if it is closed within the class of its last item and no closed one of the same support becomes it
      without its own last item: cutting a closure from its end visits every set that it closes and that is closed in its class.
    * Nothing is broadcast or sent to the driver but the number of baskets. Frequent items meet the lines by (item, part),
      so that an item of a third of all baskets is dealt out. That item comes first in the order and has an empty class; equal
      prefixes are added up before they are dealt to classes. A basket has at most as many frequent items as
      there are, which are fewer than parts * (distinct lines / baskets); its prefixes grow with the square of that.
    """
    spark = lines.sparkSession
    importable(spark)
    pairs = materialize(
        lines.select(F.col(basket_col).cast("long").alias("basket"), F.col(item_col).cast("long").alias("item")).dropna().distinct(), "basket-pairs"
    )
    baskets = pairs.select("basket").distinct().count()
    least = max(least, -(-baskets // parts))
    items = materialize(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), "basket-items")
    dealt = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("basket"), F.lit(SALTS)).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "item")))
    sets = salted.join(dealt.hint("merge"), ["item", "salt"]).groupBy("basket").agg(ordered.alias("t")).where(F.size("t") > 1)
    at = sets.select("t", F.posexplode("t").alias("pos", "x")).where("pos > 0")
    prefixes = at.select(F.col("x.item").alias("last"), (-F.col("x.order")).alias("last_n"), F.slice("t", 1, F.col("pos")).alias("prefix"))
    classes = materialize(prefixes.groupBy("last", "last_n", "prefix").agg(F.count(F.lit(1)).alias("n")), "basket-classes")

    mined = classes.repartition("last").sortWithinPartitions("last").mapInArrow(bounded(_mine(least)), CLOSED)
    local = materialize(mined.withColumn("key", _key("items")), "itemsets-of-classes")
    single = F.array("item")
    sets = local.select("key", "items", "sups", "rest", "last", "support").unionByName(
        items.select(_key(single).alias("key"), single.alias("items"), F.array("n").alias("sups"), F.array(F.lit(None).cast("long")).alias("rest"), F.col("item").alias("last"), F.col("n").alias("support"))
    )
    cut = local.select(_key(F.array_remove("items", F.col("last"))).alias("key"), "support")
    roots = local.where("root").select(F.col("last").cast("string").alias("key"), "support")
    closed = materialize(sets.join(cut.union(roots).distinct(), ["key", "support"], "left_anti"), "itemsets-closed")

    # the support without the last item is known for pairs, and else counted in the class of the last but one
    before = F.array_sort(F.filter(F.arrays_zip((F.transform("sups", lambda n: -n)).alias("order"), F.col("items").alias("item")), lambda x: x["item"] != F.col("last")))
    asked = (
        closed.where(F.size("items") > 2).select(F.element_at(before, -1)["item"].alias("last"), F.array_remove("items", F.col("last")).alias("asked")).distinct()
    )
    wanted = classes.join(asked.select("last").distinct().hint("merge"), "last", "left_semi")
    both = wanted.select("last", "prefix", "n", F.lit(None).cast("array<long>").alias("asked")).unionByName(
        asked.select("last", F.lit(None).cast(classes.schema["prefix"].dataType).alias("prefix"), F.lit(None).cast("long").alias("n"), "asked")
    )
    told = both.repartition("last").sortWithinPartitions("last").mapInArrow(bounded(_answer(least)), "items array<long>, support long")
    told = told.select(_key("items").alias("key_before"), F.col("support").alias("before"))
    alone = F.filter(F.arrays_zip("items", "sups"), lambda x: x["items"] != F.col("last"))
    joined = closed.withColumn("key_before", _key(F.array_remove("items", F.col("last")))).join(told.hint("merge"), "key_before", "left")
    before = F.when(F.size("items") == 2, F.element_at(alone, 1)["sups"]).otherwise(F.col("before"))
    long = "decimal(19,0)"
    holds = lambda x: (F.lit(100) * F.col("support").cast(long) >= F.lit(confidence) * x["a"]) & (F.col("support").cast(long) * F.lit(baskets) > x["a"].cast(long) * x["s"])
    whole = F.transform(
        F.arrays_zip("items", "rest", "sups"),
        lambda x: F.struct(x["items"].alias("c"), F.coalesce(x["rest"], before).alias("a"), x["sups"].alias("s")),
    )
    rules = F.when(F.size("items") > 1, F.filter(whole, holds)).otherwise(F.array().cast("array<struct<c:long,a:long,s:long>>"))
    return joined.select("items", "support", F.lit(baskets).cast("long").alias("baskets"), rules.alias("rules"))


def digest_rules(sets: DataFrame) -> DataFrame:
    """Itemsets as rows of items (joined ids), n_items, support, n_rules, best_item and rules_sha256."""
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["a"], r["c"])))["c"]
    shown = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["c"], r["a"], r["s"])), ";")
    return sets.select(
        _key("items").alias("items"), F.size("items").cast("long").alias("n_items"), "support", F.size("rules").cast("long").alias("n_rules"),
        best.alias("best_item"), F.sha2(shown, 256).alias("rules_sha256"),
    )


def op12_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed frequent itemsets of all sale lines and their rules."""
    return digest_rules(frequent_itemsets(table(spark, sf_dir, "sale_lines"), "sale_id", "item_id"))


#: Level by level over occurrences: every frequent itemset, without classes or trees.
OP12_SQL = f"""
WITH RECURSIVE p AS (SELECT DISTINCT sale_id AS b, item_id AS i FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL),
n AS (SELECT count(DISTINCT b) AS n FROM p),
f AS (SELECT b, i, s FROM (SELECT *, count(*) OVER (PARTITION BY i) AS s FROM p) WHERE s >= {LEAST} AND s * {PARTS} >= (SELECT n FROM n)),
l AS (
  SELECT [i] AS x, b, s FROM f
  UNION ALL
  SELECT x, b, s FROM (
    SELECT list_append(l.x, f.i) AS x, l.b AS b, count(*) OVER (PARTITION BY l.x, f.i) AS s FROM l JOIN f ON f.b = l.b AND f.i > l.x[-1]
  ) WHERE s >= {LEAST} AND s * {PARTS} >= (SELECT n FROM n)
),
a AS (SELECT DISTINCT x, s FROM l), one AS (SELECT x[1] AS i, s FROM a WHERE len(x) = 1),
d AS (SELECT x, s, c, list_filter(x, lambda e: e <> c) AS rest FROM (SELECT x, s, unnest(x) AS c FROM a WHERE len(x) > 1)),
open AS (SELECT DISTINCT a.x FROM a JOIN d ON d.rest = a.x AND d.s = a.s),
r AS (
  SELECT d.x, d.c, a.s AS a, one.s AS s FROM d JOIN a ON a.x = d.rest JOIN one ON one.i = d.c
  WHERE 100 * d.s >= {CONFIDENCE} * a.s AND d.s * (SELECT n FROM n) > a.s * one.s
), g AS (SELECT x, count(*) AS n, min_by(c, [a, c]) AS best, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS shown FROM r GROUP BY x)
SELECT array_to_string(a.x, ',') AS items, len(a.x)::BIGINT AS n_items, a.s AS support, coalesce(g.n, 0)::BIGINT AS n_rules, g.best AS best_item, sha256(coalesce(g.shown, '')) AS rules_sha256
FROM a LEFT JOIN g USING (x) WHERE a.x NOT IN (SELECT x FROM open)
"""
