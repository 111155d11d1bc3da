"""Approximate nearest vectors by navigable graphs in cells, held as tables.

Vectors are dealt to cells by their nearest pivots, which are a sample of them; a cell has a graph of its own, whose
rows link to near vectors of the cell and, on sparser and sparser layers, to far ones. A query looks into a fixed number
of cells and walks each graph with a beam of fixed width, so that what it meets does not grow with the table; cells of few
vectors, most of which a beam would meet, are compared whole, which takes less than a walk. Of equal vectors one stands in a cell's graph, so that they neither fill a beam nor link to each other only. Removed vectors stay
as stepping stones until a quarter of a cell is dead, and then the cell is built again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.ranking import top_k
from tessera.operators.vector import Nearest, _norms, _one, _pairs, vector_topk
from tessera.sources.work import held

#: Vectors of a cell without its copies, cells that a vector is in and that a query looks into, and pivots that a task compares without an index of their own.
CELL_ROWS, COPIES, PROBES, FLAT_PIVOTS = 4096, 2, 8, 16_384
#: Links of a vector to near ones, to those of each layer, and with those that others have to it.
NEAR, FAR, MOST = 12, 4, 32
#: A vector of LAYER is in the next layer; width of the beam.
LAYER, BEAM = 16, 160
#: Dead vectors from which a cell may be built again, if they are more than a quarter of it.
TOMBSTONES = 1024
#: Vectors of a cell from which on it is walked, those of a task's cells, and queries that a task takes to them.
WALKED, GROUP_ROWS, GROUP_QUERIES = 4096, 32_768, 20_000
#: Similarities to pivots that are looked at together; a prime and a factor that deal cells to groups.
PIVOT_TILE, PRIME, MIXED = 1 << 22, 2**31 - 1, 48_271
#: Vectors that calibrated() asks for, and the share of their nearest ones that it wants found.
CALIBRATION, CALIBRATED = 400, 0.95
#: Doublings of probes that are tried at once.
DOUBLINGS = 4
NODES = "cell long, item long, vector array<float>, links array<long>, dead boolean"
LAYERS_SEED = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class GraphIndex:
    """nodes (cell, item, vector, links, dead) and pivots (cell, vector), both written tables, and the cells that a query looks into (see calibrated())."""

    nodes: DataFrame
    pivots: DataFrame
    dimension: int
    probes: int = PROBES


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _fine(dimension: int) -> Column:
    """Whether a vector takes part: one of this length, without null components or such that are not numbers, not of zero norm."""
    return F.col("vector").isNotNull() & (F.size("vector") == dimension) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v)) & F.exists("vector", lambda v: v != 0)


def _equal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each set of equal vectors, in their order, and for each vector the number of its set."""
    rows = np.ascontiguousarray(x + np.float32(0))  # one zero
    _, first, group = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * rows.itemsize))).ravel(), return_index=True, return_inverse=True)
    order = np.argsort(first)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return first[order], number[group.ravel()]


def _layers(items: np.ndarray) -> list[np.ndarray]:
    """Places of the vectors of each layer above the ground, by a hash of their ids; the last has about LAYER of them."""
    mixed = items.astype(np.uint64) * LAYERS_SEED
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order, out, n = np.argsort(mixed ^ (mixed >> np.uint64(32)), kind="stable"), [], len(items) // LAYER
    while n >= LAYER:
        out.append(np.sort(order[:n]))
        n //= LAYER
    return out or [np.sort(order[: min(len(items), LAYER)])]


def link(items: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """For each of the unit vectors x the places that it links to, the nearest first."""
    n = len(x)
    layers, sources, targets, sims = _layers(items), [], [], []
    for at in range(0, n, 1024):
        near = x[at : at + 1024] @ x.T
        rows = np.arange(len(near))
        near[rows, at + rows] = -2.0  # not itself
        for places, k in ((np.arange(n), NEAR), *((places, FAR) for places in layers)):
            part = near[:, places]
            best = np.argpartition(-part, min(k, part.shape[1]) - 1, axis=1)[:, :k]
            sources.append(np.repeat(at + rows, best.shape[1]))
            targets.append(places[best].ravel())
            sims.append(np.take_along_axis(part, best, 1).ravel())
    source, target, sim = map(np.concatenate, (sources, targets, sims))
    forth = sim > -2.0
    source, target, sim = source[forth], target[forth], sim[forth]
    own = np.concatenate([np.zeros(len(source), bool), np.ones(len(source), bool)])  # a vector's own links come before those to it
    source, target, sim = np.concatenate([source, target]), np.concatenate([target, source]), np.concatenate([sim, sim])
    order = np.lexsort((-sim, own, source))
    cut = np.searchsorted(source[order], np.arange(1, n))
    return [np.array(list(dict.fromkeys(part.tolist()))[:MOST], np.int64) for part in np.split(target[order], cut)]


def walk(x: np.ndarray, links: list[np.ndarray], entries: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and similarities of what a beam of `beam` vectors finds, and how many were met."""
    seen = np.zeros(len(x), bool)
    seen[entries] = True
    first = (x[entries] @ q).tolist()
    todo = [(-s, e) for s, e in zip(first, entries.tolist(), strict=True)]
    heapq.heapify(todo)
    found = heapq.nlargest(beam, ((s, -e) for s, e in zip(first, entries.tolist(), strict=True)))
    heapq.heapify(found)
    while todo:
        s, at = heapq.heappop(todo)
        if len(found) >= beam and -s < found[0][0]:
            break
        fresh = links[at][~seen[links[at]]]
        if not len(fresh):
            continue
        seen[fresh] = True
        for near, place in zip((x[fresh] @ q).tolist(), fresh.tolist(), strict=True):
            if len(found) < beam or near > found[0][0]:
                heapq.heappush(todo, (-near, place))
                (heapq.heappushpop if len(found) >= beam else heapq.heappush)(found, (near, -place))
    return np.array([-p for _, p in found], np.int64), np.array([s for s, _ in found]), int(seen.sum())


def _routed(vectors: DataFrame, pivots: DataFrame, dimension: int, n: int) -> DataFrame:
    """vectors (id, vector) with `cells`: those of their n nearest pivots, the nearest first; very many pivots have an index of their own."""
    if pivots.limit(FLAT_PIVOTS + 1).count() > FLAT_PIVOTS:
        upper = build_index(pivots.select(F.col("cell").alias("item"), "vector"), dimension)
        met = search(upper, vectors.select(F.col("id").alias("query_id"), F.col("vector").alias("q")), n)
        cells = met.groupBy(F.col("query_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("cells"))
        return vectors.join(cells, "id")
    rows = pivots.orderBy("cell").toArrow()  # FLAT_PIVOTS at most
    cells, x = _one(rows["cell"]).to_numpy(), _unit(_matrix(rows["vector"], dimension)).T
    k = min(n, len(cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, best = _unit(_matrix(batch.column("vector"), dimension)), np.empty((batch.num_rows, k), np.int64)
            step = max(1, PIVOT_TILE // max(len(cells), 1))
            for at in range(0, len(q) if k else 0, step):
                best[at : at + step] = _best_columns(q[at : at + step] @ x, k)
            found = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * k, pa.int32()), pa.array(cells[best].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), found], names=["id", "vector", "cells"])

    return vectors.select("id", "vector").mapInArrow(run, "id long, vector array<float>, cells array<long>")


def _matrix(lists: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    return _one(lists).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dimension)


def _best_columns(near: np.ndarray, k: int) -> np.ndarray:
    """For each row the k columns of the largest values, the largest first, ties to the smaller column."""
    if 4 * k > near.shape[1]:
        return np.argsort(-near, axis=1, kind="stable")[:, :k]
    rows, columns = np.nonzero(near >= np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None])
    at = np.lexsort((columns, -near[rows, columns], rows))
    return columns[at][(np.arange(len(rows)) - np.searchsorted(rows, rows)) < k].reshape(-1, k)


def _linked(nodes: DataFrame) -> DataFrame:
    """Nodes with the links of their cells' graphs. Of equal vectors that of the least item has the links, the others link to it."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("item", ignore_index=True)
        items, x = part["item"].to_numpy(), np.stack(part["vector"].to_numpy()).astype(np.float32)
        first, group = _equal(x)
        graph = link(items[first], _unit(x[first]))
        return part.assign(links=[items[first[graph[g]]] if first[g] == at else items[first[g : g + 1]] for at, g in enumerate(group.tolist())])

    return nodes.groupBy("cell").applyInPandas(run, NODES)


def _dealt(vectors: DataFrame, pivots: DataFrame, dimension: int) -> DataFrame:
    """Unlinked nodes of vectors (item, vector), each in the cells of its COPIES nearest pivots, so that one at a border is found from both sides."""
    near = _routed(vectors.select(F.col("item").alias("id"), "vector"), pivots, dimension, COPIES)
    return near.withColumn("cell", F.explode("cells")).select("cell", F.col("id").alias("item"), "vector", F.array().cast("array<long>").alias("links"), F.lit(False).alias("dead"))


def build_index(vectors: DataFrame, dimension: int, cell_rows: int | None = None) -> GraphIndex:
    """An index of vectors (item, vector); null ones, those of another length and those of zero norm take no part, and of a repeated item one stays.

    Pivots are a sample by a hash of the ids, one in `cell_rows`. A cell's graph is built by one task; cells of more than
    4 * cell_rows vectors, as many equal ones make, are split by a hash of the ids, and a query looks into all parts.
    """
    cell_rows = cell_rows or CELL_ROWS
    rows = held(vectors.select(F.col("item").cast("long").alias("item"), F.col("vector").cast("array<float>").alias("vector")).where(F.col("item").isNotNull() & _fine(dimension)).groupBy("item").agg(F.min("vector").alias("vector")), "ann-vectors")
    n = rows.count()
    sample = rows.where(F.pmod(F.xxhash64("item"), F.lit(cell_rows)) == 0) if n > 4 * cell_rows else rows.orderBy(F.xxhash64("item"), "item").limit(max(1, n // cell_rows))
    if sample.limit(1).count() == 0:
        sample = rows.limit(1)
    pivots = held(sample.select(F.col("item").alias("cell"), "vector"), "ann-pivots")
    nodes = held(_dealt(rows, pivots, dimension), "ann-dealt")
    sizes = nodes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * cell_rows)
    wide = nodes.join(F.broadcast(sizes) if sizes.limit(FLAT_PIVOTS + 1).count() <= FLAT_PIVOTS else sizes, "cell")
    part = F.pmod(F.xxhash64(F.lit(1), "item"), F.ceil(F.col("n") / cell_rows))
    # part 0 keeps the cell's name; further parts have names of their own, negative ones, and the cell's pivot
    named = F.when(part == 0, F.col("cell")).otherwise(-1 - F.abs(F.xxhash64("cell", part) % (1 << 62)))
    if sizes.limit(1).count():
        split = held(wide.select(F.col("cell").alias("whole"), named.alias("cell"), "item", "vector", "links", "dead"), "ann-split")
        more = split.where("cell <> whole").select("whole", "cell").distinct().join(pivots.withColumnRenamed("cell", "whole"), "whole").select("cell", "vector")
        pivots = held(pivots.unionByName(more), "ann-pivots")
        nodes = nodes.join(sizes, "cell", "left_anti").unionByName(split.drop("whole"))
    return GraphIndex(held(_linked(nodes), "ann-nodes"), pivots, dimension)


def add(index: GraphIndex, vectors: DataFrame) -> GraphIndex:
    """The index with further vectors (item, vector), which replace those of the same items; only cells that get some are linked anew."""
    index = remove(index, vectors.select("item"))
    fine = vectors.where(F.col("item").isNotNull() & _fine(index.dimension))
    fresh = held(_dealt(fine.select(F.col("item").cast("long").alias("item"), F.col("vector").cast("array<float>").alias("vector")).dropDuplicates(["item"]), index.pivots, index.dimension), "ann-fresh")
    touched = fresh.select("cell").distinct()
    old = index.nodes.join(touched, "cell", "left_semi").where("NOT dead")
    same = index.nodes.join(touched, "cell", "left_anti")
    return GraphIndex(held(same.unionByName(_linked(old.unionByName(fresh))), "ann-nodes"), index.pivots, index.dimension, index.probes)


def remove(index: GraphIndex, items: DataFrame, tombstones: int = TOMBSTONES) -> GraphIndex:
    """The index with these items dead; cells with `tombstones` dead vectors, more than a quarter, are built again without them."""
    gone = items.select(F.col("item").cast("long").alias("item")).distinct().withColumn("_gone", F.lit(True))
    nodes = held(index.nodes.join(gone, "item", "left").withColumn("dead", F.col("dead") | F.coalesce("_gone", F.lit(False))).select("cell", "item", "vector", "links", "dead"), "ann-marked")
    dead = F.count_if("dead")
    full = nodes.groupBy("cell").agg(dead.alias("gone"), F.count(F.lit(1)).alias("n")).where((F.col("gone") >= tombstones) & (F.col("gone") * 4 > F.col("n"))).select("cell")
    again = nodes.join(full, "cell", "left_semi").where("NOT dead")
    return GraphIndex(held(nodes.join(full, "cell", "left_anti").unionByName(_linked(again)), "ann-nodes"), index.pivots, index.dimension, index.probes)


def calibrated(index: GraphIndex, k: int = 10, target: float = CALIBRATED) -> GraphIndex:
    """The index with the least number of cells to look into, doubled from its own on, that finds `target` of the k nearest of a sample.

    The sample are CALIBRATION live vectors by a hash of their ids, compared with all live vectors. The doubling ends where all cells are looked into.
    Each cell is looked into once, those of DOUBLINGS at a time, as what more cells find is added to what fewer have found.
    """
    cells, probes = index.pivots.count(), [index.probes]
    while probes[-1] < cells:
        probes.append(min(2 * probes[-1], cells))
    if len(probes) == 1:
        return index
    live = index.nodes.where("NOT dead").select("item", "vector").dropDuplicates(["item"])
    chosen = live.orderBy(F.xxhash64(F.lit(2), "item"), "item").limit(CALIBRATION)
    sample = held(chosen.select((F.row_number().over(W.orderBy("item")) - 1).cast("long").alias("id"), "vector"), "ann-sample")
    exact = held(vector_topk(live.withColumnRenamed("vector", "embedding"), sample.select(F.col("id").alias("query_id"), F.col("vector").alias("q")), k, "item").select("query_id", "item"), "ann-exact")
    routed, n, found = held(_routed(sample, index.pivots, index.dimension, cells), "ann-order"), exact.count(), 0
    for at in range(0, len(probes) - 1, DOUBLINGS):
        ends = probes[at : min(at + DOUBLINGS, len(probes) - 1)]
        starts = [probes[at - 1] if at else 0, *ends[:-1]]
        step = F.explode(F.array(*(F.struct(F.lit(i).alias("step"), F.slice("cells", a + 1, b - a).alias("cells")) for i, (a, b) in enumerate(zip(starts, ends, strict=True)))))
        parts = routed.select("id", "vector", step.alias("s")).select((F.col("id") * DOUBLINGS + F.col("s.step")).alias("id"), "vector", "s.cells")
        met = _found(index, parts, k, _width(k), len(ends) * CALIBRATION).where("item IS NOT NULL")
        hits = met.select(F.expr(f"query_id DIV {DOUBLINGS}").alias("query_id"), "item", (F.col("query_id") % DOUBLINGS).alias("step")).join(exact, ["query_id", "item"])
        new = dict(hits.groupBy("query_id", "item").agg(F.min("step").alias("step")).groupBy("step").count().collect())
        for i, end in enumerate(ends):
            found += new.get(i, 0)
            if found >= target * n:
                return replace(index, probes=end)
    return replace(index, probes=cells)


def _width(k: int, beam: int | None = None) -> int:
    return max(beam or BEAM, 4 * k)


def _group(cell: Column, groups: int) -> Column:
    """The group of a cell; _group_of() gives the same."""
    return F.pmod(F.pmod(F.pmod(cell, F.lit(PRIME)) * MIXED, F.lit(PRIME)), F.lit(groups)).cast("int")


def _group_of(cells: np.ndarray, groups: int) -> np.ndarray:
    return cells % PRIME * MIXED % PRIME % groups


def _found(index: GraphIndex, asked: DataFrame, k: int, width: int, queries: int) -> DataFrame:
    """query_id, item, score, met: the k best in each group of cells of each query (id, vector, cells), and rows without item that count what was met.

    A query goes once to each group that has cells for it. Links go along only where a cell is walked.
    """
    size = index.nodes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count(F.lit(1)).alias("cells")).first()
    schema = "query_id long, item long, score double, met long"
    if not size.cells:
        return asked.sparkSession.createDataFrame([], schema)
    groups, slices = max(-(-size.n // GROUP_ROWS), min(size.cells, asked.sparkSession.sparkContext.defaultParallelism)), max(1, -(-queries // GROUP_QUERIES))
    dimension, each = index.dimension, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    links = F.col("links") if size.most > WALKED else F.array().cast("array<long>").alias("links")
    cells = index.nodes.select(_group(F.col("cell"), groups).alias("group"), each, "cell", "item", "vector", links, "dead")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("cells")
            flat, rows = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            group = _group_of(flat, groups)
            order = np.lexsort((group, rows))
            flat, key = flat[order], rows[order] * groups + group[order]
            keys, starts = np.unique(key, return_index=True)
            own = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), pa.array(flat, pa.int64()))
            taken = batch.select(["slice", "id", "vector"]).take(pa.array(keys // groups))
            yield pa.RecordBatch.from_arrays([pa.array(keys % groups, pa.int32()), *taken.columns, own], names=["group", "slice", "id", "vector", "cells"])

    sliced = asked.select(F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"), "id", "vector", "cells")
    parts = sliced.mapInArrow(split, "group int, slice int, id long, vector array<float>, cells array<long>")

    def run(nodes: pa.Table, own: pa.Table) -> pa.Table:
        asked_ids, items = _one(own["id"]).to_numpy(zero_copy_only=False), _one(nodes["item"]).to_numpy(zero_copy_only=False)
        best, met = Nearest(_matrix(own["vector"], dimension).astype(float), k), np.zeros(len(asked_ids), np.int64)
        if len(items) and len(asked_ids):
            cell, dead, x = _one(nodes["cell"]).to_numpy(), _one(nodes["dead"]).to_numpy(zero_copy_only=False).astype(bool), _matrix(nodes["vector"], dimension)
            lists = _one(own["cells"])
            wanted, asks = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(asked_ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
            order = np.argsort(wanted, kind="stable")
            wanted, asks = wanted[order], asks[order]
            order = np.lexsort((items, cell))
            names, starts = np.unique(cell[order], return_index=True)
            for name, rows in zip(names.tolist(), np.split(order, starts[1:]), strict=True):
                those = asks[np.searchsorted(wanted, name) : np.searchsorted(wanted, name, side="right")]
                if not len(those):
                    continue
                if len(rows) <= WALKED:
                    rows = rows[~dead[rows]]
                    best.meet(x[rows].astype(float), items[rows], those)
                    met[those] += len(rows)
                else:
                    _walked(items[rows], x[rows], dead[rows], _one(nodes["links"]).take(pa.array(rows)), best, those, met, width)
        at, keys, scores, _ = best.rows()
        return pa.table({
            "query_id": pa.array(np.concatenate([asked_ids, asked_ids[at]]).astype(np.int64)), "item": pa.array(np.concatenate([np.zeros(len(met), np.int64), keys]), mask=np.arange(len(met) + len(keys)) < len(met)),
            "score": pa.array(np.concatenate([np.zeros(len(met)), scores]), mask=np.arange(len(met) + len(keys)) < len(met)), "met": pa.array(np.concatenate([met, np.zeros(len(keys), np.int64)])),
        })

    return cells.groupBy("group", "slice").cogroup(parts.groupBy("group", "slice")).applyInArrow(run, schema)


def _walked(items: np.ndarray, x: np.ndarray, dead: np.ndarray, links: pa.Array, best: Nearest, asks: np.ndarray, met: np.ndarray, width: int) -> None:
    """Walks the graph of a cell, whose rows are in the order of their items, for the queries at the places `asks`."""
    first, group = _equal(x)
    whole, k = x[first].astype(float), best.k
    unit, norms = _unit(x[first]), _norms(whole)
    links = [np.searchsorted(items[first], links[at].values.to_numpy()) for at in first.tolist()]
    entries = _layers(items[first])[-1]
    live = np.flatnonzero(~dead)
    live = live[np.argsort(group[live], kind="stable")]
    starts = np.searchsorted(group[live], np.arange(len(first) + 1))  # a set's live items, the smallest first
    sizes = np.minimum(np.diff(starts), k)
    for at in asks.tolist():
        places, _, n = walk(unit, links, entries, best.unit[at], width)
        met[at] += n
        places = places[sizes[places] > 0]
        near = _pairs(best.q, whole, np.full(len(places), at), places) / (best.norms[at] * norms[places])
        order = np.argsort(-near, kind="stable")
        enough = np.searchsorted(np.cumsum(sizes[places[order]]), k)
        order = order[near[order] >= near[order[min(enough, len(order) - 1)]]] if len(order) else order
        equal = [live[starts[p] : starts[p] + sizes[p]] for p in places[order]]
        best.take(np.full(int(sizes[places[order]].sum()), at), items[np.concatenate([live[:0], *equal])], np.repeat(near[order], sizes[places[order]]))


def search(index: GraphIndex, queries: DataFrame, k: int, beam: int | None = None, probes: int | None = None) -> DataFrame:
    """query_id, item, score (cosine), rank, met: k near vectors of each query (query_id, q), ties to the smaller id; `met` counts the vectors that it was compared with.

    Groups of cells and their queries meet in the groups' tasks, of which a group with many queries has several. A cell of WALKED vectors at most
    is compared whole. What a walk finds is scored as vector_topk() does, so that equal vectors have equal scores in all cells, and the k
    smallest ids of each of them are taken. A query of zero norm gets the smallest ids with score 0; one that is null or of another length has no result.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("id"), F.col("q").cast("array<float>").alias("vector")).where(F.size("vector") == index.dimension)
    zero = asked.where(~F.exists("vector", lambda v: v != 0))
    other = asked.where(F.exists("vector", lambda v: v != 0))
    found = held(_found(index, _routed(other, index.pivots, index.dimension, probes or index.probes), k, _width(k, beam), other.count()), "ann-found")
    least = index.nodes.where("NOT dead").select("item").orderBy("item").limit(k).agg(F.sort_array(F.collect_list("item")).alias("ids"))
    ids = least.first().ids if zero.limit(1).count() else []
    none = zero.select(F.col("id").alias("query_id"), F.explode(F.array(*map(F.lit, ids)) if ids else F.array().cast("array<long>")).alias("item"), F.lit(0.0).alias("score"))
    once = found.where("item IS NOT NULL").groupBy("query_id", "item").agg(F.max("score").alias("score"))
    best = top_k(once.unionByName(none), ["query_id"], k, F.desc("score"), "item")
    return best.join(found.groupBy("query_id").agg(F.sum("met").alias("met")), "query_id", "left").withColumn("met", F.coalesce("met", F.lit(0)))
