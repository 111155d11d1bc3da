"""Vector search: exact top-k by cosine, recall of an approximation (see ann.py), stores of embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from tessera.functions.vectors import stub_embed
from tessera.operators.ranking import QUERY_BLOCK, dealt, top_k


#: Vectors that are compared with a block of queries at once, those of a slice where there are several blocks, and the queries of such a block.
PIECE, SLICE_ROWS, BLOCK_QUERIES = 4096, 20_000, 8192


def _by_length(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of lists their places, their values, a row each, and whether none of them is null."""
    lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(np.int64)
    flat = lists.flatten()
    values, null = flat.cast(pa.float64()).to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
    ends, out = np.cumsum(np.maximum(lengths, 0)), {}
    for length in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        at = (ends[rows] - length)[:, None] + np.arange(length)
        out[length] = rows, values[at], ~null[at].any(axis=1)
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * x[:, j]
    return np.sqrt(out)


def _pairs(q: np.ndarray, x: np.ndarray, asks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Inner products of pairs, added up in the order of the components as vectors.dot() does, so that equal vectors have equal ones."""
    out = np.zeros(len(asks))
    for at in range(0, len(asks), PAIRS):
        own, there, part = asks[at : at + PAIRS], places[at : at + PAIRS], out[at : at + PAIRS]
        for j in range(x.shape[1]):
            part += q[own, j] * x[there, j]
    return out


#: Similarities that are looked at together, pairs that are scored together, and norms between which single precision is trusted.
TILE, PAIRS, TRUSTED = 1 << 22, 1 << 18, (1e-100, 1e100)


class Nearest:
    """The k best of all vectors met so far for each of some queries, as vectors.cosine() scores them, ties to the smaller key; a key that is met twice counts once.

    Similarities in single precision, whose error is bounded, say which pairs can be among the k best, and only these are scored.
    Where norms leave that bound, all pairs are. A score is null where a component is; it comes last, and one that is not a number first.
    """

    def __init__(self, q: np.ndarray, k: int, whole: np.ndarray | None = None) -> None:
        self.q, self.k, self.norms = q, k, _norms(q)
        self.whole = np.ones(len(q), bool) if whole is None else whole
        self.unit, self.trusted = self._units(q, self.norms, self.whole)
        self.error = 2 * (q.shape[1] + 8) * 2.0**-23
        self.order, self.keys = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)  # as Spark sorts scores
        self.scores, self.n = np.zeros((len(q), k)), np.zeros(len(q), np.int64)

    @staticmethod
    def _units(x: np.ndarray, norms: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors in single precision, and which of them are to be trusted; those of zero are zero."""
        fine = whole & (norms >= TRUSTED[0]) & (norms <= TRUSTED[1])
        unit = np.zeros(x.shape, np.float32)
        unit[fine] = x[fine] / norms[fine, None]
        return unit, fine | (whole & ~(x != 0).any(axis=1))

    def meet(self, x: np.ndarray, keys: np.ndarray, asks: np.ndarray | None = None, whole: np.ndarray | None = None) -> None:
        """Holds vectors x against the queries at the places `asks`, or all."""
        if not len(x):
            return
        norms, whole = _norms(x), np.ones(len(x), bool) if whole is None else whole
        unit, trusted = self._units(x, norms, whole)
        columns, odd = np.ascontiguousarray(unit.T), np.flatnonzero(~trusted)
        step = max(1, TILE // len(x))
        for at in range(0, len(self.q) if asks is None else len(asks), step):
            own = np.arange(at, min(at + step, len(self.q))) if asks is None else asks[at : at + step]
            near = self.unit[own] @ columns
            near[:, odd] = -np.inf
            least = np.where(self.n[own] >= self.k, self.order[own, -1], -np.inf)
            if len(x) > self.k and len(first := np.flatnonzero(least == -np.inf)):
                least[first] = np.partition(near[first], len(x) - self.k, axis=1)[:, len(x) - self.k]
            near[:, odd] = np.inf
            near[~self.trusted[own]] = np.inf
            rows, places = np.nonzero(near >= (least - self.error).astype(np.float32)[:, None])
            rows = own[rows]
            size = self.norms[rows] * norms[places]
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                score = np.where(size == 0, 0.0, _pairs(self.q, x, rows, places) / size)
            self.take(rows, keys[places], np.where(self.whole[rows] & whole[places], score, -np.inf))

    def take(self, asks: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        """Adds scored pairs; a score of minus infinity is a null one."""
        if not len(asks):
            return
        some = np.unique(asks)
        kept = np.arange(self.k) < self.n[some, None]
        rows = np.concatenate([np.repeat(some, self.n[some]), asks])
        keys, scores = np.concatenate([self.keys[some][kept], keys]), np.concatenate([self.scores[some][kept], scores])
        order = np.where(np.isnan(scores), np.inf, scores)
        at = np.lexsort((keys, -order, rows))
        rows, keys, scores, order = rows[at], keys[at], scores[at], order[at]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
        rows, keys, scores, order = rows[fresh], keys[fresh], scores[fresh], order[fresh]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = place < self.k
        rows, place = rows[best], place[best]
        self.order[some] = -np.inf
        self.order[rows, place], self.keys[rows, place], self.scores[rows, place] = order[best], keys[best], scores[best]
        self.n[some] = np.bincount(np.searchsorted(some, rows), minlength=len(some))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, keys, scores, and which of these are null, query by query, the best first."""
        kept = np.arange(self.k) < self.n[:, None]
        scores = self.scores[kept]
        return np.repeat(np.arange(len(self.q)), self.n), self.keys[kept], scores, scores == -np.inf


def _nearest(items: pa.Array, vectors: pa.Array, ids: pa.Array, asked: pa.Array, k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(query, item, score) of the k best of these vectors for each query of their length, as vectors.cosine() scores them."""
    queries = _by_length(asked)
    order = pc.sort_indices(pa.table({"i": items}), [("i", "ascending")], null_placement="at_start").to_numpy()
    places = np.empty(len(order), np.int64)
    places[order] = np.arange(len(order))  # ties go by the items' places in their order
    for length, (rows, x, whole) in _by_length(vectors).items():
        if length not in queries:
            continue
        own, q, q_whole = queries[length]
        best = Nearest(q, k, q_whole)
        for at in range(0, len(rows), PIECE):
            best.meet(x[at : at + PIECE], places[rows[at : at + PIECE]], whole=whole[at : at + PIECE])
        asks, keys, scores, null = best.rows()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(own[asks])), items.take(pa.array(order[keys])), pa.array(scores, pa.float64(), mask=null)], names=names)


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _numbers(df: DataFrame, column: str) -> Column:
    """The column as it is where it holds floats, else as doubles."""
    single = isinstance(df.schema[column].dataType, ArrayType) and isinstance(df.schema[column].dataType.elementType, FloatType)
    return F.col(column) if single else F.col(column).cast("array<double>")


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """query_id, item, score, rank: the k nearest vectors of each query (query_id, q), ties to the smaller id.

    A query of zero norm gets the smallest ids with score 0; vectors of other lengths than the query's take no part.
    One block of queries goes to the tasks, so that vectors stay where they are; larger blocks of more meet slices of the vectors by a shuffle,
    which takes vectors in the precision that they have. Tasks compare batches, or slices, and give the k best of each.
    """
    rows = vectors.select(F.col(id_col).alias("item"), _numbers(vectors, "embedding").alias("_v")).where("_v IS NOT NULL")
    asked = queries.select("query_id", _numbers(queries, "q").alias("_q")).where("_q IS NOT NULL")
    schema = StructType([asked.schema["query_id"], rows.schema["item"], StructField("score", DoubleType())])
    block = asked.limit(QUERY_BLOCK + 1).toArrow()
    if block.num_rows <= QUERY_BLOCK:
        ids, q = _one(block["query_id"]), _one(block["_q"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _nearest(batch.column("item"), batch.column("_v"), ids, q, k, schema.names)

        found = rows.mapInArrow(run, schema)
    else:

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            parts = _nearest(_one(left["item"]), _one(left["_v"]), _one(right["query_id"]), _one(right["_q"]), k, schema.names) if left.num_rows and right.num_rows else ()
            return pa.Table.from_batches(parts, to_arrow_schema(schema))

        by = ["_block", "_slice"]
        sides = dealt(rows, asked, BLOCK_QUERIES, -(-rows.count() // SLICE_ROWS))
        found = sides[0].groupBy(*by).cogroup(sides[1].groupBy(*by)).applyInArrow(meet, schema)
    return top_k(found, ["query_id"], k, F.desc("score"), "item")


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: share of the exact results that were found."""
    hit = exact.select("query_id", "item").join(found.select("query_id", "item", F.lit(1).alias("hit")), ["query_id", "item"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count(F.lit(1)).alias("n"))


def multi_model(results: DataFrame, k: int = 60) -> DataFrame:
    """query_id, item, fused, score: unweighted fusion over models (query_id, model, item, score); score is the best cosine."""
    lists = top_k(results, ["query_id", "model"], 2**31 - 1, F.desc("score"), "item")
    return lists.groupBy("query_id", "item").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("fused"), F.max("score").alias("score"))


def embed_missing(docs: DataFrame, cache: DataFrame, model_id: str, template_hash: str, dimension: int) -> DataFrame:
    """Vectors of rendered documents (chunk_id, rendered): from the cache by (model, template, document hash), else embedded anew."""
    keyed = docs.select("chunk_id", "rendered", F.sha2("rendered", 256).alias("doc_hash"))
    own = cache.where((F.col("model_id") == model_id) & (F.col("template_hash") == template_hash) & (F.size("vector") == dimension)).select("doc_hash", "vector").dropDuplicates(["doc_hash"])
    known = keyed.join(own, "doc_hash").select("chunk_id", "doc_hash", "vector")
    fresh = keyed.join(own, "doc_hash", "left_anti").select("chunk_id", "doc_hash", stub_embed(dimension)(F.col("rendered")).alias("vector"))
    both = known.unionByName(fresh)
    return both.select("chunk_id", F.lit(model_id).alias("model_id"), F.lit(template_hash).alias("template_hash"), "doc_hash", "vector")
