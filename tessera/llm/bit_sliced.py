"""Exact top-k inner products over a bit-sliced index.

The index holds the vectors in row blocks. Within a block each quantised attribute is a stack of
bitmaps, one for each binary digit (slice). A query's score is the sum of its attributes times its
own digits: the slices of the attributes with a digit set are added with bitmap arithmetic (ripple
carries over whole bitmaps, pairs of attributes at a time), which gives the slices of the scores; the
query's digits are 1, 0 and -1 with no two others side by side, which leaves the fewest to add. The
k best rows are then selected from the most significant slice downward; rows that tie on the border
are resolved exactly, by their integer scores and ids.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import bounded, importable, materialize, table

SCALE = 256
K = 5
#: Rows of an index block (a multiple of 64) and queries that are scored together.
BLOCK_ROWS = 32_768
QUERY_ROWS = 256
#: Components of an index block at most, so that one of long vectors has fewer rows (64 at least).
BLOCK_CELLS = 1 << 21
#: Tiles of the grid on which blocks meet batches of queries; a block takes about BLOCK_WEIGHT times the bytes of a batch.
TILES, BLOCK_WEIGHT = 4096, 20
#: Magnitude from which integers have no slices, and scores are not added up from slices but in integers of any length.
LIMIT = 1 << 62
INDEX = "dim int, n int, ids binary, lows binary, digits int, slices binary"
QUERIES = "dim int, batch long, ids binary, x binary"
INDEX_ARROW = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("lows", pa.binary()), ("digits", pa.int32()), ("slices", pa.binary())])
QUERIES_ARROW = pa.schema([("dim", pa.int32()), ("batch", pa.int64()), ("ids", pa.binary()), ("x", pa.binary())])


def slice_block(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least value of each attribute, slices[attribute, digit, word]) of integers x[row, attribute]."""
    lows = x.min(0)
    rest = (x - lows).astype(np.uint64)
    digits = max(1, int(rest.max(initial=0)).bit_length())
    words = -(-len(x) // 64)
    bits = np.zeros((x.shape[1], digits, words * 64), np.uint8)
    for d in range(digits):
        bits[:, d, : len(x)] = ((rest >> np.uint64(d)) & np.uint64(1)).T
    return lows, np.packbits(bits, axis=2, bitorder="little").view("<u8")


def add_slices(terms: np.ndarray) -> np.ndarray:
    """Slices of the sum over the first axis of terms[term, digit, word]."""
    while len(terms) > 1:
        odd = terms[-1:] if len(terms) % 2 else None
        a, b = terms[0 : len(terms) - 1 : 2], terms[1::2]
        out = np.empty((len(a) + (odd is not None), a.shape[1] + 1, a.shape[2]), a.dtype)
        carry = np.zeros((len(a), a.shape[2]), a.dtype)
        for d in range(a.shape[1]):
            either = a[:, d] ^ b[:, d]
            out[: len(a), d] = either ^ carry
            carry = (a[:, d] & b[:, d]) | (either & carry)
        out[: len(a), -1] = carry
        if odd is not None:
            out[-1, :-1], out[-1, -1] = odd[0], 0
        terms = out
    return terms[0]


def signed_digits(q: np.ndarray) -> list[np.ndarray]:
    """Digits 1, 0 and -1 of integers, the least first; of two neighbours one is 0."""
    out = []
    while q.any():
        digit = np.where(q & 1, 2 - (q & 3), 0)
        out.append(digit)
        q = (q - digit) >> 1
    return out


def score_slices(slices: np.ndarray, inverted: np.ndarray, lows: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, int]:
    """(slices of score - offset, offset) of the integer query q against a block; inverted is ~slices.

    Attributes with a negative digit are complemented, so that only non-negative terms add up.
    """
    most = (1 << slices.shape[1]) - 1
    offset = int(q @ lows)
    total = np.zeros((1, slices.shape[2]), np.uint64)
    digits = signed_digits(q)
    for d in range(len(digits) - 1, -1, -1):  # Horner's rule over the query's digits
        total = np.concatenate([np.zeros((1, slices.shape[2]), np.uint64), total])
        more, less = np.flatnonzero(digits[d] > 0), np.flatnonzero(digits[d] < 0)
        if len(more) or len(less):
            offset -= (len(less) << d) * most
            part = add_slices(np.concatenate([slices[more], inverted[less]]))
            width = max(len(total), len(part))
            both = np.zeros((2, width, slices.shape[2]), np.uint64)
            both[0, : len(total)], both[1, : len(part)] = total, part
            total = add_slices(both)
    return total, offset


def select_top(total: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k rows with the largest score among the bitmap `rows`; of rows that tie on the border, the first."""
    sure, maybe = np.zeros_like(rows), rows.copy()
    count = 0
    for d in range(len(total) - 1, -1, -1):
        with_digit = maybe & total[d]
        n = int(np.bitwise_count(with_digit).sum())
        if count + n > k:
            maybe = with_digit
        else:
            sure |= with_digit
            count += n
            maybe &= ~total[d]
            if count == k:
                break
    border = np.flatnonzero(np.unpackbits(maybe.view(np.uint8), bitorder="little"))[: k - count]
    return np.concatenate([np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little")), border])


def values_at(slices: np.ndarray, lows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The integers of some rows of a block, from its slices."""
    bits = (slices[:, :, places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
    return ((bits << np.arange(slices.shape[1], dtype=np.uint64)[None, :, None]).sum(1).astype(np.int64) + lows[:, None]).T


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), x.alias("x"))
    return rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & fine & (F.size("x") > 0))


def _integer(x: float, scale: int) -> int:
    """floor(scale * x) of any finite x."""
    product = x * scale
    return math.floor(product) if math.isfinite(product) else int(x) * scale


def _matrix(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, quantised vectors) for each dimension in a batch; vectors with a component of LIMIT or more come apart, as Python integers."""
    x, ids = batch.column("x"), batch.column("id").to_numpy(zero_copy_only=False)
    dims = np.diff(x.offsets.to_numpy())
    for dim in np.unique(dims):
        own = np.flatnonzero(dims == dim)
        values = x.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), dim)
        with np.errstate(over="ignore"):
            scaled = np.floor(values * scale)
        narrow = (np.abs(scaled) < LIMIT).all(1)
        if narrow.any():
            yield int(dim), ids[own[narrow]], scaled[narrow].astype(np.int64)
        if not narrow.all():
            yield int(dim), ids[own[~narrow]], np.array([[_integer(v, scale) for v in row] for row in values[~narrow].tolist()], object)


def _written(x: np.ndarray) -> bytes:
    """Integers of 64 bits as they are after a 0, of any length as text after a 1."""
    return b"\1" + " ".join(map(str, x.ravel())).encode() if x.dtype == object else b"\0" + x.astype("<i8").tobytes()


def _read(data: bytes, dim: int) -> np.ndarray:
    x = np.frombuffer(data, "<i8", offset=1) if data[:1] == b"\0" else np.array([int(v) for v in data[1:].split()], object)
    return x.reshape(-1, dim)


def _sortable(score: int) -> str:
    """Text that is in order as the integers are."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99_999 - len(digits):05d}" + digits.translate(_NINES)


_NINES = str.maketrans("0123456789", "9876543210")


def build_index(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of the bit-sliced index of all valid vectors, each sorted by id."""
    importable(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(ids, kind="stable")
            if x.dtype == object:  # no digits: the integers themselves
                lows, digits, slices = b"", 0, _written(x[order])
            else:
                lows, slices = slice_block(x[order])
                lows, digits, slices = lows.astype("<i8").tobytes(), slices.shape[1], slices.tobytes()
            row = (dim, len(ids), ids[order].astype("<i8").tobytes(), lows, digits, slices)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, INDEX_ARROW.types, strict=True)], schema=INDEX_ARROW)

        for batch in batches:
            for dim, ids, x in _matrix(batch, scale):
                if x.dtype == object:
                    yield block(dim, ids, x)
                    continue
                own, most = held.setdefault(dim, []), min(block_rows, max(64, BLOCK_CELLS // dim // 64 * 64))
                own.append((ids, x))
                if sum(len(i) for i, _ in own) >= most:
                    ids, x = (np.concatenate(p) for p in zip(*own, strict=True))
                    whole = len(ids) // most * most
                    for at in range(0, whole, most):
                        yield block(dim, ids[at : at + most], x[at : at + most])
                    held[dim] = [(ids[whole:], x[whole:])]
        for dim, own in held.items():
            ids, x = (np.concatenate(p) for p in zip(*own, strict=True))
            if len(ids):
                yield block(dim, ids, x)

    return _valid(vectors, id_col, vector_col).mapInArrow(bounded(run), INDEX)


def batch_queries(queries: DataFrame, scale: int, id_col: str, vector_col: str, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Valid queries, one for each id, quantised, in batches of at most query_rows of one dimension."""
    importable(queries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, x in _matrix(batch, scale):
                for at in range(0, len(ids), query_rows):
                    row = (dim, int(ids[at]), ids[at : at + query_rows].astype("<i8").tobytes(), _written(x[at : at + query_rows]))
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, QUERIES_ARROW.types, strict=True)], schema=QUERIES_ARROW)

    once = _valid(queries, id_col, vector_col).groupBy("id").agg(F.min("x").alias("x"))
    return once.mapInArrow(bounded(run), QUERIES)


def grid(blocks: int, batches: int, tiles: int = TILES) -> tuple[int, int]:
    """(rows, columns) into which blocks and batches are dealt, about `tiles` tiles at most.

    Blocks are copied for each column and batches for each row, so the grid that moves the fewest bytes
    has columns to rows as the batches' bytes are to the blocks'.
    """
    tiles = max(1, min(tiles, blocks * batches))
    columns = min(batches, max(1, round(math.sqrt(tiles * batches / max(1, BLOCK_WEIGHT * blocks)))))
    rows = max(1, min(blocks, tiles // max(1, columns)))
    return rows, max(1, min(batches, tiles // rows))


class Block:
    """A block of the index, scored query by query."""

    def __init__(self, dim: int, n: int, ids: bytes, lows: bytes, digits: int, slices: bytes) -> None:
        self.n, self.ids, self.lows = n, np.frombuffer(ids, "<i8"), np.frombuffer(lows, "<i8")
        self.exact: np.ndarray | None = None  # Python integers, where they are needed
        self.slices = None
        if digits:
            self.slices = np.frombuffer(slices, "<u8").reshape(dim, digits, -1)
            self.inverted = ~self.slices
            self.largest = np.maximum(np.abs(self.lows.astype(float)), np.abs(self.lows + float((1 << digits) - 1)))
            self.everything = np.packbits(np.arange(self.slices.shape[2] * 64) < n, bitorder="little").view("<u8")
        else:
            self.exact = _read(slices, dim)

    def best(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        """Places and scores of the k best rows without the query's own."""
        own = range(*np.searchsorted(self.ids, [query_id, query_id + 1]))
        if self.slices is not None and q.dtype != object and np.abs(q.astype(float)) @ self.largest < LIMIT:
            total, _ = score_slices(self.slices, self.inverted, self.lows, q)
            rows = self.everything.copy()
            for at in own:
                rows[at >> 6] &= ~np.uint64(1 << (at & 63))
            places = select_top(total, rows, k)
            return places, (values_at(self.slices, self.lows, places) @ q).tolist()
        if self.exact is None:
            self.exact = values_at(self.slices, self.lows, np.arange(self.n)).astype(object)
        scores = (self.exact @ q.astype(object)).tolist()
        places = heapq.nsmallest(k, (i for i in range(self.n) if i not in own), key=lambda i: (-scores[i], i))
        return np.array(places, np.int64), [scores[i] for i in places]


def topk_blocks(index: DataFrame, batches: DataFrame, k: int) -> DataFrame:
    """Each query's k best rows of each block (score null where it is no long, and `place`, a text in the order of the scores);
    blocks meet all batches of queries of their dimension, tile by tile of a grid."""

    def run(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in pairs:
            for at in range(pair.num_rows):
                get = lambda name, pair=pair, at=at: pair.column(name)[at].as_py()
                block = Block(*map(get, ("dim", "n", "ids", "lows", "digits", "slices")))
                query_ids = np.frombuffer(get("query_ids"), "<i8")
                out: list[tuple] = []
                for query_id, q in zip(query_ids.tolist(), _read(get("x"), get("dim")), strict=True):
                    places, scores = block.best(query_id, q, k)
                    out += [(query_id, vec_id, x if -(1 << 63) <= x < 1 << 63 else None, _sortable(x)) for vec_id, x in zip(block.ids[places].tolist(), scores, strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["query_id", "vec_id", "score", "place"])

    rows, columns = grid(index.count(), batches.count())
    tile = lambda name, n, key: F.pmod(F.xxhash64(key), F.lit(n)).alias(name)
    every = lambda name, n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias(name)
    dealt = batches.withColumnRenamed("ids", "query_ids").select("*", tile("column", columns, "batch")).select("*", every("row", rows))
    copies = index.select("*", tile("row", rows, "ids")).select("*", every("column", columns))
    return copies.join(dealt, ["dim", "row", "column"]).mapInArrow(bounded(run), "query_id long, vec_id long, score long, place string")


def bit_sliced_topk(
    vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Returns query_id, rank (from 1), vec_id, score: each query's k best rows, ties to the smaller id.

    * Components become floor(scale * x); the score is the integer inner product. A query is never
      its own candidate: rows with its id are left out.
    * Vectors that are null or empty, or hold null or non-finite components, and rows without an id
      take no part; queries meet vectors of their own dimension only.
    * Rows that repeat an id are candidates each; a repeated query is answered once, for the
      least of its valid vectors. Fewer than k candidates are all returned; an empty table gives an
      empty result. Other columns are not read.
    * All arithmetic is exact for any finite components. Where a component or a score of a block might reach 2**62, that block and query
      are taken in Python integers; a score that is no long is null, in its right rank. Vectors
      may have any length; a block of the index has BLOCK_CELLS components at most, or 64 rows.
    """
    index = materialize(build_index(vectors, scale, id_col, vector_col, block_rows), "bit-slices", compression="none")
    batches = materialize(batch_queries(queries, scale, id_col, vector_col, query_rows), "bit-queries")
    best = topk_blocks(index, batches, k)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("place"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 of all vectors for the queries whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return bit_sliced_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP8_SQL = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM valid q, valid c
  WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""
