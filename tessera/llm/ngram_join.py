"""Similarity join on word n-grams by chosen paths.

Texts with equal n-gram sets are one set; what follows handles sets. A min-hash signature turns a set
into COORDINATES tokens. In every run the sets are split on a few sampled coordinates: those that share
the token there go down the same path. Buckets that are small, or whose sets are alike in the mean, are
compared all with all; the others are split again on other coordinates. Runs are repeated until a pair
at the threshold is met with the target probability. The comparisons in buckets use signatures, with a
margin, and leave a spanning forest of candidate links; the components of that forest are families in
which all pairs are then compared exactly, block by block, counting links without ever writing pairs.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from fractions import Fraction
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_groups, bounded, importable, materialize, table, to_keys, without
from tessera.llm.components import components

WORDS = 5
THRESHOLD = Fraction(4, 5)
#: Tokens of a signature, and how many of them must agree for a candidate link: at the threshold 51
#: agree in the mean with a deviation of 3.2, so a true link has fewer with a chance of about 2e-6.
COORDINATES = 64
AGREEING = 36
#: Buckets up to BUCKET sets are compared at once. Larger ones are split again unless their sets agree in
#: ALIKE of the tokens in the mean, so that splitting them would only multiply them; after SPLITS splits
#: pairs of sets that are not alike are rare, and what is left is compared.
BUCKET = 256
ALIKE = 0.5
SPLITS = 6
TARGET_RECALL = 0.9999
SEED = 11
#: Sets of a bucket (72 bytes each), and bytes of a family's n-grams, that make a chunk; a task holds two
#: chunks. Beyond, every pair of chunks is a block, so that members are sent once for each chunk.
BUCKET_CHUNK, FAMILY_BYTES = 16_384, 16_000_000
#: Sets that are compared by one matrix product.
PIECE = 512
#: Sets in families up to this number are sent to all tasks (16 bytes each); beyond it the join shuffles texts.
BROADCAST_SETS = 500_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK_WORDS = 50_000
_rng = np.random.default_rng(SEED)
_A = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64."""
    if len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ngrams(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams.

    Words are lower-cased and split at white space. A text of fewer words is one n-gram of all its
    words; one without words has none.
    """
    split = text.lower().split()
    if not split:
        return np.empty(0, np.uint64)
    found = []
    for at in range(0, max(1, len(split) - words + 1), _BLOCK_WORDS):
        block = [w.encode() for w in split[at : at + _BLOCK_WORDS + words - 1]]
        raw = np.frombuffer(b" ".join(block), np.uint8).astype(np.uint64) + np.uint64(1)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw * _power(_BASE, len(raw)), dtype=np.uint64)])
        lengths = np.fromiter(map(len, block), np.int64, len(block))
        ends = np.cumsum(lengths + 1) - 1
        n = max(1, len(block) - words + 1)
        starts, stops = (ends - lengths)[:n], ends[min(words, len(block)) - 1 :][:n]
        found.append((upto[stops] - upto[starts]) * _power(_INVERSE, len(raw) + 1)[starts])
    return np.unique(_mixed(np.concatenate(found)))


def signature(grams: np.ndarray) -> np.ndarray:
    """COORDINATES min-hash tokens (32 bits each) of a non-empty set."""
    least = np.full(COORDINATES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(grams), 2048):
        np.minimum(least, (grams[at : at + 2048, None] * _A + _B).min(0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def set_digest(grams: np.ndarray) -> bytes:
    """128-bit hash of a set, taken as its identity."""
    return xxhash.xxh3_128_digest(grams.tobytes())


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows: n-grams take more room than texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def followed(similarity: float, splits: int = SPLITS) -> float:
    """Chance that at least one path follows a pair through all splits.

    A split is on one coordinate, or on two for 1 / THRESHOLD - 1 of the nodes, so that a pair at the
    threshold is followed by one path in the mean.
    """
    two, lost = 1 / float(THRESHOLD) - 1, 0.0
    for _ in range(splits):
        other = 1 - similarity + similarity * lost
        lost = (1 - two) * other + two * other**2
    return 1 - lost


def runs_needed(recall: float = TARGET_RECALL, threshold: float = float(THRESHOLD), splits: int = SPLITS) -> int:
    """Runs after which a pair at the threshold is missed with a chance of 1 - recall at most, if all its buckets are split to the end."""
    return math.ceil(math.log(1 - recall) / math.log(1 - followed(threshold, splits)))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """The columns of docs but text, with digest (null for texts without words and rows without id), n_grams,
    sig, bytes (the lowest byte of each token) and signs (the lowest bit of each)."""
    kinds = {"digest": ("binary", pa.binary()), "n_grams": ("long", pa.int64()), "sig": ("binary", pa.binary()), "bytes": ("binary", pa.binary()), "signs": ("long", pa.int64())}
    schema = docs.drop("text").schema
    for name, (kind, _) in kinds.items():
        schema = schema.add(name, kind)
    rest = docs.drop("text").columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                grams = ngrams(text.as_py() or "", words)
                if not len(grams) or not doc_id.is_valid:
                    rows.append((None,) * len(kinds))
                    continue
                low = (sig := signature(grams)).astype(np.uint8)
                rows.append((set_digest(grams), len(grams), sig.tobytes(), low.tobytes(), int(np.packbits(low & 1).view("<i8")[0])))
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            arrays = [*map(batch.column, rest), *(pa.array(c, t) for c, (_, t) in zip(columns, kinds.values(), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.mapInArrow(bounded(run), schema)


def mean_agreement(size: Column, ones: list[Column]) -> Column:
    """Unbiased estimate of the share of tokens in which two sets of a bucket agree, from the number of one-bits of each sign."""
    excess = sum(((2 * n - size) * (2 * n - size) - size for n in ones), F.lit(0))
    return excess / (len(ones) * size * (size - 1))


def chosen_paths(sets: DataFrame, runs: int, splits: int, bucket: int, seed: int) -> DataFrame:
    """(key, node, size): the buckets of all runs whose sets are to be compared, of two sets at least."""
    rng = random.Random(seed)
    roots = [(r, c) for r in range(runs) for c in rng.sample(range(COORDINATES), 1 + (rng.random() < 1 / float(THRESHOLD) - 1))]
    token = "substring(sig, 4 * {} + 1, 4)"
    paths = sets.select("key", F.explode(F.array(*(F.xxhash64(F.lit(r * COORDINATES + c), F.expr(token.format(c))) for r, c in roots))).alias("node"))
    done = None
    for level in range(1, splits + 1):
        sizes = materialize(paths.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), f"sizes-{level}")
        paths = materialize(to_keys(paths, sizes, "node", "size").select("key", "node", "size"), f"paths-{level}")
        largest = sizes.agg(F.max("size")).first()[0] or 0
        ready = paths if level == splits or largest <= bucket else paths.where(F.col("size") <= bucket)
        done = ready if done is None else done.unionByName(ready)
        if level == splits or largest <= bucket:
            break
        large = paths.where(F.col("size") > bucket)
        ones = large.join(sets.select("key", "signs"), "key").groupBy("node", "size").agg(*(F.sum(F.shiftright("signs", i).bitwiseAND(F.lit(1))).alias(f"s{i}") for i in range(COORDINATES)))
        alike = mean_agreement(F.col("size").cast("double"), [F.col(f"s{i}") for i in range(COORDINATES)]) >= ALIKE
        told = materialize(ones.select("node", "size", alike.alias("alike")), f"alike-{level}")
        paths = to_keys(large.drop("size"), told, "node", "size")
        done, paths = done.unionByName(paths.where("alike").select("key", "node", "size")), paths.where("NOT alike")
        if not told.where("NOT alike").limit(1).count():
            break
        # one coordinate, or two for every fourth node
        more = F.when(F.pmod(F.xxhash64("node"), F.lit(4)) == 0, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        split = paths.join(sets.select("key", "sig"), "key").select("key", "node", "sig", F.explode(more).alias("j"))
        split = split.withColumn("c", F.pmod(F.xxhash64("node", "j"), F.lit(COORDINATES)))
        paths = split.select("key", F.xxhash64("node", "c", F.expr(token.format("cast(c as int)"))).alias("node"))
    return done


def n_chunks(size: Column | str, chunk: int) -> Column:
    return F.ceil(F.col(size) / chunk).cast("int")


def in_chunks(members: DataFrame, group: str, chunks: Column) -> DataFrame:
    """members with `block` and `side`: each pair of a group's chunks is a block, also a chunk with itself."""
    dealt = members.withColumn("chunk", F.pmod(F.xxhash64("key", group), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    block = F.xxhash64(group, F.least("chunk", "other"), F.greatest("chunk", "other"))
    return dealt.withColumn("block", block).withColumn("side", F.when(F.col("chunk") == F.col("other"), -1).otherwise((F.col("chunk") > F.col("other")).cast("int"))).drop("chunk", "other")


def sketch_forest(keys: np.ndarray, low: np.ndarray, agreeing: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the candidate links among the sets of a bucket; pairs already joined are not compared."""
    label = np.arange(len(keys))
    for p in range(len(keys) - 1):
        others = p + 1 + np.flatnonzero(label[p + 1 :] != label[p])
        if not len(others):
            if (label == label[0]).all():
                return
            continue
        near = others[(low[others] == low[p]).sum(1) >= agreeing]
        for q in near:
            if label[q] != label[p]:
                yield int(keys[p]), int(keys[q])
                label[label == label[q]] = label[p]


def candidate_links(buckets: DataFrame, sets: DataFrame, agreeing: int) -> DataFrame:
    """(a, b): candidate links that connect every bucket's similar sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, rows in arrow_groups(batches, "block"):
            keys = rows.column("key").to_numpy()
            low = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            out.extend(sketch_forest(keys, low, agreeing))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    dealt = in_chunks(buckets, "node", n_chunks("size", BUCKET_CHUNK)).join(sets.select("key", "bytes"), "key").select("block", "key", "bytes")
    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(bounded(run), "a long, b long")


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Whether sets[left[i]] and sets[right[j]] have at least the Jaccard similarity `threshold`, exactly."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, gram, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen > 1
    place = np.cumsum(shared) - 1
    keep = shared[gram]
    owner, gram = owner[keep], place[gram[keep]]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    common = np.zeros((len(left), len(right)), np.float32)
    n = int(shared.sum())
    for a, b in pairwise([*range(0, n, 1024), n]):
        lo, hi = np.searchsorted(gram, [a, b])
        has = np.zeros((len(sets), b - a), np.float32)
        has[owner[lo:hi], gram[lo:hi] - a] = 1
        common += has[left] @ has[right].T
    return common * (threshold.numerator + threshold.denominator) >= threshold.numerator * (sizes[left][:, None] + sizes[right][None, :])


def join_labels(label: np.ndarray, linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Gives places left[i] and right[j] with linked[i, j], and all that share their labels, the least of those labels."""
    for i in np.flatnonzero(linked.any(1)):
        met = np.unique(label[np.append(right[linked[i]], left[i])])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]


def exact_links(members: DataFrame, threshold: Fraction) -> DataFrame:
    """(key, root, links): per block and set with links, their number and a set that it is connected to.

    members has block, side (-1: all pairs, else pairs of side 0 and 1), key and grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in arrow_groups(batches, "block"):
            keys, at = np.unique(rows.column("key").to_numpy(), return_index=True)
            side = rows.column("side").to_numpy()[at]
            raw = rows.column("grams")
            sets = [np.frombuffer(raw[int(i)].as_buffer(), "<u8") for i in at]
            # sets of like sizes come together: pieces that differ too much in size have no links
            order = np.argsort([len(s) for s in sets], kind="stable")
            left, right = order[side[order] <= 0], order[side[order] != 0]
            links, label = np.zeros(len(keys), np.int64), np.arange(len(keys))
            for i in range(0, len(left), PIECE):
                for j in range(i if len(side) and side[0] < 0 else 0, len(right), PIECE):
                    a, b = left[i : i + PIECE], right[j : j + PIECE]
                    smaller, larger = sorted([(len(sets[a[0]]), len(sets[a[-1]])), (len(sets[b[0]]), len(sets[b[-1]]))])
                    if smaller[1] * threshold.denominator < larger[0] * threshold.numerator:
                        continue
                    own = np.unique(np.concatenate([a, b]))
                    linked = linked_pairs([sets[k] for k in own], np.searchsorted(own, a), np.searchsorted(own, b), threshold)
                    linked &= a[:, None] != b[None, :]
                    links[a] += linked.sum(1)
                    if side[0] >= 0 or i != j:
                        links[b] += linked.sum(0)
                    join_labels(label, linked, a, b)
            has = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(keys[has]), pa.array(keys[label[has]]), pa.array(links[has])], ["key", "root", "links"])

    return members.repartition("block").sortWithinPartitions("block").mapInArrow(bounded(run), "key long, root long, links long")


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: Fraction = THRESHOLD,
    recall: float = TARGET_RECALL, seed: int = SEED,
) -> DataFrame:
    """Returns a row for each row of docs: doc_id, class_id, n_links, n_copies.

    * Texts are linked when the Jaccard similarity of their word n-gram sets is at least `threshold`.
      class_id is the least id among all documents that are connected by links; n_links the number of
      other n-gram sets (different texts) that a document's is linked to, n_copies the number
      of documents with its own set, itself included.
    * A null or empty text has no n-grams: it is linked to nothing, is its own class and has one copy.
      A row without id takes no part; its class_id is null. Rows that repeat an id count as copies
      if their texts are equal, else each text stands for itself.
    * Links found are verified exactly; a pair is met with a chance of `recall` at least, and its
      documents still get one class if others connect them. An empty table gives an empty result.
    * Whole texts are read, of any length: a text's n-grams are hashed block by block, and 8 bytes for
      each distinct one are held by the tasks that compare it.
    * A third of all documents may be copies (aggregated before anything else) or near copies of each
      other. Those are compared without writing pairs: a family of n bytes of n-grams is cut into
      n / FAMILY_BYTES chunks and sent once for each of them.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return _classes(rows, words, threshold, recall, seed)


def _classes(rows: DataFrame, words: int, threshold: Fraction, recall: float, seed: int) -> DataFrame:
    """ngram_join() of rows of doc_id and text; further columns are carried along."""
    importable(rows.sparkSession)
    named = rows.drop("text").columns
    drawn = materialize(sketches(rows, words), "sketches")
    given = drawn.where("digest IS NOT NULL")
    sets = given.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_copies"), *(F.first(c).alias(c) for c in ("n_grams", "sig", "bytes", "signs")))
    # numbered as they are written, so that the number can't change
    sets = materialize(sets.withColumn("key", F.monotonically_increasing_id()), "sets")
    buckets = chosen_paths(sets, runs_needed(recall, float(threshold)), SPLITS, BUCKET, seed)
    candidates = components(candidate_links(buckets, sets, AGREEING), "a", "b").withColumnRenamed("node", "key")
    candidates = materialize(candidates.join(sets.select("key", "first", "digest", "n_grams"), "key"), "candidates")
    sizes = materialize(candidates.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum(8 * F.col("n_grams")).alias("bytes")), "family-sizes")
    members = materialize(to_keys(candidates, sizes, "label", "size").select("key", "label", "first", "digest", n_chunks("bytes", FAMILY_BYTES).alias("chunks")), "families")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            found = [ngrams(t.as_py() or "", words) for t in batch.column("text")]
            # a repeated id may have other texts as well
            own = np.array([set_digest(g) == d for g, d in zip(found, batch.column("digest").to_pylist(), strict=True)], bool)
            arrays = [batch.column("key"), batch.column("label"), batch.column("chunks"), pa.array([g.tobytes() for g in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "label", "chunks", "grams"]).filter(pa.array(own))

    few = members.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS
    wanted = members.withColumnRenamed("first", "doc_id")
    texts = rows.join(F.broadcast(wanted) if few else wanted, "doc_id").select("key", "label", "chunks", "digest", "text")
    full = texts.mapInArrow(bounded(grams), "key long, label long, chunks int, grams binary")
    verified = materialize(exact_links(in_chunks(full, "label", F.col("chunks")), threshold), "verified")
    classes = components(verified, "key", "root")
    links = verified.groupBy("key").agg(F.sum("links").alias("n_links"))
    own = sets.select("key", "digest", "first", "n_copies").join(classes.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    own = materialize(own.withColumn("label", F.coalesce("label", "key")), "own-classes")
    least = materialize(own.groupBy("label").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("size")), "class-ids")
    info = to_keys(own, least, "label", "size").select("digest", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    out = [*named, "class_id", "n_links", "n_copies"]
    with_words = to_keys(given.select(*named, "digest"), materialize(info, "classes"), "digest", "n_copies").select(out)
    without_words = drawn.where("digest IS NULL").select(*named, F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("n_copies"))
    return with_words.unionByName(without_words)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with all their columns, of each class of ngram_join() only that with the least id.

    Rows go by id and text: of an id with several texts only those go that are near copies of another's.
    """
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), digest.alias("text_digest"))
    dropped = _classes(rows, WORDS, THRESHOLD, TARGET_RECALL, SEED).where("doc_id <> class_id")
    return without(docs, dropped, (F.col(id_col).cast("bigint"), "doc_id"), (digest, "text_digest"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and links of all documents."""
    return ngram_join(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS words FROM documents
), g AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))) END AS grams FROM w
), s AS MATERIALIZED (
  SELECT min(doc_id) AS rep, count(*) AS n_copies, len(grams) AS n, grams FROM g WHERE len(grams) > 0 GROUP BY grams
), p AS MATERIALIZED (SELECT rep, n, unnest(grams) AS gram FROM s
), l AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.gram = b.gram AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)
), c(rep, reached) AS (
  SELECT rep, rep FROM s UNION SELECT c.rep, l.b FROM c JOIN l ON c.reached = l.a
), k AS (SELECT rep, min(reached) AS class_id FROM c GROUP BY rep
), d AS (SELECT a AS rep, count(*) AS n_links FROM l GROUP BY a)
SELECT g.doc_id, coalesce(k.class_id, g.doc_id) AS class_id, CAST(coalesce(d.n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(s.n_copies, 1) AS BIGINT) AS n_copies
FROM g LEFT JOIN s ON g.grams = s.grams LEFT JOIN k ON k.rep = s.rep LEFT JOIN d ON d.rep = s.rep
"""
