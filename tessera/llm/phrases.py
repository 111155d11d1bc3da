"""Phrase collocations: suffix automata per shard of words, counts reduced globally, scores by the weakest cut.

A shard's automaton is held in arrays. Its words are walked by their ends: all occurrences of a word
are one state, which splits by the word before into longer ones, up to a bounded depth. Substrings with the same
occurrences belong to one state, of which only the longest is put out, with the length of the
shortest; the suffix link of a state leads to the state of the next shorter suffix.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import arrow_groups, bounded, importable, materialize, table

#: Words of the longest phrase, and occurrences of a phrase that counts.
DEPTH, LEAST = 4, 30
#: Rows of a language in the report; of a phrase within a longer one that has so many of 100 of its occurrences, only the longer is kept.
TOP, SUBSUMED = 2000, 80
#: Words of a shard, and bytes of text for each range of hashes of word pairs.
SHARD_WORDS, RANGE_BYTES = 500_000, 8_000_000
#: Distinct words whose counts a task adds up before it writes them.
HELD_WORDS = 1_000_000
#: Parts of a language that find their first phrases apart.
RANK_PARTS = 64

#: By byte: 0 belongs to a word, 1 ends it, 2 also ends the piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x09, 0x20]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z in lower case, and whether each begins a piece; nulls are empty texts."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    kind = _KIND[data]
    inside = kind == 0
    begins = np.zeros(len(data) + 1, bool)
    begins[ends - ends[0]] = True  # a text begins
    first = inside & begins[:-1]
    first[1:] |= inside[1:] & ~inside[:-1]
    at = np.flatnonzero(first)
    size = np.cumsum(inside)
    offsets = np.append(size[at] - 1, size[-1] if len(size) else 0).astype(np.int64)
    breaks = np.cumsum((kind == 2) | begins[:-1])[at]
    new = np.ones(len(at), bool)
    new[1:] = breaks[1:] != breaks[:-1]
    body = pa.py_buffer(_LOWER[data[inside]].tobytes())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), body]), new


def _scattered(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shard:
    """Words of one language as numbers into a vocabulary."""

    def __init__(self, lang: str, ids: np.ndarray, new: np.ndarray, vocabulary: pa.Array) -> None:
        self.lang, self.ids, self.new, self.vocabulary = lang, ids, new, vocabulary

    def word_hashes(self) -> np.ndarray:
        seed = xxhash.xxh3_64_intdigest(self.lang)
        return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.vocabulary.to_pylist()], np.uint64)

    def hashes(self, k: int) -> np.ndarray:
        """For each word a 48-bit hash of the k words that end with it, in the upper bits; 0 where a piece begins among them."""
        own = self.word_hashes()[self.ids] if len(self.ids) else np.zeros(0, np.uint64)
        mixed = np.zeros(len(own), np.uint64)
        whole = np.zeros(len(own), bool)
        whole[k - 1 :] = True
        for back in reversed(range(k)):
            mixed[k - 1 :] = _scattered(mixed[k - 1 :] * np.uint64(0x9E3779B97F4A7C15) + own[k - 1 - back : len(own) - back])
            if back < k - 1:
                whole[k - 1 :] &= ~self.new[k - 1 - back : len(own) - back]
        return np.where(whole, (mixed | np.uint64(1 << 16)) & np.uint64(0xFFFFFFFFFFFF0000), np.uint64(0))

    def distinct(self, k: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of k words in order, their counts, the range of each (which rises too), and for each word the place of its hash (-1: none)."""
        own = self.hashes(k) >> np.uint64(16)
        found, at, n = np.unique(own[own > 0], return_inverse=True, return_counts=True)
        places = np.full(len(own), -1)
        places[own > 0] = at
        return found, n, ((found >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32), places

    def live(self, k: int, parts: int, often: list[tuple[int, bytes]]) -> np.ndarray:
        """For each word whether the k words that end with it are frequent; often has a bit for each hash of a range."""
        found, _, of, places = self.distinct(k, parts)
        known = np.zeros(len(found) + 1, bool)  # the last stands for none
        for part, bits in often:
            a, b = np.searchsorted(of, np.array([part, part + 1], of.dtype))
            known[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        return known[places]

    def rows(self, name: str, k: int, parts: int) -> Iterator[tuple]:
        """The shard, and for each range of hashes those of its substrings of k words."""
        words = b"\n".join(self.vocabulary.to_pylist())  # words hold no line break
        yield self.lang, name, None, len(self.ids), _planes(self.ids.astype(np.int32), 4), np.packbits(self.new).tobytes(), words, None, None
        found, n, of, _ = self.distinct(k, parts)
        first = np.flatnonzero(np.diff(of, prepend=np.uint64(2**63)))
        for a, b in zip(first, np.append(first[1:], len(found))[: len(first)], strict=True):
            yield self.lang, name, int(of[a]), None, None, None, None, _planes(found[a:b], 6), _planes(n[a:b].astype(np.uint32), 4)

    @classmethod
    def read(cls, rows: list[dict]) -> tuple[Shard, list[tuple[int, bytes]]]:
        """A shard, and the (range, bits) sent back to it, from the rows with its name."""
        row = next(r for r in rows if r["ids"] is not None)
        ids = _whole(row["ids"], 4, "<i4").astype(np.int64)
        new = np.unpackbits(np.frombuffer(row["new"], np.uint8), count=len(ids)).astype(bool)
        vocabulary = pa.array(row["words"].split(b"\n") if len(ids) else [], pa.binary())
        return cls(row["lang"], ids, new, vocabulary), [(r["part"], r["hashes"]) for r in rows if r["ids"] is None]

    def runs(self, live: np.ndarray) -> Shard:
        """The words that are in live pairs only; a run of them is a piece."""
        kept = live.copy()
        kept[:-1] |= live[1:]
        names, ids = np.unique(self.ids[kept], return_inverse=True)
        return Shard(self.lang, ids, ~live[kept], self.vocabulary.take(pa.array(names)))


class SuffixAutomaton:
    """Generalised suffix automaton of a shard's pieces, for substrings of up to `depth` words.

    Words that are `new` begin a piece. Three words are walked only where their last one is in `live`, if given. Level k
    has the substrings of k words by number, each with its endpos count, one of its ends, and its link: the
    number of its suffix of k - 1 words on the level before.
    """

    def __init__(self, ids: np.ndarray, new: np.ndarray, words: int, depth: int = DEPTH, live: np.ndarray | None = None) -> None:
        self.ids = ids
        self.counts = [np.bincount(ids, minlength=words)]
        self.ends = [np.zeros(words, np.int64)]
        self.ends[0][ids] = np.arange(len(ids))
        self.links = [np.zeros(words, np.int64)]
        ends, state = np.arange(len(ids)), ids
        for k in range(2, depth + 1):
            # a substring of k words ends where one of k - 1 ends, if the first of those doesn't begin a piece
            more = (ends >= k - 1) & ~new[np.maximum(ends - (k - 2), 0)]
            if live is not None and k > 2:
                more &= live[np.maximum(ends - (k - 3), 0)]
            ends, state = ends[more], state[more]
            codes, at, own, n = np.unique(state * words + ids[ends - (k - 1)], return_index=True, return_inverse=True, return_counts=True)
            self.links.append(codes // max(words, 1))
            self.ends.append(ends[at])
            self.counts.append(n)
            state = own

    def states(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """By length of their longest substring: one end of it, the length of the shortest one, the endpos count, the length."""
        shortest = np.ones(len(self.counts[0]), np.int64)
        for k, (n, ends) in enumerate(zip(self.counts, self.ends, strict=True), 1):
            longest = n > 0
            if k < len(self.counts):
                same = self.counts[k] == n[self.links[k]]  # the longer one has all its occurrences
                longest[self.links[k][same]] = False
            yield ends[longest], shortest[longest], n[longest], k
            if k < len(self.counts):
                shortest = np.where(same, shortest[self.links[k]], k + 1)


SHARDS = "lang string, shard string, part long, n long, ids binary, new binary, words binary, hashes binary, counts binary"
SHARDS_ARROW = pa.schema([
    ("lang", pa.string()), ("shard", pa.string()), ("part", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("new", pa.binary()), ("words", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary()),
])


def _planes(x: np.ndarray, width: int) -> bytes:
    """Little-endian numbers of `width` bytes, byte by byte apart, which compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize)[:, :width].T).tobytes()


def _whole(data: bytes, width: int, kind: str) -> np.ndarray:
    out = np.zeros((len(data) // width, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view(kind).ravel()


def batch_of(rows: list[tuple], schema: pa.Schema = SHARDS_ARROW) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _shards(parts: int):  # noqa: ANN202
    """Cuts texts into shards; a shard has a row, and for each range of hashes one with those of its pairs; so have the words of a task."""

    words: dict[str, list[pa.Table]] = {}

    def cut(lang: str, pieces: list[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays([w for w, _ in pieces]).dictionary_encode()
        ids = coded.indices.to_numpy().astype(np.int32)
        shard = Shard(lang, ids, np.concatenate([n for _, n in pieces]), coded.dictionary)
        words.setdefault(lang, []).append(pa.table({"word": coded.dictionary, "n": np.bincount(ids, minlength=len(coded.dictionary))}))
        yield batch_of(list(shard.rows(uuid.uuid4().hex, 2, parts)))

    def counted() -> Iterator[pa.RecordBatch]:
        """What `words` holds, summed, in ranges of the words' hashes."""
        for lang, some in words.items():
            found = pa.concat_tables(some).group_by("word").aggregate([("n", "sum")])
            word, n = found.column("word").combine_chunks(), found.column("n_sum").to_numpy()
            seed = xxhash.xxh3_64_intdigest(lang)
            of = np.array([xxhash.xxh3_64_intdigest(w, seed) % parts for w in word.to_pylist()], np.int64)
            order = np.argsort(of, kind="stable")
            word, n, of = word.take(pa.array(order)).to_pylist(), n[order], of[order]
            first = np.flatnonzero(np.diff(of, prepend=-1))
            rows = [(lang, None, int(of[a]), None, None, None, b"\n".join(word[a:b]), None, _planes(n[a:b], 8)) for a, b in zip(first, np.append(first[1:], len(of)), strict=True)]
            yield batch_of(rows)
        words.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words.clear()
        held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        total = 0
        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                own, new = words_of(batch.filter(pc.equal(batch.column("lang"), lang)).column("text"))
                for at in range(0, len(own), SHARD_WORDS):  # a cut is put where a piece begins, so long pieces make longer shards
                    held.setdefault(lang, []).append((own.slice(at, SHARD_WORDS), new[at : at + SHARD_WORDS]))
                    total += len(held[lang][-1][1])
                    rest = new[at + SHARD_WORDS :]
                    if total >= SHARD_WORDS and (not len(rest) or rest[0]):
                        for name, pieces in held.items():
                            yield from cut(name, pieces)
                        held, total = {}, 0
                        if sum(x.num_rows for some in words.values() for x in some) >= HELD_WORDS:
                            yield from counted()
        for name, pieces in held.items():
            yield from cut(name, pieces)
        yield from counted()

    return run


def _frequent(least: int):  # noqa: ANN202
    """Sums the pairs of a range of hashes over all shards; each shard gets back a bit for each of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in arrow_groups(batches, "part"):
            hashes = [_whole(x, 6, "<u8") for x in group.column("hashes").to_pylist()]
            pairs, own = np.unique(np.concatenate(hashes), return_inverse=True)
            n = np.bincount(own, weights=np.concatenate([_whole(x, 4, "<u4") for x in group.column("counts").to_pylist()]))
            often = (n >= least)[own]
            at = np.cumsum([0, *map(len, hashes)])
            bits = [often[a : a + len(x)] for x, a in zip(hashes, at, strict=False)]
            out = [(shard, part, np.packbits(x).tobytes()) for shard, x in zip(group.column("shard").to_pylist(), bits, strict=True) if x.any()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["shard", "part", "hashes"])

    return run


def _words(least: int):  # noqa: ANN202
    """Sums the words of a range of hashes over all tasks: lang, word, count of those that are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in arrow_groups(batches, "part"):
            for lang in group.column("lang").unique().to_pylist():
                own = group.filter(pc.equal(group.column("lang"), lang))
                word = pa.array([w for x in own.column("words").to_pylist() for w in x.split(b"\n")], pa.binary())
                n = np.concatenate([_whole(x, 8, "<i8") for x in own.column("counts").to_pylist()])
                found = pa.table({"word": word, "n": n}).group_by("word").aggregate([("n", "sum")])
                found = found.filter(pc.greater_equal(found.column("n_sum"), least))
                phrase = found.column("word").cast(pa.string()).combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(phrase)), phrase, found.column("n_sum").combine_chunks()], ["lang", "phrase", "f"])

    return run


def _runs(parts: int):  # noqa: ANN202
    """Cuts shards down to what is in frequent pairs, again with the hashes of their substrings, now of three words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, group in arrow_groups(batches, "shard"):
            shard, often = Shard.read(group.to_pylist())
            yield batch_of(list(shard.runs(shard.live(2, parts, often)).rows(name, 3, parts)))

    return run


def _phrases(parts: int):  # noqa: ANN202
    """The states of each shard's automaton, from two words on: lang, longest phrase, its words, words of the shortest, count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in arrow_groups(batches, "shard"):
            shard, often = Shard.read(group.to_pylist())
            text, ids = shard.vocabulary.cast(pa.string()), shard.ids
            for ends, shortest, n, k in SuffixAutomaton(ids, shard.new, len(text), live=shard.live(3, parts, often)).states():
                if k > 1 and len(ends):
                    phrase = pc.binary_join_element_wise(*(text.take(pa.array(ids[ends - back])) for back in reversed(range(k))), " ")
                    shortest = np.maximum(shortest, 2)  # words are counted apart
                    for a in range(0, len(ends), 20_000):
                        own = slice(a, a + 20_000)
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(pa.scalar(shard.lang), len(ends[own])), phrase.slice(a, 20_000), pa.repeat(pa.scalar(k, pa.int32()), len(ends[own])), pa.array(shortest[own], pa.int32()), pa.array(n[own], pa.int64())],
                            ["lang", "phrase", "words", "shortest", "n"],
                        )

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to DEPTH words with `least` occurrences or more (lang, phrase, words, f), and the words of each language (lang, n).

    * A null text is empty, a null language is `und`; rows that repeat are further occurrences; an empty table gives empty results.
      Texts may have any length; other columns are not read.
    * Texts are read once. Hashes of two neighbouring words, then of three, are summed by ranges of the hash, of which there are the more the more
      text there is; what is frequent goes back to the shards that have it, so that their automata walk few words. Hashes only widen what is
      walked: counts are of the phrases themselves. Words are added up in each task and then by ranges of their hash, so that one
      that all documents share is one entry of each task.
    """
    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + total // RANGE_BYTES
    shards = materialize(rows.mapInArrow(bounded(_shards(parts)), SHARDS), "phrase-shards", compression="zstd")
    words = shards.where("words IS NOT NULL AND ids IS NULL").select("part", "lang", "words", "counts")
    single = words.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(bounded(_words(least)), "lang string, phrase string, f long")
    none = lambda name: F.lit(None).cast(shards.schema[name].dataType).alias(name)

    def with_frequent(shards: DataFrame) -> DataFrame:
        """Shards with the frequent ones of their hashes, by name."""
        sent = shards.where("hashes IS NOT NULL").select("part", "shard", "hashes", "counts").repartition(parts, "part").sortWithinPartitions("part")
        often = sent.mapInArrow(bounded(_frequent(least)), "shard string, part long, hashes binary")
        own = shards.where("ids IS NOT NULL").select("shard", none("part"), "lang", "ids", "new", "words", none("hashes"))
        return own.unionByName(often.select("shard", "part", *map(none, ("lang", "ids", "new", "words")), "hashes")).repartition("shard").sortWithinPartitions("shard")

    runs = materialize(with_frequent(shards).mapInArrow(bounded(_runs(parts)), SHARDS), "phrase-runs", compression="zstd")
    states = with_frequent(runs).mapInArrow(bounded(_phrases(parts)), "lang string, phrase string, words int, shortest int, n long")
    suffixes = F.when(F.col("shortest") == F.col("words"), F.array("words")).otherwise(F.sequence("shortest", "words"))
    each = states.select("lang", "phrase", "words", "n", F.explode(suffixes).alias("k")).select(
        "lang", F.when(F.col("k") == F.col("words"), F.col("phrase")).otherwise(F.expr("substring_index(phrase, ' ', -k)")).alias("phrase"), F.col("k").alias("words"), "n"
    )
    counts = each.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    counts = counts.unionByName(single.select("lang", "phrase", F.lit(1).alias("words"), "f"))
    return materialize(counts, "phrase-counts"), shards.where("ids IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, least: int = LEAST, subsumed: int = SUBSUMED) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    * a, l, r count the phrase and the parts of its lowest-scoring cut, whose score is floor(2000000 * a / (l + r)); ties of
      cuts go to the shorter left part, ties of phrases to more occurrences, then to the phrase in byte order. Products are decimals.
    * A phrase within a longer candidate of `subsumed` in 100 of its occurrences is left out. Longer
      candidates tell their parts by the automaton's links: without their first word, and, as the same holds
      from the other end, without their last one.
    * Null texts and languages, empty tables and further columns: see phrase_counts().
    """
    counts, words = phrase_counts(docs, text_col, lang_col, least)
    found = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    split = F.split("phrase", " ")
    inner = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(0), F.col("words") - 2), lambda i: F.transform(F.sequence(F.lit(2), F.col("words") - i), lambda k: F.array_join(F.slice(split, i + 1, k), " ")))),
        lambda x: x != F.col("phrase"),
    )
    covers = found.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    whole = "decimal(38,0)"
    kept = found.join(covers, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * subsumed)
    )
    cut = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "*", F.array_join(F.slice(split, F.lit(1), F.col("k")), " ").alias("left"), F.expr("array_join(slice(split(phrase, ' '), k + 1, 4), ' ')").alias("right")
    )
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cut = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cut = cut.withColumns({"top": F.col("a").cast(whole) * F.lit(2_000_000).cast("decimal(8,0)"), "sum": (F.col("l") + F.col("r")).cast(whole)}).withColumn("score", F.expr("top div sum"))
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    order = (F.desc("best.score"), F.desc("a"), F.asc("phrase"))
    first = best
    for keys in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))], ["lang"]):
        first = first.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return first.join(words.hint("merge"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", F.col("best.score").alias("score"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents, by language."""
    return mine_phrases(table(spark, sf_dir, "documents"))


#: Every substring of up to four words, counted as it stands.
OP13_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p), n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM o, range(1, {DEPTH + 1}) AS x(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, k, f AS a FROM g WHERE k > 1 AND f >= {LEAST}),
s AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM c, range(1, 4) AS x(i), range(2, 4) AS y(m) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
d AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS k FROM c LEFT JOIN s USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {SUBSUMED} * a),
e AS (
  SELECT d.lang, d.phrase, d.a, d.k, l.f AS l, r.f AS r, (2000000::HUGEINT * d.a) // (l.f + r.f) AS score
  FROM d JOIN g l ON l.lang = d.lang AND l.phrase = array_to_string(d.w[1:d.k], ' ') JOIN g r ON r.lang = d.lang AND r.phrase = array_to_string(d.w[d.k + 1:], ' ')
),
b AS (SELECT lang, phrase, a, m.score AS score, m.l AS l, m.r AS r FROM (SELECT lang, phrase, a, min(struct_pack(score := score, k := k, l := l, r := r)) AS m FROM e GROUP BY lang, phrase, a)),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM q JOIN n USING (lang) WHERE rank <= {TOP}
"""
