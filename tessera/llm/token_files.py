"""Token-id output: documents are tokenised, written as Simple-8b segments, and read back.

A segment is one self-contained binary record (see `pack_segment`): a table of documents, the offset
of each block's first word, and the words. Segments are the rows of a parquet dataset, which gives
them Spark's commit protocol and any file system; documents are in ascending id order over the
dataset's parts, and each segment knows how many ids precede it in its part.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm import simple8b
from tessera.llm.common import bounded, importable, kept_table, table, work_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: A segment is closed when it has that many ids; one document never spans two segments.
SEGMENT_IDS = 1 << 20
#: Chunks and bytes (chunks, ids and some ENTRY_BYTES for each) in each of the two generations of a worker's
#: table; longer chunks than LONG_CHUNK characters are not kept.
TABLE_CHUNKS, TABLE_BYTES, ENTRY_BYTES, LONG_CHUNK = 900_000, 250_000_000, 190, 200
MAGIC = b"TS8B"
HEADER = struct.Struct("<4sIQQQ")  # magic, documents, ids, words, blocks
SEGMENTS = "part int, seq int, before long, n_ids long, body binary"


#: Byte-level symbols: visible Latin-1 characters stand for their own byte, the others are numbered on from 256.
_OTHER = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
_SYMBOLS = {b: 256 + n for n, b in enumerate(_OTHER)}


class ChunkIds:
    """Ids of whole texts from a table of distinct chunks, with the tokenizers library.

    The byte-level pre-tokeniser always cuts before a space or line feed that a visible character
    follows, so texts are cut there and each distinct chunk is tokenised once. Texts with any other
    run of white space, or with the string of an added token, are tokenised whole. Of the table, the
    older generation goes when the newer one is full; that costs time, never a result.
    """

    def __init__(self, path: str, bound: int = TABLE_CHUNKS, size_bound: int = TABLE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model, self.bound, self.size_bound = self.tokenizer.model, bound, size_bound
        self.new, self.old = _Table(self), {}
        self.kept_tail = lru_cache(10_000)(self.raw)

    def tail(self, chunk: str) -> bytes:
        return self.kept_tail(chunk) if len(chunk) <= LONG_CHUNK else self.raw(chunk)

    def raw(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, letters: str) -> bytes:
        """Ids of a space and letters, which are one pre-token: its byte symbols go to the model at once."""
        symbols = "Ġ" + (letters if letters.isascii() else letters.encode().decode("latin-1").translate(_SYMBOLS))
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        if len(self.new) > self.bound or self.new.size > self.size_bound:
            self.old, self.new = self.new, _Table(self)
        if any(t in text for t in self.added):
            return self.raw(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            return self.tail(first) + b"".join(map(self.new.__getitem__, rest))
        except _Unsafe:
            return self.raw(text)


#: Letters with what follows them from the first character that is none: another place where the pre-tokeniser always cuts.
_WORD = re.compile(r"(\n?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-@\[-`{-~].*)", re.S)


class _Unsafe(Exception):
    """The text has white space that does not cut it."""


class _Table(dict):
    """Chunk without its leading space, or with its leading line feed -> bytes of its ids."""

    def __init__(self, owner: ChunkIds):
        super().__init__()
        self.owner, self.size = owner, 0

    def __missing__(self, chunk: str) -> bytes:
        value = self.owner.old.get(chunk)
        if value is None:
            if chunk.isalpha() and (chunk.isascii() or "À" <= chunk[0] <= "ɏ" or "A" <= chunk[0] <= "z"):
                value = self.owner.word(chunk)
            else:
                value = self.rest(chunk)
        if len(chunk) <= LONG_CHUNK:
            self[chunk] = value
            self.size += len(chunk) + len(value) + ENTRY_BYTES
        return value

    def rest(self, chunk: str) -> bytes:
        """Ids of a chunk that is not letters alone."""
        visible = chunk.removeprefix("\n")[:1]
        if not ("!" <= visible <= "~" or "À" <= visible <= "ɏ"):
            raise _Unsafe
        if word := _WORD.fullmatch(chunk):
            return self[word[1]] + self.owner.tail(word[2])
        return self.owner.raw(chunk if chunk[0] == "\n" else f" {chunk}")


@kept_table
def chunk_ids(path: str) -> ChunkIds:
    """The worker's table, shared by the tasks that the worker runs."""
    return ChunkIds(path)


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """Header; null flags, ids and numbers of ids of the documents; block offsets; Simple-8b words."""
    words, offsets = simple8b.encode(ids)
    return b"".join((
        HEADER.pack(MAGIC, len(doc_ids), len(ids), len(words), len(offsets)),
        np.array([x is None for x in doc_ids], "u1").tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array(lengths, "<i8").tobytes(),
        np.asarray(offsets, "<i8").tobytes(),
        np.asarray(words, "<u8").tobytes(),
    ))


def unpack_segment(body: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, numbers of ids, all ids) of what pack_segment() has made."""
    magic, docs, n, n_words, n_blocks = HEADER.unpack_from(body)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, kind, count, at)
        at += out.nbytes
        return out

    null, doc_ids, lengths = take("u1", docs), take("<i8", docs), take("<i8", docs)
    offsets, words = take("<i8", n_blocks), take("<u8", n_words)
    return [None if x else int(d) for x, d in zip(null, doc_ids, strict=True)], lengths, simple8b.decode(words, offsets, n)


def write_tokens(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID) -> None:
    """Tokenises all whole texts and writes them as segments to the folder `out`.

    * Each document's ids end with end_id; a null or empty text has that id alone.
    * Documents are written in ascending id order, null ids first; rows that repeat an id are each
      written, in order of their texts. An empty table gives a dataset without segments.
    * Texts are read whole, of any length; a document's ids lie in one segment, however many they are.
      The string of a special token in a text becomes that token, as the library has it.
    * Other columns are not read.
    """
    spark = docs.sparkSession
    importable(spark)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, part, seq, before = chunk_ids(path), TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []
        size = 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            values = [[part], [seq], [before], [len(ids)], [pack_segment(doc_ids, lengths, ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["part", "seq", "before", "n_ids", "body"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = chunks.encode(text.as_py()) + end
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4)
                held.append(ids)
                size += lengths[-1]
                if size >= SEGMENT_IDS:
                    yield segment()
                    seq, before = seq + 1, before + size
                    doc_ids, lengths, held, size = [], [], [], 0
        if doc_ids:
            yield segment()

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(bounded(run), SEGMENTS).write.option("compression", "none").parquet(out)


def read_tokens(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """Reads a dataset of write_tokens(): doc_id, start, n_tokens, ids_crc32, and ids if asked for.

    start is the number of ids of all documents before it in the dataset.
    """
    importable(spark)
    segments = spark.read.schema(SEGMENTS).parquet(out)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row for each part of the dataset
    firsts = parts.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                start = batch.column("before")[k].as_py() + batch.column("first")[k].as_py()
                doc_ids, lengths, ids = unpack_segment(batch.column("body")[k].as_py())
                ids = ids.astype("<u4", copy=False)
                ends = np.cumsum(lengths)
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                arrays = [pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    joined = segments.join(F.broadcast(firsts), "part")  # a row for each part
    return joined.mapInArrow(bounded(run), schema)


def op2_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids and reads them back."""
    out = work_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), out)
    return read_tokens(spark, out, with_ids=False)
