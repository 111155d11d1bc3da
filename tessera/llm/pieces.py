"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model crosses from a character into a following whitespace marker, so a text may be
cut before every marker that follows another character: each distinct marked chunk is segmented once
and its ids are joined back by position. The table lives in the Python worker and is shared by its
tasks; its older generation goes when the newer one is full, which costs time, never a result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bounded, importable, kept_table, table

MODEL = "piece_bpe_32k.model"
#: Chunks in each of the two generations of a worker's table, some 220 bytes each; longer ones than LONG_CHUNK
#: characters (at most some 6 bytes of ids each) are not kept.
TABLE_CHUNKS, LONG_CHUNK = 130_000, 200
MARK = "▁"
IDS = T.StructField("piece_ids", T.ArrayType(T.IntegerType()))


def model_path(name: str = MODEL) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTable(dict):
    """Chunk, without its first marker -> decimal ids of the marked chunk, joined by commas.

    Further markers of a run stay in the chunk of the word that ends the run; "" is a lone marker
    at the end of a text.
    """

    def __init__(self, path: str, bound: int = TABLE_CHUNKS):
        import sentencepiece

        super().__init__()
        self.model, self.bound = sentencepiece.SentencePieceProcessor(model_file=path), bound
        self.old: dict[str, str] = {}
        check_model(self.model)

    def __missing__(self, chunk: str) -> str:
        value = self.old.get(chunk)
        if value is None:
            # the model puts the chunk's first marker in front of any text but the empty one
            ids = self.model.encode(chunk) if chunk else [self.model.piece_to_id(MARK)]
            value = ",".join(map(str, ids))
        if len(chunk) <= LONG_CHUNK:
            self[chunk] = value
        return value

    def encode(self, text: str) -> str:
        """Decimal ids of the whole text, joined by commas."""
        if len(self) > self.bound:
            self.old = dict(self)
            self.clear()
        if not text:
            return ""
        text = text.replace(MARK, " ")
        chunks = text.split(" ")
        if "" in chunks:
            chunks = RUNS.split(text)
        return ",".join(map(self.__getitem__, chunks))


#: A marker that follows another character and starts a chunk; further markers stay in the chunk.
RUNS = re.compile(r"(?<=[^ ]) ")


def check_model(model) -> None:
    """The chunk table is exact only for such models; others are refused."""
    crossing = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if re.search(f"[^{MARK}]{MARK}", p)]
    kept = model.encode(f" a  b {MARK}c\n ", out_type=str)
    if crossing or "".join(kept).replace("<0x0A>", "\n") != f"{MARK}{MARK}a{MARK}{MARK}b{MARK}{MARK}c\n{MARK}":
        raise ValueError("pieces of this model cross whitespace markers, or it normalises white space: encode whole texts instead")


@kept_table
def chunk_table(path: str) -> ChunkTable:
    """The worker's table, shared by the tasks that the worker runs."""
    return ChunkTable(path)


def encode_pieces(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with the columns piece_ids (array of int) and piece_text (what the library decodes them to).

    Ids are those of the whole text without begin or end ids. A null text is the empty text: no ids,
    decoded to "". Texts may have any length. Every row is handled on its own, so repeated rows and ids, ties and an empty table
    need no rule; columns of these two names are replaced.
    """
    rows = docs.drop("piece_ids", "piece_text")
    return _mapped(rows, text_col, path, T.StructType([*rows.schema, IDS, T.StructField("piece_text", T.StringType())]), _whole)


def token_rows(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs, without the text, with piece_ids, n_pieces and `exact`: whether the ids decode to the text.

    Nulls, empty and long texts are as in encode_pieces(); columns of these three names are replaced.
    """
    rows = docs.drop("piece_ids", "n_pieces", "exact")
    schema = T.StructType([*rows.drop(text_col).schema, IDS, T.StructField("n_pieces", T.LongType()), T.StructField("exact", T.BooleanType())])
    at = rows.columns.index(text_col)

    def finish(batch: pa.RecordBatch, texts: Iterator[str], chunks: ChunkTable) -> pa.RecordBatch:
        texts = list(texts)
        found = [(ids, decoded == text) for text, (_, ids, decoded) in zip(texts, _encoded(texts, chunks), strict=True)]
        added = [pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([len(x[0]) for x in found], pa.int64()), pa.array([x[1] for x in found], pa.bool_())]
        return pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), *added], schema.names)

    return _mapped(rows, text_col, path, schema, finish)


def digest_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, from the ids and the decoded text."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return _mapped(rows, "text", path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def _mapped(rows: DataFrame, text_col: str, path: str | None, schema, finish) -> DataFrame:
    importable(rows.sparkSession)
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_table(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                yield finish(part := batch.slice(at, 250), (x or "" for x in part.column(text_col).to_pylist()), chunks)

    return rows.mapInArrow(bounded(run), schema)


def _encoded(texts: Iterator[str], chunks: ChunkTable) -> Iterator[tuple[str, list[int], str]]:
    for text in texts:
        joined = chunks.encode(text)
        ids = list(map(int, joined.split(","))) if joined else []
        yield joined, ids, chunks.model.decode(ids) if ids else ""


def _whole(batch: pa.RecordBatch, texts: Iterator[str], chunks: ChunkTable) -> pa.RecordBatch:
    found = [(ids, decoded) for _, ids, decoded in _encoded(texts, chunks)]
    added = [pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.string())]
    return pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "piece_ids", "piece_text"])


def _digests(batch: pa.RecordBatch, texts: Iterator[str], chunks: ChunkTable) -> pa.RecordBatch:
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    found = [(len(ids), sha(joined), sha(decoded)) for joined, ids, decoded in _encoded(texts, chunks)]
    n, ids, decoded = zip(*found, strict=True) if found else ((), (), ())
    arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes all whole documents."""
    return digest_pieces(table(spark, sf_dir, "documents"))
