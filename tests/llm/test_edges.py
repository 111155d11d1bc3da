"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import math
import operator
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bit_sliced, chat, mixing, ngram_join, pieces, quality, secrets, simple8b, token_files, warc
from tessera.llm.common import arrow_groups, clear_work, materialize, to_keys, work_path
from tessera.llm.components import components
from tessera.llm.exact_dedup import DigestIndex, dedup_in_batches, drop_copies, exact_dedup

LONG = "word " * 60_000 + "end"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, key string, digest string, kept string, id string"
ROWS = [
    (1, "the same old text of more than five words", "en", "a"), (2, "the same old text of more than five words", None, "b"), (2, "the same old text of more than five words", None, "b"),
    (3, None, "en", None), (4, "", "fr", "a"), (5, LONG, "en", "a"), (None, "the same old text of more than five words", "en", "a"), (None, "text of none", "en", "a"), (6, "é 😀 \x00\n\t", "xx", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, "x", "x", "x", "x", "x") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_exact_dedup(spark, docs, nothing):
    path = work_path(spark, "test-index")
    rows = exact_dedup(docs, DigestIndex(spark, path, 4)).collect()
    assert len(rows) == len(ROWS)
    same = [r for r in rows if r.keep_id == 2]
    assert len(same) == 4 and all(r.group_size == 4 for r in same) and sorted(str(r.doc_id) for r in same if r.kept) == ["2", "2"]
    assert [r.kept for r in rows if r.doc_id in (3, 4)].count(True) == 1
    assert [(r.keep_id, r.kept) for r in rows if r.doc_id is None and r.group_size == 1] == [(None, True)]
    # a later batch, over an index that is opened again
    again = exact_dedup(docs.where("doc_id = 1").union(docs.where("doc_id = 5").withColumn("text", F.lit("fresh"))), DigestIndex(spark, path, 4))
    assert {(r.doc_id, r.keep_id, r.kept) for r in again.collect()} == {(1, 2, False), (5, 5, True)}
    assert DigestIndex(spark, path).read().count() == 6 and DigestIndex(spark, path).buckets == 4
    DigestIndex(spark, path).close()
    assert DigestIndex(spark, path).read().count() == 6  # opened again
    assert DigestIndex(spark, work_path(spark, "test-index"), rows=10**9).buckets == 500
    assert exact_dedup(nothing, DigestIndex(spark, work_path(spark, "test-index"), 4)).count() == 0
    kept = drop_copies(docs, DigestIndex(spark, work_path(spark, "test-index"), 4))
    assert kept.columns == docs.columns and kept.count() == 6


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_dedup_in_batches_equals_one_batch(spark, docs, nothing, batches):
    more = docs.union(docs.where("doc_id = 2").withColumn("doc_id", F.lit(40).cast("long"))).union(docs.where("doc_id = 5").withColumn("doc_id", F.lit(-3).cast("long")))
    listed = lambda df: sorted(map(tuple, df.collect()), key=str)
    wanted = exact_dedup(more, DigestIndex(spark, work_path(spark, "test-index"), 4))
    path = work_path(spark, "test-index")
    assert listed(dedup_in_batches(more, path, batches)) == listed(wanted)
    assert DigestIndex(spark, path).read().count() == wanted.select("text_sha256").distinct().count()
    assert dedup_in_batches(nothing, work_path(spark, "test-index"), batches).count() == 0
    none = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert dedup_in_batches(none, work_path(spark, "test-index"), batches).where("kept").count() == len(ROWS)


def test_secrets_link_only_complementary_parts(spark, docs, nothing):
    key, ident = "aB3" + "x" * 37, "ZX81" + "Q" * 14
    texts = [f"id {ident} then {key} at https://x.example", f"only {key} here", f"only {ident} here", f"{ident}{' pad' * 200}{key}", f"password = {key} {ident}", f"token: short secret=token:abcdefgh AKIA{'A' * 16}"]
    rows = [r.spans for r in secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert rows[0].count("id_part") == rows[0].count("key_part") == rows[0].count("endpoint") == 1
    assert rows[1] == rows[2] == rows[3] == ""
    assert "assign:0:51" in rows[4] and "id_part" in rows[4]
    assert "assign" not in rows[5] and "access" in rows[5]
    # an identifier does not go with the value that it is in, and every kind of key counts
    mine, hexes, long = "password = ABCD1234EFGH5678", "0123456789abcdef" * 2, "aB3/" * 16
    texts = [mine, f"{mine} and {hexes}", f"{ident} {hexes} https://x.example", f"{ident} {long}", f"{hexes} https://x.example"]
    rows = [(r.spans, r.links) for r in secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert rows[0] == ("assign:0:27", "") and rows[1] == ("assign:0:27,id_part:11:27,hex:32:64", "id_part:11:27>hex:32:64")
    assert rows[2] == ("id_part:0:18,hex:19:51,endpoint:52:69", "id_part:0:18>hex:19:51,endpoint:52:69>id_part:0:18,endpoint:52:69>hex:19:51")
    assert rows[3][1] == "id_part:0:18>key_part:19:83,key_part:19:83>id_part:0:18" and rows[4] == ("hex:0:32", "")
    assert secrets.scan_secrets(docs).count() == len(ROWS) and secrets.scan_secrets(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_256), st.integers(0, 2**64 - 1)), max_size=300), st.integers(0, 5000))
def test_simple8b_round_trip(values, zeros):
    ids = np.array(values[:150] + [0] * zeros + values[150:], np.uint64)
    words, offsets = simple8b.encode(ids)
    assert (simple8b.decode(words, offsets, len(ids)) == ids).all()


def test_token_files(spark, docs, nothing):
    out = work_path(spark, "test-tokens")
    token_files.write_tokens(docs, out)
    rows = token_files.read_tokens(spark, out).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 2, 3, 4, 5, 6]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert all(r.ids[-1] == 2 and len(r.ids) == r.n_tokens for r in rows) and rows[5].ids == [2] and rows[7].n_tokens > 50_000
    out = work_path(spark, "test-tokens")
    token_files.write_tokens(nothing, out)
    assert token_files.read_tokens(spark, out).count() == 0


def test_chunk_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    chunks, rng = token_files.ChunkIds(public_tokenizers.path("byte_bpe_50k.json"), 40), random.Random(5)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = [*"  ab'stéÉ\n\t1é　 😀\x1c\x85,.!ñ\r", "<|endoftext|>", "x" * 250, "." * 250]
    for _ in range(4000):
        text = "".join(rng.choice(parts if rng.random() < 0.3 else parts[:-3]) for _ in range(rng.randrange(14)))
        assert np.frombuffer(chunks.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert max(map(len, [*chunks.new, *chunks.old])) <= token_files.LONG_CHUNK
    assert np.frombuffer(chunks.encode("a <|endoftext|>"), "<u4").tolist()[-1] == 50256


def test_tables_are_bounded_by_bytes():
    import public_tokenizers

    chunks = token_files.ChunkIds(public_tokenizers.path("byte_bpe_50k.json"), size_bound=20_000)
    for i in range(500):
        chunks.encode(f"word number {i} of {i * i}")
    assert 0 < chunks.new.size <= 22_000 and chunks.old


def test_chunk_table_equals_the_model():
    table, rng = pieces.ChunkTable(pieces.model_path(), 40), random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("  ▁ab\n\té😀　\x00ﬁ<s>") for _ in range(rng.randrange(14)))
        joined = table.encode(text)
        assert ([int(x) for x in joined.split(",")] if joined else []) == table.model.encode(text)


def test_pieces(docs, nothing):
    rows = pieces.token_rows(docs).collect()
    assert len(rows) == len(ROWS) and all(r.n_pieces == len(r.piece_ids) for r in rows) and "text" not in rows[0]
    assert [r.n_pieces for r in rows if r.doc_id in (3, 4)] == [0, 0]
    assert pieces.encode_pieces(docs).where(F.coalesce("text", F.lit("")) != F.col("piece_text")).count() == 0
    assert pieces.digest_pieces(nothing).count() == 0 == pieces.token_rows(nothing).count()


class Rewriting:
    """Shows only the last answer in full: earlier ones are shortened."""

    context = None

    def render(self, turns):
        return "".join(f"{r}: {t if i == len(turns) - 1 else t[:1]}\n" for i, (r, t) in enumerate(turns))


class Mistaken(Rewriting):
    """States a context that is wrong."""

    context = 0


class Numbered(chat.MarkedTurns):
    """Turns have their number and say whether the first turn was a system's, whatever context is stated."""

    context = 1

    def render(self, turns):
        return "".join(f"{i} {turns[0][0] == 'system'} " + super(Numbered, self).render([t]) for i, t in enumerate(turns))


class Opening(chat.MarkedTurns):
    """Says something before the first turn, and more where a turn is the first in a window."""

    context = None

    def render(self, turns):
        return "<s>" + super().render(turns)


def test_chat(spark):
    said = [(1, 1, "user", "a\\</turn>"), (1, 0, None, None), (1, 2, "assistant", "<turn x>"), (1, 2, "assistant", "<turn x>"), (None, 0, "assistant", "n"), (2, None, "assistant", ""), (3, 0, "user", LONG * 4), (3, 1, "assistant", LONG)]
    turns = spark.createDataFrame([(*r, "z") for r in said], "conv_id long, turn long, role string, text string, part string")
    out = work_path(spark, "test-chat")
    chat.format_conversations(turns, out)
    found = {r.conv_id: r for r in chat.digest_formatted(spark, out).collect()}
    assert {c: (r.n_turns, r.loss_chars) for c, r in found.items()} == {1: (4, 16), None: (1, 1), 2: (1, 0), 3: (2, len(LONG))}
    assert spark.read.parquet(out).where("conv_id = 3").count() == 2
    out = work_path(spark, "test-chat")
    chat.format_conversations(turns.where("conv_id = 1"), out, Rewriting())
    row = spark.read.parquet(out).first()
    assert row.rewritten and row.loss == [] and row.text.endswith("assistant: <turn x>\n")
    out = work_path(spark, "test-chat")
    chat.format_conversations(turns.where("conv_id = 1"), out, Mistaken())
    assert spark.read.parquet(out).first() == row
    out = work_path(spark, "test-chat")
    chat.format_conversations(turns.where("conv_id = 1"), out, Opening())
    row = spark.read.parquet(out).first()
    assert not row.rewritten and row.text.startswith("<s><turn") and [chat.MarkedTurns.unescape(row.text[s.start : s.end]) for s in row.loss] == ["<turn x>"] * 2
    out = work_path(spark, "test-chat")
    chat.format_conversations(turns.limit(0), out)
    assert chat.digest_formatted(spark, out).count() == 0


def test_stated_context_is_proved():
    for n in range(1, 12):
        said = [("system" if not i else "assistant", f"t{i}") for i in range(n)]
        (row,) = chat._formatted(((7, *t) for t in said), Numbered(), "assistant")
        assert row == (7, 0, Numbered().render(said), row[3], False) and [row[2][s["start"] : s["end"]] for s in row[3]] == [t for _, t in said[1:]]
        (row,) = chat._formatted(((7, *t) for t in said), Mistaken(), "assistant")
        assert row == ((7, 0, Mistaken().render(said), [], True) if n > 1 else (7, 0, "system: t0\n", [], False))
    # what is wrong only after the first part
    late = [("user", "x")] * 2 + [("user", "y" * chat.PART_CHARS), ("user", "long"), ("user", "long")]
    (row,) = chat._formatted(((7, *t) for t in late), Late(), "assistant")
    assert row == (7, 0, Late().render(late), [], True)
    long = [("user", "z" * 5000)] * 700
    (row,) = chat._formatted(((7, *t) for t in long), Shortened(), "assistant")
    assert row == (7, 0, Shortened().render(long), [], True)
    rows = list(chat._formatted(((7, *t) for t in long[:600]), Shortened(), "user"))
    assert len(rows) > 2 and "".join(r[2] for r in rows) == Shortened().render(long[:600]) and sum(len(r[3]) for r in rows) == 600
    assert [r[1] for r in rows] == list(range(len(rows)))


class Shortened(chat.MarkedTurns):
    """Says that turns don't depend on each other, and shortens the first of more than 600."""

    def render(self, turns):
        return super().render([(r, t[:10] if not i and len(turns) > 600 else t) for i, (r, t) in enumerate(turns)])


class Late(chat.MarkedTurns):
    """Rewrites from the fifth turn on."""

    context = 2

    def render(self, turns):
        return super().render([(r, "" if t == "long" and i < len(turns) - 1 else t) for i, (r, t) in enumerate(turns)])


def test_warc(spark):
    rows = [(1, "http://b.a/x", "p"), (2, "http://b.a/x", "p"), (2, "http://b.a/x", "p"), (3, None, None), (4, "http://a.a/\r\nX: y", ""), (None, "u", "p"), (None, "u", "q"), (5, "http://c.a", "\r\n\r\nWARC/1.1\r\n" + "é" * 70_000)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    out = work_path(spark, "test-warc")
    warc.write_warc(pages, out)
    entries = warc.merge_runs(warc.read_warc(spark, out), 3)
    found = entries.orderBy("part", "place").collect()
    assert len(found) == len(rows)
    assert {(r.page_id, r.record_type, r.refers_to) for r in found} == {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (None, "revisit", 2), (None, "response", None), (5, "response", None)}
    keys = [(r.url_key, r.ts, -1 if r.page_id is None else r.page_id) for r in found]
    assert keys == sorted(keys) and [r.position for r in found] == list(range(len(rows)))
    # many archives, many ranges
    old, warc.ARCHIVE_RECORDS = warc.ARCHIVE_RECORDS, 2
    out = work_path(spark, "test-warc")
    try:
        warc.write_warc(pages, out)
    finally:
        warc.ARCHIVE_RECORDS = old
    again = warc.merge_runs(warc.read_warc(spark, out), range_rows=1).orderBy("position").collect()
    assert len({r.run for r in again}) >= 4 and [(r.url_key, r.ts, r.page_id) for r in again] == [(r.url_key, r.ts, r.page_id) for r in found]
    assert next(r.payload_bytes for r in found if r.page_id == 5) == len(rows[-1][2].encode())
    out = work_path(spark, "test-warc")
    warc.write_warc(pages, out, min_bytes=2)
    assert warc.read_warc(spark, out).where("record_type = 'revisit'").count() == 0
    out = work_path(spark, "test-warc")
    warc.write_warc(pages.limit(0), out)
    assert warc.merge_runs(warc.read_warc(spark, out)).count() == 0


def test_warc_of_far_ids(spark):
    ids = [0, 1, 2**62, -(2**62), 300_000_000_000, 251_698_233_599, 251_698_233_600, -63_839_664_000, -63_839_664_001, None]
    pages = spark.createDataFrame([(i, "http://a.example/", str(i)) for i in ids], "page_id long, url string, html string")
    out = work_path(spark, "test-warc")
    warc.write_warc(pages, out)
    found = warc.merge_runs(warc.read_warc(spark, out)).orderBy("position").collect()
    assert [r.page_id for r in found if r.page_id is not None] == sorted(i for i in ids if i is not None)
    assert {r.page_id: r.ts for r in found} | {None: ""} == {
        0: "20240101000000", 1: "20240101000001", 2**62: "99991231235959", -(2**62): "00010101000000", 300_000_000_000: "99991231235959", 251_698_233_599: "99991231235959", 251_698_233_600: "99991231235959",
        -63_839_664_000: "00010101000000", -63_839_664_001: "00010101000000", None: "",
    }


def test_loser_tree_merges():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted((rng.randrange(40),) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(9))]
        assert [x[0] for x in warc.LoserTree([iter([(r, r) for r in run]) for run in runs])] == sorted(sum(runs, []))


def test_bit_sliced(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=5).round(1)]) for i in range(300)] + [(i, [0.5] * 5) for i in range(300, 400)] + [(1, [9.0] * 5), (2, [9.0] * 5), (401, None), (402, [1.0, None, 1.0, 1.0, 1.0]), (403, [math.nan] * 5), (404, [math.inf] * 5), (405, [1.0, 2.0]), (406, []), (None, [9.0] * 5)]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, dim string").repartition(3)
    asked = vectors.where("vec_id % 50 = 0 OR vec_id > 400")
    found = bit_sliced.bit_sliced_topk(vectors, asked, k=7, block_rows=64, query_rows=3).collect()
    fine = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and len(v) == 5 and all(x is not None and math.isfinite(x) for x in v)]
    for q, x in fine:
        if q % 50 == 0:
            best = sorted(((-int(x @ y), i) for i, y in fine if i != q))[:7]
            assert [(-r.score, r.vec_id) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == best
    assert not [r for r in found if r.query_id in (401, 402, 403, 404, 405, 406)]
    assert bit_sliced.bit_sliced_topk(vectors.limit(0), asked.limit(0)).count() == 0


def test_bit_sliced_takes_the_valid_one_of_repeated_queries(spark):
    schema = "vec_id long, embedding array<double>"
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], schema)
    asked = spark.createDataFrame([(50, None), (50, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [math.nan, 0.0]), (150, [2.0, 0.0]), (150, [0.0, 2.0])], schema)
    for order in (F.asc("n"), F.desc("n")):
        given = asked.withColumn("n", F.monotonically_increasing_id()).coalesce(1).sortWithinPartitions(order)
        found = bit_sliced.bit_sliced_topk(vectors, given, k=1).collect()
        assert {(r.query_id, r.vec_id) for r in found} == {(50, 1), (100, 1), (150, 2)} and len(found) == 3


@pytest.mark.parametrize("more", [[], [(4, [1e18, 0.0]), (100, [1e17, 0.0])], [(4, [1e300, -1e308]), (100, [-1e308, 1.5]), (150, [1e7, 1e12]), (151, [1e13, -1e13])]])
def test_bit_sliced_is_exact_for_any_finite_components(spark, more):
    rows = [(50, [1e7, 0.0]), (51, [1.0, 1.0]), (1, [1e12, 0.0]), (2, [-1e12, 5e11]), (3, [0.0, 3.0]), (200, [1.0, 1.0]), *more]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(Fraction(v) * 256) for v in x] for i, x in rows}
    found = bit_sliced.bit_sliced_topk(vectors, vectors.where("vec_id % 50 = 0"), k=4, block_rows=64).collect()
    for q in (i for i, _ in rows if i % 50 == 0):
        best = sorted((-sum(map(operator.mul, whole[q], x)), i) for i, x in whole.items() if i != q)[:4]
        wanted = [(-s if -(2**63) <= -s < 2**63 else None, i) for s, i in best]
        assert [(r.score, r.vec_id) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == wanted
    scores = [0, -1, 1, -9, -10, 10, 9, 2**70, -(2**70), 10**40, -(10**40)]
    assert sorted(scores) == sorted(scores, key=bit_sliced._sortable)


def test_grid_and_signed_digits():
    for blocks, batches in ((1, 1), (6, 5), (30_000, 80_000), (3, 10_000), (10_000, 1), (0, 0)):
        rows, columns = bit_sliced.grid(blocks, batches)
        assert 1 <= rows <= max(1, blocks) and 1 <= columns <= max(1, batches) and rows * columns <= bit_sliced.TILES
    rows, columns = bit_sliced.grid(30_000, 80_000)
    assert columns < 30 and rows * columns > bit_sliced.TILES / 2
    q = np.random.default_rng(1).integers(-(2**40), 2**40, 500)
    digits = bit_sliced.signed_digits(q)
    assert (sum(d.astype(np.int64) << k for k, d in enumerate(digits)) == q).all()
    assert not any((a * b).any() for a, b in zip(digits, digits[1:], strict=False))


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, None, 0), (None, 1, 0), (99, 1, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(docs, labels).count() == len(ROWS)
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(nothing, labels).count() == 0
    kept = quality.keep_quality(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_ngram_join(spark, docs, nothing):
    rows = {(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngram_join.ngram_join(docs).collect()}
    assert rows == {(1, 1, 0, 3), (2, 1, 0, 3), (3, 3, 0, 1), (4, 4, 0, 1), (5, 5, 0, 1), (None, None, 0, 1), (6, 6, 0, 1)}
    assert ngram_join.ngram_join(nothing).count() == 0
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 2").count() == 0 and kept.count() == len(ROWS) - 2


def test_near_copies_go_by_id_and_text(spark):
    base, other = [f"w{i}" for i in range(60)], " ".join(f"v{i}" for i in range(60))
    texts = [(1, " ".join(base)), (2, other), (2, " ".join([*base[:-1], "x"])), (3, None), (3, " ".join(base))]
    kept = ngram_join.drop_near_copies(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([texts[0], texts[1], texts[3]], key=str)


def test_ngram_join_on_a_large_family_equals_brute_force(spark):
    """Near copies of one text, in buckets and families beyond a chunk, and chains of them."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        words = base.copy()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = "BUCKET", "ALIKE", "BUCKET_CHUNK", "FAMILY_BYTES", "PIECE"
    old = [getattr(ngram_join, n) for n in names]
    for n, v in zip(names, (16, 0.8, 40, 30_000, 13), strict=True):
        setattr(ngram_join, n, v)
    try:
        found = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.ngram_join(docs).collect()}
    finally:
        for n, v in zip(names, old, strict=True):
            setattr(ngram_join, n, v)
    sets = [frozenset(ngram_join.ngrams(t).tolist()) for t in texts]
    distinct = set(sets)
    links = {s: {o for o in distinct if o != s and len(o & s) * 9 >= 4 * (len(o) + len(s))} for s in distinct}
    label = {s: sets.index(s) for s in distinct}
    for _ in range(20):
        label = {s: min([label[s], *(label[o] for o in links[s])]) for s in distinct}
    for i, s in enumerate(sets):
        assert found[i] == (label[s], len(links[s]), sets.count(s))


def test_a_large_family_moves_few_bytes(spark):
    """5,000 near copies: all linked to the text that they come from, and moved once for each of two chunks."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(500)]
    texts = [" ".join(base)] + [" ".join([*base[: (at := rng.randrange(500))], f"x{i}", *base[at + 1 :]]) for i in range(5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    grams = sum(8 * len(ngram_join.ngrams(t)) for t in texts)
    written = lambda: sum(e.totalShuffleWrite() for e in _scala(spark, spark.sparkContext._jsc.sc().statusStore().executorList(True)))
    docs.count()
    before = written()
    found = {r.doc_id: r for r in ngram_join.ngram_join(docs).collect()}
    assert written() - before < 3 * grams
    assert {r.class_id for r in found.values()} == {0} and found[0].n_links == 5000 and all(r.n_links == 5000 for r in found.values())


def _scala(spark, seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_followed_pairs_by_simulation():
    rng = random.Random(6)
    for splits in (1, 3, 8):
        met = 0
        for _ in range(4000):
            paths = 1
            for _ in range(splits):
                paths = sum(rng.random() < 0.8 for _ in range(paths) for _ in range(1 + (rng.random() < 0.25)))
            met += paths > 0
        assert met / 4000 == pytest.approx(ngram_join.followed(0.8, splits), abs=0.03)


def test_mean_agreement(spark):
    """Of sets in two halves that agree within them, every other pair agrees."""
    signs = [rng.getrandbits(63) for rng in [random.Random(8)] for _ in range(2)]
    rows = spark.createDataFrame([(signs[i % 2],) for i in range(1000)], "signs long")
    ones = rows.agg(*(F.sum(F.shiftright("signs", i).bitwiseAND(F.lit(1))).alias(f"s{i}") for i in range(63)))
    agreed = ones.select(ngram_join.mean_agreement(F.lit(1000.0), [F.col(f"s{i}") for i in range(63)])).first()[0]
    assert agreed == pytest.approx(0.5, abs=0.2)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 2), (2, 2), (None, 1), (7, 7), (5, 4)], "a long, b long")
    assert {tuple(r) for r in components(edges, "a", "b").collect()} == {(2, 2), (3, 2), (4, 2), (5, 2), (8, 8), (9, 8), (7, 7)}
    # a hub with nearly all edges, and a path
    hub = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(10_000, 10_020)]
    found = components(spark.createDataFrame(hub, "a long, b long"), "a", "b").groupBy("label").count().collect()
    assert {tuple(r) for r in found} == {(0, 3000), (10_000, 21)}


def test_to_keys_joins_heavy_and_light_keys(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(9000)], "k long, v long")
    info = materialize(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")), "test-info")
    expected = rows.join(info, "k").select("k", "v", "n", "top")
    found = to_keys(rows, info, "k", "n").select("k", "v", "n", "top")
    assert found.count() == 9000 and not found.exceptAll(expected).count()
    assert to_keys(rows.limit(0), info.limit(0), "k", "n").count() == 0


def test_mixing(spark, docs, nothing):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.probability <= 1 for r in rows)
    assert {(r.lang, r.source) for r in rows if r.doc_id == 3} == {("en", "")}
    assert mixing.mix_sources(nothing).count() == 0
    kept = mixing.mix_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_drawn_sample_has_the_target_weights(spark):
    """Topics that are rare in the data are repeated, so that the sample as drawn has the targets' shares and size."""
    words = {"brief": 10, "article": 200, "long": 1600}
    dealt = [(lang, topic) for lang, n in (("en", 18), ("fr", 6)) for topic, m in (("brief", 40), ("article", 100), ("long", 2)) for _ in range(n * m)]
    docs = spark.createDataFrame([(i, "word " * words[topic], lang, "ab"[i % 2]) for i, (lang, topic) in enumerate(dealt)], "doc_id long, text string, lang string, source string")
    rows, mixed = mixing.mix_sources(docs).collect(), mixing.mix_documents(docs)
    drawn = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert drawn == {r.doc_id: r.copies for r in rows if r.copies} and max(drawn.values()) > 5
    total = sum(r.tokens * r.copies for r in rows)
    assert total == pytest.approx(mixing.KEEP_TOKENS * sum(r.tokens for r in rows), rel=0.05)
    shares = {(r.dimension, r.value): (r.target, r.share) for r in mixing.sample_marginals(mixing.mix_sources(docs)).collect()}
    assert len(shares) == 7 and all(share == pytest.approx(target, abs=0.03) for target, share in shares.values())
    for name, wanted in (("topic", {t: mixing.TOPIC_TARGET[t] / 0.75 for t in words}), ("lang", {x: mixing.LANG_TARGET[x] / 0.67 for x in ("en", "fr")}), ("source", {"a": 0.5, "b": 0.5})):
        for value, share in wanted.items():
            assert sum(r.tokens * r.copies for r in rows if r[name] == value) / total == pytest.approx(share, abs=0.03)


def test_raking_meets_its_marginals(spark):
    cells = spark.createDataFrame([(s, l, t, 1 + 7 * i + 3 * j + k) for i, s in enumerate("ab") for j, l in enumerate(("en", "fr")) for k, t in enumerate(("article", "long"))], "source string, lang string, topic string, tokens long")
    share = lambda name, **s: spark.createDataFrame(list(s.items()), f"{name} string, target double")
    targets = {"source": share("source", a=0.5, b=0.5), "lang": share("lang", en=0.9, fr=0.1), "topic": share("topic", article=0.3, long=0.7, brief=9.0).where("topic <> 'brief'")}
    raked = mixing.rake(cells, targets, frozenset({"lang", "topic"}))
    assert {n: t.columns for n, t in targets.items()} == {n: [n, "target"] for n in targets}  # the caller's targets stay
    for name, wanted in (("lang", {"en": 0.9, "fr": 0.1}), ("topic", {"article": 0.3, "long": 0.7}), ("source", {"a": 0.5, "b": 0.5})):
        assert {r[0]: round(r[1], 6) for r in raked.groupBy(name).agg(F.sum("w")).collect()} == wanted


def test_raking_joins_nothing_in_its_rounds(spark, monkeypatch):
    """The cells are written once however many rounds there are, and no factors are broadcast to them; values without a target or a name keep nothing."""
    written = []
    monkeypatch.setattr(mixing, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    rows = [("a", "en", "long", 5), ("a", "fr", "brief", 2), ("b", "en", "brief", 3), ("b", "fr", "long", 1), ("b", "xx", "long", 4), (None, "en", "long", 2), ("a", None, "long", 1), ("c", "en", "long", 0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    share = lambda name, **s: spark.createDataFrame(list(s.items()), f"{name} string, target double")
    targets = {"source": share("source", a=0.5, b=0.5, c=1.0), "lang": share("lang", en=0.8, fr=0.2), "topic": share("topic", brief=0.4, long=0.6)}
    raked = mixing.rake(cells, targets, frozenset({"lang", "topic"}))
    assert written.count("raked") == 1 and "Join" not in raked._jdf.queryExecution().executedPlan().toString()
    w = {(r.source, r.lang, r.topic): r.w for r in raked.collect()}
    # brute force
    found = {r[:3]: float(r[3]) for r in rows}
    wanted = {0: {"a": 0.5, "b": 0.5}, 1: {"en": 0.8, "fr": 0.2}, 2: {"brief": 0.4, "long": 0.6}}
    for _ in range(mixing.ITERATIONS):
        for i, target in wanted.items():
            sums = {v: sum(x for k, x in found.items() if k[i] == v) for v in target}
            found = {k: x * target[k[i]] / sums[k[i]] if k[i] in target and sums[k[i]] else 0.0 for k, x in found.items()}
    assert w.keys() == found.keys() and all(w[k] == pytest.approx(x, abs=1e-9) for k, x in found.items())
    assert [tuple(r) for r in mixing.rake(cells.limit(0), targets, frozenset({"lang", "topic"})).collect()] == []


def test_arrow_groups_cross_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64())], ["k"]) for x in ([1, 1, 2], [], [2, 2], [3], [3, 4])]
    assert [(k, t.num_rows) for k, t in arrow_groups(iter(batches), "k")] == [(1, 2), (2, 3), (3, 2), (4, 1)]


def test_work_is_cleared(spark):
    kept = materialize(spark.range(3), "test-kept")
    assert kept.count() == 3
    path = kept.inputFiles()[0]
    clear_work(spark)
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.text(path).count()
