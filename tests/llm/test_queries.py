"""Registered queries against their SQL, or against brute force where SQL can't express them."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import assert_same


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, duck, sf_dir):
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


def test_token_ids(spark, sf_dir, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: tuple(r)[1:] for r in QUERIES["op2_token_id_output"](spark, sf_dir).collect()}
    start = 0
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert found[doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(found) == len(texts)


def test_secrets_base(spark, sf_dir, texts):
    patterns = [re.compile(p) for p in (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+")]
    found = {r.doc_id: r for r in QUERIES["op5_secret_scans"](spark, sf_dir).collect()}
    assert len(found) == len(texts)
    for doc_id, text in texts:
        spans = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in p.finditer(text) if len(m[2] if k == 0 else m[0]) >= (6, 20, 24)[k])
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        row = found[doc_id]
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert set(filter(None, listed.split(","))) <= set(row.spans.split(","))


def test_pieces(spark, sf_dir, texts):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {r.doc_id: tuple(r)[1:] for r in QUERIES["op9_sentencepiece"](spark, sf_dir).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc_id, text in texts:
        ids = model.encode(text)
        assert found[doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))


def test_quality_on_held_out_labels(spark, duck):
    from tests.conftest import DATA

    sf_dir = DATA.replace("sf0.001", "sf0.01")
    labels = dict(duck.execute(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall())
    rows = QUERIES["op10_quality_qda"](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in own) >= 0.97 * len(own)
    assert all(r.predicted for r in own if labels[r.doc_id]) or sum(not r.predicted for r in own if labels[r.doc_id]) <= 0.02 * len(own)


def test_pipeline_stages_against_brute_force(spark, sf_dir, texts):
    import corpus_pipeline
    from tessera.llm.ngram_join import ngrams

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    by_id = dict(texts)
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    exact = corpus_pipeline.exact(spark, docs, sf_dir)
    near = corpus_pipeline.near(spark, docs, sf_dir)
    mixed = corpus_pipeline.mix(spark, docs, sf_dir)
    for stage in (kept, exact, near, mixed):
        assert stage.columns == columns
        rows = stage.collect()
        assert rows and all(by_id[r.doc_id] == (r.text or "") for r in rows)
    last = {}
    for doc_id, text in texts:
        last[text] = doc_id
    assert {r.doc_id for r in exact.collect()} == set(last.values())
    grams = {i: set(ngrams(t).tolist()) for i, t in texts}
    label = {i: i for i in grams}
    for a in grams:
        for b in grams:
            if a < b and grams[a] and len(grams[a] & grams[b]) * 9 >= 4 * (len(grams[a]) + len(grams[b])):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    assert {r.doc_id for r in near.collect()} == set(label.values())
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.where("NOT exact").count() == 0
