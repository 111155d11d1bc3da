"""The quality classifier and the pipeline's stages against brute force, and the whole pipeline over odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import mixing, quality
from tests.llm.test_edges import ROWS, SCHEMA


def features(text):
    """The classifier's statistics, one by one."""
    raw, words = text.encode(), text.split()
    n, w = max(1, len(raw)), max(1, len(words))
    share = lambda chars: sum(b in chars for b in raw) / n
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    out = [math.log(1 + len(words)), math.log(n / w), math.log(len(set(words)) + 1) / math.log(w + 1), math.log(repeats / w + quality.FLOOR), math.log(max([0, *map(len, words)]) + 1)]
    return np.array(out + [math.log(share(c) + quality.FLOOR) for c in quality.BYTE_CLASSES])


def brute_scores(texts, labelled):
    """Scores of texts from (text, label), by covariances of numpy and densities without Cholesky factors."""
    x, y = np.array([features(t) for t, _ in labelled]), np.array([label for _, label in labelled])
    cov = [np.cov(x[y == k].T) for k in (0, 1)]
    n = [int((y == k).sum()) for k in (0, 1)]
    pooled = sum((n[k] - 1) * cov[k] for k in (0, 1)) / (len(y) - 2)
    log = []
    for k in (0, 1):
        shrunk = (1 - quality.SHRINK - quality.DIAGONAL) * cov[k] + quality.SHRINK * pooled + quality.DIAGONAL * (np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled)))
        gap = np.array([features(t) for t in texts]) - x[y == k].mean(0)
        prior = (n[k] + quality.PRIOR_ROWS / 2) / (len(y) + quality.PRIOR_ROWS)
        log.append(math.log(prior) - 0.5 * np.linalg.slogdet(shrunk)[1] - 0.5 * np.einsum("ij,ij->i", gap, np.linalg.solve(shrunk, gap.T).T))
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def scores(duck, documents):
    labels = duck.execute("SELECT doc_id, quality FROM labels WHERE quality IN (0, 1)").fetchall()
    text = {d[0]: d[1] for d in documents}
    train = [(text[i], y) for i, y in labels if i in text and zlib.crc32(str(i).encode()) % 3 != 1]
    return dict(zip(text, brute_scores(list(text.values()), train), strict=True))


def test_scores_equal_brute_force(spark, sf_dir, scores):
    rows = quality.op10_quality_qda(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(scores)
    assert all(r.score == pytest.approx(scores[r.doc_id], abs=1e-6) for r in rows)


def test_quality_stage_equals_brute_force(spark, sf_dir, scores):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()} == {i for i, s in scores.items() if s >= 0.5}


def test_mixing_stage_equals_brute_force(spark, sf_dir, documents):
    """Raking in plain Python for ITERATIONS rounds, which end before TOLERANCE on so few documents, then the whole part of each rate and the lot of the id for the rest."""
    cell, tokens = {}, {}
    for doc_id, text, lang, source in documents:
        tokens[doc_id] = n = len([w for w in text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w])
        marks = ("icensed under", "opyright", "SPDX-")
        mail = any(a.isascii() and a.isalnum() and b.isascii() and b.isalnum() for a, at, b in zip(text, text[1:], text[2:], strict=False) if at == "@")
        topic = "notice" if any(m in text for m in marks) else "table" if " | " in text else "contact" if mail else "brief" if n < mixing.BRIEF_WORDS else "long" if n > mixing.LONG_WORDS else "article"
        cell[doc_id] = (source, lang if lang in mixing.LANG_TARGET else "other", topic)
    held = Counter()
    for i, c in cell.items():
        held[c] += tokens[i]
    by_source = Counter()
    for c, n in held.items():
        by_source[c[0]] += n
    given = [{s: n**mixing.SOURCE_POWER for s, n in by_source.items()}, mixing.LANG_TARGET | {"other": mixing.OTHER_LANG}, mixing.TOPIC_TARGET]
    weight, total = {c: n / sum(held.values()) for c, n in held.items()}, sum(held.values())
    for _ in range(mixing.ITERATIONS):
        for d, targets in enumerate(given):
            now = defaultdict(float)
            for c, w in weight.items():
                now[c[d]] += w
            there = sum(targets[v] for v, w in now.items() if w)
            weight = {c: w * targets[c[d]] / there / now[c[d]] if w else 0.0 for c, w in weight.items()}
    expected = Counter()
    for i, c in cell.items():
        rate = weight[c] * total * mixing.KEEP_TOKENS / held[c] if held[c] else 1.0
        lot = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 16**13
        expected[i] = math.floor(rate) + (lot < rate - math.floor(rate))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert Counter(r.doc_id for r in corpus_pipeline.mix(spark, docs, sf_dir).collect()) == +expected


def test_pieces_stage_equals_the_library(spark, sf_dir, documents):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in corpus_pipeline.pieces(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()}
    assert len(rows) == len(documents)
    for doc_id, text, *_ in documents:
        ids = model.encode(text)
        assert (rows[doc_id].piece_ids, rows[doc_id].n_pieces, rows[doc_id].exact) == (ids, len(ids), model.decode(ids) == text)


@pytest.fixture
def odd_tables(spark, tmp_path):
    rng = random.Random(3)
    near = " ".join(f"word{rng.randrange(10**6)}" for _ in range(300))
    rows = [*ROWS, (20, near, "en", "a"), (22, f"{near} more", "en", "a"), (21, near, "en", "a"), (21, "another text of the same id", "en", "a")]
    docs = spark.createDataFrame([(*r, 0, "x", "x", "x", "x", "x") for r in rows], SCHEMA)
    labels = spark.createDataFrame([(None, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")
    for name, kept in (("odd", docs), ("none", docs.limit(0))):
        kept.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    return tmp_path, docs


def test_pipeline_over_odd_tables(spark, odd_tables):
    """Without usable labels all documents are kept; of each text and family one row is left for the mixing, which may repeat it."""
    path, docs = odd_tables
    sf_dir = f"{path}/odd"
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    exact = corpus_pipeline.exact(spark, kept, sf_dir).select("doc_id", "text").collect()
    texts = [r.text or "" for r in exact]
    # rows that repeat an id and its text are one document
    assert len({(r.doc_id, r.text or "") for r in exact}) == len(set(texts)) and set(texts) == {r.text or "" for r in docs.collect()}
    near = corpus_pipeline.near(spark, spark.createDataFrame(exact, "doc_id long, text string"), sf_dir).collect()
    assert sum((r.text or "").startswith("word") and not (r.text or "").startswith("word word") for r in near) == 1
    assert {"another text of the same id"} <= {r.text for r in near}
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(docs.columns) - {"text"} <= set(out.columns) and out.count() > 0
    assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in near}
    assert corpus_pipeline.run(spark, f"{path}/none").count() == 0
