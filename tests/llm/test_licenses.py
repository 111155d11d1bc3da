"""License scans against plain search, and notices with changed words."""

import random
import re

import pytest

from tessera.llm.licenses import BASE, MORE, digest_licenses, scan_licenses

SCHEMA = "doc_id long, text string, row string, label string, words string, pos string, spans string"
NOTICE = MORE[0][1].split()


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    words = words_of(text)
    found = [(i, label) for label, phrase in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    bits = ["under the MIT License", "apache  license, version-2", "CC BY-NC", "under the", "mit", "license", "cc by", "nc", "Apache", "version 2", "é", "x\x7fy", "K", "İ", "😀!", "\n\t"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", ". ", "/", ""]) for _ in range(rng.randrange(40))) for _ in range(300)]
    return [*texts, None, "", "..", "word " * 50_000 + "CC BY-NC 4.0", "cc by nc cc by nc by nc"]


def test_base_places_equal_plain_search(spark, texts):
    docs = spark.createDataFrame([(i if i % 50 else None, t, *"xxxxx") for i, t in enumerate([*texts, *texts[:3]])], SCHEMA)
    rows = digest_licenses(scan_licenses(docs)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    wanted = sorted(((i if i % 50 else None, *brute(t)) for i, t in enumerate([*texts, *texts[:3]])), key=key)
    assert sorted((tuple(r)[:6] for r in rows), key=key) == wanted
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} for r in rows)
    assert all(r.score == 1 for r in rows if r.n_base) and sum(r.n_base for r in rows) > 100


def test_notices_with_changed_words(spark):
    lost = NOTICE[:20] + NOTICE[21:]
    more = NOTICE[:15] + ["also"] + NOTICE[15:35] + ["and", "too"] + NOTICE[35:]
    half = NOTICE[: len(NOTICE) // 2]
    apart = half + ["other"] * 30 + NOTICE[len(NOTICE) // 2 :]
    texts = [" ".join(x) for x in (NOTICE, lost, more, half, apart, NOTICE[::-1])]
    rows = {r.doc_id: r for r in scan_licenses(spark.createDataFrame([(i, t, *"xxxxx") for i, t in enumerate(texts)], SCHEMA)).collect()}
    spans = [[(s.start, s.stop, s.label) for s in rows[i].spans] for i in range(6)]
    assert spans[:3] == [[(0, len(x), "mit")] for x in (NOTICE, lost, more)]
    assert spans[3:] == [[], [], []] and 0.4 < rows[3].score < 0.6 and rows[4].score < 0.75 and rows[5].score == 0
    assert rows[0].score == 1 and 0.75 < rows[1].score < 1


def test_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert scan_licenses(docs).count() == 0 and digest_licenses(scan_licenses(docs)).columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    with pytest.raises(ValueError, match="3 words"):
        scan_licenses(docs, more=(("x", "two words"),))
