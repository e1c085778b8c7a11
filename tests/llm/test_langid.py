"""Forward-backward against enumeration, gradients by effect, and held-out accuracy."""

import itertools
import zlib

import numpy as np
import pytest
from footfall.llm import langid

SMALL = "/root/testdata/sf0.001"


def test_posteriors_by_enumeration():
    random = np.random.default_rng(0)
    lengths = np.array([3, 0, 5, 1])
    scores, moves, pairs = random.normal(size=(9, 3)), random.normal(size=(3, 3)), np.zeros((3, 3))
    found = langid.posteriors(scores, lengths, moves, pairs)
    start, want_pairs = 0, np.zeros((3, 3))
    for n in lengths[lengths > 0]:
        total, single, double = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            weight = np.exp(
                sum(scores[start + i, a] for i, a in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            )
            total += weight
            for i, a in enumerate(path):
                single[i, a] += weight
            for a, b in zip(path, path[1:]):
                double[a, b] += weight
        assert np.allclose(single / total, found[start : start + n])
        want_pairs += double / total
        start += n
    assert np.allclose(want_pairs, pairs)


def test_scores_are_sums_of_weights():
    f = langid.features(langid.word_bytes("Ab cé d".encode()))
    weights = np.random.default_rng(1).normal(size=(langid.BUCKETS, 2)).astype(np.float32)
    word, bucket = langid.flat_features(f)
    want = np.stack([np.bincount(word, weights[bucket, j], 3) for j in range(2)], 1)
    assert np.allclose(langid.word_scores(f, weights), want, atol=1e-5)


@pytest.fixture(scope="module")
def model():
    words = {"aa": ["kato", "mika", "sako", "tamik"], "bb": ["blorg", "drung", "storp", "grubl"]}
    random = np.random.default_rng(2)
    return langid.fit([(lang, [w.encode() for w in random.choice(own, 12)]) for lang, own in words.items() for _ in range(60)])


def test_switched_text(model):
    chances, lengths = model.label([b"kato mika sako tamik blorg drung storp grubl"])
    assert [model.languages[i] for i in chances.argmax(axis=1)] == ["aa"] * 4 + ["bb"] * 4
    assert lengths.tolist() == [8]
    # What was learned about moves: a language goes on.
    assert (np.diag(model.transitions) > model.transitions[0, 1]).all()


def test_odd_texts(model):
    labels, scores = model.predict([b"", b"12 34", "é".encode(), "… — €".encode(), b"kato " * 60_000, b"mika"])
    assert labels[:2] == ["und", "und"] and labels[3] == "und" and scores[3] == 0
    assert labels[2] in ("aa", "bb") and labels[4] == labels[5] == "aa"
    assert all(0 <= s <= 1 for s in scores)
    assert langid.fit([]).predict([b"text"]) == (["und"], [0.0])


def test_tables(documents, clashing):
    rows = [(i, "kato mika sako tamik" if i % 2 else "blorg drung storp", "aa" if i % 2 else "bb") for i in range(60)]
    docs = clashing(documents(*rows, (None, "mika", None), (61, None, "aa"), (62, "tamik kato", None)))
    found = {r.doc_id: r for r in langid.report(docs).collect()}
    assert len(found) == 63
    for i, text, lang in rows:
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert found[i].lang_pred == lang
    assert found[None].held_out is False and found[61].lang_pred == "und" and found[62].lang_pred == "aa"
    assert langid.report(docs.limit(0)).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = langid.report(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 20
    assert np.mean([r.lang_pred == r.lang for r in found]) >= 0.95


def test_word_labels(documents, model):
    labels = {r.id: r.labels for r in langid.words(documents("kato 12 blorg drung", None), model).collect()}
    assert labels[0][0] == "aa" and labels[0][2] == "bb" and labels[1] == []


def test_sample_is_bounded_when_rows_repeat(spark):
    rows = spark.range(3000).selectExpr("cast(null as bigint) id", "concat('word', id % 1500, ' and more') text", "'aa' lang")
    assert 50 < len(langid.samples(rows, 100)) < 200
    rows = spark.range(3000).selectExpr("7L id", "'equal words' text", "if(id % 3 = 0, 'aa', 'bb') lang")
    assert len(langid.samples(rows, 100)) <= 2 * 100 * langid.PIECES * 2
    assert langid.samples(rows.where("false")) == []
