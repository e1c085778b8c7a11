import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from footfall.llm import maxent


def tokens_of(text):
    return (text or "").encode().translate(maxent.FOLDED).split()


def one_hash(word):
    return maxent.word_hashes(word)[0][0]


@np.errstate(over="ignore")
def slow_log_chance(model, before, earlier, token):
    """The logarithm of the chance of a token's last class, one softmax after the other, by plain sums."""
    features = maxent._mixed(
        np.array(
            [before * np.uint64(3), before * np.uint64(5) + maxent._mixed(np.array([earlier]))[0], earlier * np.uint64(7)], np.uint64
        )
    )
    path, total = 0, 0.0
    for level in range(model.depth):
        taken = int(token) >> (64 - 3 * (level + 1)) & 7
        node = (path + 1) * maxent.NODE % 2**64
        logits = []
        for child in range(8):
            rows = [((int(f) ^ node) * maxent.BASE % 2**64) >> (64 - maxent.ROW_BITS) for f in features]
            logits.append(float(model.biases[level][path][child]) + sum(float(model.weights[level][r][child]) for r in rows))
        total += logits[taken] - math.log(sum(math.exp(x) for x in logits))
        path = path * 8 + taken
    return total


@pytest.fixture(scope="module")
def model():
    rand = np.random.default_rng(1)
    weights = rand.normal(size=(maxent.MAX_DEPTH, maxent.ROWS, maxent.FAN)).astype(np.float32)
    return maxent.Model(rand.uniform(0.1, 50, 8**3), weights)


def test_hashes_are_of_words_alone():
    words = [b"a", b"b", b"ab", b"ba", "äöü".encode(), b"x" * 300, b"a\x00", b"\xff"]
    hashes, starts = maxent.word_hashes(b"  " + b"   ".join(words) + b" ")
    assert len(set(hashes.tolist())) == len(words)
    assert hashes.tolist() == [one_hash(w) for w in words]
    assert starts[0] == 2
    assert maxent.word_hashes(b"")[0].tolist() == [] == maxent.word_hashes(b"   ")[0].tolist()


def test_hashes_over_chunks(monkeypatch):
    rand = random.Random(2)
    text = b" ".join(bytes(rand.choices(b"abc", k=rand.randrange(1, 30))) for _ in range(2000))
    whole = maxent.word_hashes(text)
    monkeypatch.setattr(maxent, "CHUNK", 64)
    maxent._powers.cache_clear()
    parts = maxent.word_hashes(text)
    maxent._powers.cache_clear()
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_streams_of_any_texts(monkeypatch):
    texts = [b"", b"a b", b"  ", b"c", b"", b"a"]
    flow = maxent.stream(texts)
    a, b, c, end = one_hash(b"a"), one_hash(b"b"), one_hash(b"c"), maxent.END
    assert flow.tokens.tolist() == [end, a, b, end, end, c, end, end, a, end]
    assert flow.firsts.tolist() == [0, 1, 4, 5, 7, 8]
    # Blocks do not change what is before a token.
    whole = np.concatenate([f for _, _, f in flow.blocks()], axis=1)
    monkeypatch.setattr(maxent, "BLOCK", 2)
    assert np.array_equal(whole, np.concatenate([f for _, _, f in flow.blocks()], axis=1))


def test_log_chances_against_plain_sums(model):
    texts = [b"the cat sat on the mat", b"", b"the cat", b"the the the"]
    flow = maxent.stream(texts)
    got = model.log_chances(flow)
    at = 0
    for text in texts:
        tokens = [one_hash(w) for w in text.split()] + [maxent.END]
        history = [maxent.START, maxent.START, *tokens]
        for i, token in enumerate(tokens):
            want = slow_log_chance(model, history[i + 1], history[i], token)
            mass = model.log_mass[int(token) >> (64 - 9)]
            assert got[at] == pytest.approx(want - mass, abs=1e-4)
            at += 1
    assert at == len(got)


def test_chances_add_up_to_one(model):
    """Over all last classes, after any history."""
    total = 0.0
    for last in range(8**3):
        token = np.uint64(last << (64 - 9))
        total += math.exp(slow_log_chance(model, one_hash(b"of"), one_hash(b"out"), token))
    assert total == pytest.approx(1, abs=1e-4)


def test_gradient_against_differences(model):
    flow = maxent.stream([b"a b a b c", b"b a"])
    gradient = maxent.Gradient()
    model.add_gradient(flow, gradient)

    def likelihood(weights):
        other = maxent.Model(np.exp(model.log_mass), weights)
        return other.log_chances(flow).sum()

    assert gradient.met.sum() == len(flow.tokens) * model.depth * maxent.FEATURES
    assert np.abs(gradient.wrong[gradient.met == 0]).max() == 0
    for level, row in list(zip(*np.nonzero(gradient.met)))[::7]:
        for child in (0, 3, 7):
            up, down = model.weights.copy(), model.weights.copy()
            up[level, row, child] += 0.01
            down[level, row, child] -= 0.01
            slope = (likelihood(up) - likelihood(down)) / 0.02
            assert gradient.wrong[level, row, child] == pytest.approx(slope, abs=2e-3)


def test_without_weights_it_is_the_unigram_model():
    counts = Counter("the cat sat on the mat the end".split())
    depth = maxent.depth_for(len(counts) + 1)
    mass = np.full(8**depth, 0.1)
    for word, n in counts.items():
        mass[int(one_hash(word.encode())) >> (64 - 3 * depth)] += n + 0.1
    mass[int(maxent.END) >> (64 - 3 * depth)] += 1.1
    model = maxent.Model(mass)
    got = model.log_chances(maxent.stream([b"the mat"]))
    total = sum(counts.values()) + 1 + 0.1 * (len(counts) + 1) + 0.1 * 8**depth
    for value, n in zip(got, (3, 1, 1)):
        assert value + math.log(n + 0.1) == pytest.approx(math.log((n + 0.1) / total), abs=1e-5)


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def base_scores(rows):
    """By the contract, from the words of all training rows."""
    counts = Counter()
    for doc_id, text in rows:
        if not is_held_out(doc_id):
            counts.update([*tokens_of(text), " "])
    n, v = sum(counts.values()), len(counts)
    result = []
    for doc_id, text in rows:
        tokens = [*tokens_of(text), " "]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        result.append((doc_id, is_held_out(doc_id), len(tokens), sum(t in counts for t in tokens), n, base))
    return result


def assert_base(got, rows):
    want = sorted(base_scores(rows), key=str)
    got = sorted((tuple(r) for r in got), key=lambda r: str(r[:5]))
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=lambda r: str(r[:5]))):
        assert a[:5] == b[:5]
    assert sorted(r[5] for r in got) == pytest.approx(sorted(r[5] for r in want), rel=1e-9)


ROWS = [
    (0, None), (1, ""), (2, " \t\n "), (3, "Straße ÄÖ straße"), (None, "no id at all"), (None, None), (5, "rare " * 40),
    (6, "x" * 5000), (6, "x" * 5000), *[(i, f"the cat sat on mat number {i % 7} and word{i}") for i in range(10, 200)],
]


def test_report_on_odd_rows(documents, clashing):
    got = maxent.report(clashing(documents(*ROWS))).collect()
    assert_base(got, ROWS)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 10 and sum(r.score for r in held) > sum(r.base_score for r in held)
    # Equal rows have equal scores.
    assert len({round(r.score, 9) for r in got if r.doc_id == 6}) == 1


def test_rare_words_by_the_join(documents, monkeypatch):
    """With a head of at most three words nearly all counts come from the join."""
    whole = {r.doc_id: tuple(r) for r in maxent.report(documents(*ROWS)).collect() if r.doc_id is not None}
    monkeypatch.setattr(maxent, "HEAD", 3)
    got = maxent.report(documents(*ROWS)).collect()
    assert_base(got, ROWS)
    for r in got:
        if r.doc_id is not None:
            assert tuple(r) == pytest.approx(whole[r.doc_id], rel=1e-5)


def test_score_against_plain_sums(documents):
    rows = [(i, f"one two three {'four' if i % 2 else 'five'} six") for i in range(30)]
    table = documents(*rows)
    fitted = maxent.fit(table.selectExpr("doc_id as id", "text"))
    got = {r.id: r for r in maxent.score(table, fitted).collect()}
    counts = {r["word"].encode(): r["n"] for r in fitted.counts.collect()}
    assert np.abs(fitted.model.weights).max() > 0.1
    for doc_id, text in rows[:4]:
        words = tokens_of(text)
        tokens = [one_hash(w) for w in words] + [maxent.END]
        history = [maxent.START, maxent.START, *tokens]
        want = 0.0
        for i, (token, word) in enumerate(zip(tokens, [*words, b" "])):
            mass = fitted.model.log_mass[int(token) >> (64 - 3 * fitted.model.depth)]
            want += slow_log_chance(fitted.model, history[i + 1], history[i], token) - mass + math.log(counts[word] + 0.1)
        assert got[doc_id].score == pytest.approx(want / math.log(10), rel=1e-4)


def test_rounds_see_every_row_once(spark, documents):
    table = documents(*ROWS).selectExpr("doc_id as id", "text")
    seen = []
    step = maxent.Model.stepped

    def counted(self, wrong, met):
        seen.append(met.sum())
        return step(self, wrong, met)

    model = maxent.Model(np.full(8, 1.0))
    try:
        maxent.Model.stepped = counted
        maxent.trained(table, model)
    finally:
        maxent.Model.stepped = step
    total = sum(len(tokens_of(t)) + 1 for _, t in ROWS)
    assert len(seen) == maxent.ROUNDS and sum(seen) == total * maxent.FEATURES


def test_tables_without_training_rows(documents):
    assert maxent.report(documents((1, "x")).where("false")).collect() == []
    held = next(i for i in range(100) if is_held_out(i))
    (row,) = maxent.report(documents((held, "a b"))).collect()
    assert tuple(row)[:6] == (held, True, 3, 0, 0, 0.0) and row.score < 0


def test_held_out_texts_are_better_predicted_than_by_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = maxent.report(docs).collect()
    assert_base(got, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in got if r.held_out]
    n = sum(r.n_tokens for r in held)
    base, score = (sum(r[c] for r in held) / n for c in ("base_score", "score"))
    assert score > base + 0.1


def test_long_texts_take_linear_time():
    start = time.process_time()
    model = maxent.Model(np.full(8**5, 1.0))
    for text in (b"a" * 4_000_000, b"a " * 500_000, b" " * 4_000_000):
        model.log_chances(maxent.stream([text]))
    assert time.process_time() - start < 30
