import hashlib
import random
import zlib

import numpy as np
import pytest
from footfall.llm import runs


def slow_runs(words, min_length=6):
    """Every period on its own: stretches of words that equal the word a period later."""
    found = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def coded(*texts):
    return [np.array(t, np.int64) for t in texts]


@pytest.mark.parametrize("letters", (1, 2, 3, 30))
def test_random_texts(letters):
    rand = random.Random(letters)
    texts = [[rand.randrange(letters) for _ in range(rand.randrange(120))] for _ in range(150)]
    assert runs.find(coded(*texts)) == [slow_runs(t) for t in texts]


def test_planted_periods_of_any_size():
    rand = random.Random(5)
    texts = []
    for _ in range(250):
        parts = [rand.randrange(3, 60) for _ in range(rand.randrange(30))]
        unit = [rand.randrange(rand.choice((2, 4, 50))) for _ in range(rand.choice((1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 16, 17, 31, 32, 33, 50)))]
        times = rand.choice((3.9, 4, 4.1, 5, 9.5))
        repeated = (unit * 11)[: round(len(unit) * times)]
        inner = rand.randrange(len(repeated) + 1)
        texts.append(parts + repeated[:inner] + repeated + parts + repeated * rand.randrange(5))
    assert runs.find(coded(*texts)) == [slow_runs(t) for t in texts]


def test_repetitions_within_repetitions():
    fibonacci = [[0], [0, 1]]
    for _ in range(10):
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    nested = [0, 0, 0, 0, 0, 1] * 6
    texts = [fibonacci[-1], nested * 5 + [3], (nested + [2]) * 7, [0] * 500, ([0] * 40 + [1]) * 9, (list(range(64)) * 4) * 2]
    assert runs.find(coded(*texts)) == [slow_runs(t) for t in texts]


def test_chosen_positions_are_consistent_and_dense():
    rand = np.random.default_rng(3)
    context = rand.integers(0, 1000, 64)
    words = np.concatenate([rand.integers(0, 1000, 300), context, rand.integers(0, 1000, 77), context, rand.integers(0, 1000, 300)])
    hashes, size = runs._mixed(words.astype(np.uint64)), 1
    while size < 8:
        hashes, size = runs._doubled(hashes, size), size * 2
    chosen = set(runs.synchronising(hashes, 8, np.zeros(len(hashes), bool)).tolist())
    first = {i - 300 for i in chosen if 300 <= i <= 300 + 48}
    second = {i - 441 for i in chosen if 441 <= i <= 441 + 48}
    assert first == second and first
    ordered = sorted(chosen)
    assert max(b - a for a, b in zip(ordered, ordered[1:])) <= 8
    assert len(chosen) < len(words) / 2


def test_limit_and_strongest():
    assert runs.find(coded([1, 1, 1, 1, 1])) == [[]]
    assert runs.find(coded([1] * 4), 4) == [[(0, 4, 1)]]
    assert runs.find(coded([1] * 6)) == [[(0, 6, 1)]]
    assert runs.find([]) == []
    assert runs.strongest([]) is None
    # 12 / 2 and 18 / 3 are equal; the first counts.
    assert runs.strongest([(5, 8, 2), (20, 18, 3), (50, 12, 2)]) == (20, 18, 3)


def test_collapsed():
    words = [b"x", *[b"a", b"b"] * 4, b"y"]
    found = runs.find(coded([0, *[1, 2] * 4, 3]))[0]
    assert found == [(1, 8, 2)] and runs.kept_words(words, found) == [b"x", b"a", b"b", b"y"]


def expected(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = slow_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        len(found),
        *(best or (None, None, None)),
        best and 1000 * best[1] // best[2],
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(kept).hexdigest(),
    )


def test_report_against_every_period(spark, documents, clashing):
    rand = random.Random(9)
    rows = [(i, " ".join(rand.choice(("a", "b", "ü", "d e")) for _ in range(rand.randrange(150)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (None, "z " * 30), (3, "again again again again again again"), (3, "x")]
    rows += [(None, None)]
    table = clashing(documents(*rows))
    got = sorted((tuple(r) for r in runs.report(table).collect()), key=str)
    assert got == sorted(((i, *expected(i, t)) for i, t in rows), key=str)
    assert any(r[1] for r in got)


def test_empty_table(documents):
    table = documents((1, "x")).where("false")
    assert runs.report(table).collect() == []


def test_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len((r.text or "").split()) < 1500]
    got = {r.doc_id: tuple(r)[1:] for r in runs.report(docs).collect()}
    assert len(got) == docs.count()
    for doc_id, text in rows:
        assert got[doc_id] == expected(doc_id, text), doc_id


def test_long_texts_take_little_time():
    import time

    rand = np.random.default_rng(1)
    start = time.process_time()
    unit = rand.integers(0, 50_000, 70_000)
    for text in (np.zeros(400_000), np.tile(unit, 6), np.tile([1, 2, 3, 4, 5], 80_000), rand.integers(0, 2, 400_000)):
        runs.find([text.astype(np.int64)])
    assert time.process_time() - start < 60
