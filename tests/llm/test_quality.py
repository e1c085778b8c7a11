"""Suffix-array measures against counting windows."""

import random
from collections import Counter

import numpy as np
import pytest
from footfall.llm import quality
from hypothesis import given, settings, strategies as st


def windows_found_twice(words, size):
    counts = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    inside = set()
    for i in range(len(words) - size + 1):
        if counts[tuple(words[i : i + size])] > 1:
            inside.update(range(i, i + size))
    return len(inside)


def longest(words):
    return next((n for n in range(len(words), 0, -1) if windows_found_twice(words, n)), 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab \n#", max_size=60), min_size=1, max_size=6))
def test_measures_of_a_batch(texts):
    rules = quality.Rules(repeat=5)
    found = quality.measures([t.encode() for t in texts], rules)
    for i, text in enumerate(texts):
        words = text.split()
        lines = [x for x in text.split("\n") if x.strip()]
        assert found["n_words"][i] == len(words)
        assert found["word_chars"][i] == sum(map(len, words))
        assert found["n_symbols"][i] == text.count("#")
        assert found["n_dup_lines"][i] == len(lines) - len(set(lines))
        assert found["n_repeat_words"][i] == windows_found_twice(words, 3)
        assert found["n_covered"][i] == windows_found_twice(words, 5)
        assert found["longest_repeat"][i] == longest(words)


def test_characters_are_code_points():
    found = quality.measures(["é ñ€ 😀x".encode()], quality.Rules())
    assert found["word_chars"][0] == 5 and found["n_words"][0] == 3


def test_very_long_text():
    words = [str(random.Random(i).randrange(10**9)) for i in range(60_000)]
    found = quality.measures([" ".join(words + words).encode(), b"a " * 100_000], quality.Rules())
    assert found["longest_repeat"].tolist() == [60_000, 99_999]
    assert found["n_covered"].tolist() == [120_000, 100_000]


PROSE = " ".join(f"w{i}" for i in range(80))


@pytest.mark.parametrize(
    ("text", "failed", "kept"),
    [
        (None, True, False),
        ("", True, False),
        (" \n\t", True, False),
        (" ".join(f"w{i}" for i in range(49)), True, False),
        (" ".join(f"w{i}" for i in range(50)), False, True),
        ("the same again " * 30, True, False),
        (PROSE, False, True),
        # Three of ten words in repeats of ten or more: kept; more, though the base rule lets it pass: rejected.
        (" ".join([*(f"w{i}" for i in range(15)), *(f"v{i}" for i in range(70)), *(f"w{i}" for i in range(15))]), False, True),
        (" ".join([*(f"w{i}" for i in range(16)), *(f"v{i}" for i in range(70)), *(f"w{i}" for i in range(16))]), False, False),
        (" ".join([*(f"w{i}" for i in range(25)), *(f"w{i}" for i in range(25)), *(f"v{i}" for i in range(50))]), False, False),
        # Repeats of fewer than ten words do not count.
        (" ".join([*(f"w{i % 9} x{i // 9}" if i % 9 == 8 else f"w{i % 9}" for i in range(18)), *(f"v{i}" for i in range(40))]), False, True),
        # A repeat of 101 words in a long text.
        (" ".join([*(f"w{i}" for i in range(101)), *(f"v{i}" for i in range(500)), *(f"w{i}" for i in range(101))]), False, False),
        (" ".join([*(f"w{i}" for i in range(100)), *(f"v{i}" for i in range(500)), *(f"w{i}" for i in range(100))]), False, True),
    ],
)
def test_verdict(documents, text, failed, kept):
    row = quality.report(documents(text)).collect()[0]
    assert (row.base_failed, row.kept) == (failed, kept)


def test_clean_keeps_columns(documents, clashing):
    docs = clashing(documents(PROSE, None, PROSE, "short", (None, PROSE)))
    kept = quality.clean(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted(docs.where(docs.text == PROSE).collect(), key=str)
    assert quality.clean(docs.limit(0)).collect() == []
    assert quality.report(docs.limit(0)).collect() == []


def test_empty_batch():
    assert quality.longest_repeats(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_spans_of_repeats(documents):
    same = " ".join(f"s{i}" for i in range(12))
    rows = {r.id: r for r in quality.repeats(documents(f"a {same} b {same} c", None, PROSE, f"{same} {same}")).collect()}
    assert [tuple(s) for s in rows[0].spans] == [(1, 13), (14, 26)] and rows[0].longest == 12
    assert rows[1].spans == [] and rows[1].longest == 0 and rows[2].spans == []
    assert [tuple(s) for s in rows[3].spans] == [(0, 24)]
