"""Base phrases against a plain search; rules, gates and suppression by example."""

import re
from re import _parser

import pytest
from footfall.llm import licenses
from hypothesis import given, settings, strategies as st


def brute(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = []
    for phrase, label in ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")):
        for i in range(len(words)):
            if tuple(words[i : i + len(phrase)]) == phrase:
                places.append((i, label))
    return len(words), sorted(places)


parts = st.sampled_from(["MIT", "License", "license", "Apache", "general", "public", " ", "-", "\n", "x", "é", "İ", "licenses"])


@settings(max_examples=400, deadline=None)
@given(st.lists(parts, max_size=20))
def test_base(pieces):
    text = "".join(pieces)
    found = licenses.scan_text(text.encode())
    n, places = brute(text)
    assert found["n_words"] == n and found["n_base"] == len(places)
    assert (found["first_word"], found["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
    assert found["base_labels"] == ",".join(sorted({a for _, a in places}))
    assert set(found["base_labels"].split(",")) <= set(found["labels"].split(",")) or not places
    assert 0 <= found["score"] <= 1


def test_every_rule_is_reachable():
    assert len(licenses.rules()) >= 200
    for rule in licenses.rules():
        re.compile(rule.pattern)
        assert rule.keyword.isalnum()


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"),
        ("Licensed under CC BY-NC-ND 4.0.", "cc-by-nc-nd"),
        ("Creative Commons Attribution-ShareAlike 3.0 Unported", "cc-by-sa"),
        ("released under the Mozilla Public License, version 2.0", "mpl"),
        ("This program is free software; you can redistribute it and/or modify it", "gpl"),
        ("GNU Affero General Public License v3", "agpl,gpl"),
        ("We permit licensed drivers.", ""),
        ("", ""),
    ],
)
def test_labels(text, labels):
    assert licenses.scan_text(text.encode())["labels"] == labels


def test_containment():
    found = licenses.scan_text(b"Licensed under the Apache License, Version 2.0, and the MIT License.")["matches"]
    assert [(m["label"], m["start"], m["end"]) for m in found] == [("apache", 0, 8), ("mit", 9, 12)]


def test_tables(documents, clashing):
    docs = clashing(documents("The MIT License", None, "", "the mit license " * 30_000, (None, "x")))
    rows = {r.doc_id: r for r in licenses.report(docs).collect()}
    assert (rows[0].n_base, rows[0].first_word, rows[0].labels) == (1, 1, "mit")
    assert (rows[1].n_words, rows[1].first_word, rows[1].labels, rows[1].score) == (0, None, "", 0.0)
    assert (rows[3].n_base, rows[3].last_word) == (30_000, 89_998)
    assert licenses.report(docs.limit(0)).collect() == []


def spellings(parsed):
    """Texts for all alternatives of a parsed pattern; optional parts with and without, sets by each member."""
    texts = [""]
    for op, given_ in parsed:
        kind = str(op)
        if kind == "LITERAL":
            options = [chr(given_)]
        elif kind == "BRANCH":
            options = [x for branch in given_[1] for x in spellings(branch)]
        elif kind == "SUBPATTERN":
            options = spellings(given_[3])
        elif kind == "MAX_REPEAT":
            options = [""] * (given_[0] == 0) + [x * max(1, given_[0]) for x in spellings(given_[2])]
        elif kind == "IN":
            options = [chr(c) for k, v in given_ for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))]
        else:
            assert kind == "ANY"
            options = ["x"]
        texts = [a + b for a in texts for b in options]
    return texts


def test_no_gate_hides_a_rule():
    """Of every alternative of every rule's pattern, so that gated and ungated searches give the same."""
    for rule in licenses.rules():
        gates = {rule.keyword.decode(), *(k.decode() for k in rule.spare)}
        for text in spellings(_parser.parse(rule.pattern)):
            assert not gates.isdisjoint(text.split()), (rule.label, text)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("GNU GPLv3", "gpl"),
        ("GNU LGPLv3 or later", "lgpl"),
        ("GNU AGPLv3", "agpl"),
        ("Zero Clause BSD License", "0bsd"),
        ("CC Zero", "cc0"),
        ("CC0 and CC Zero", "cc0"),
    ],
)
def test_gated_search_is_the_ungated_one(text, label):
    normal = b" " + b" ".join(text.lower().encode().split()) + b" "
    every = licenses.detections(normal, set(licenses.gated()))
    assert licenses.detections(normal, licenses.gated().keys() & set(normal.split())) == every
    assert label in licenses.scan_text(text.encode())["labels"].split(",")
