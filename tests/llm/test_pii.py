"""Base spans against plain regexes; EM and classifier on votes with known truth."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from footfall.llm import pii
from footfall.llm.common import Taken
from hypothesis import given, settings, strategies as st


def brute(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(d) for d in re.sub("[^0-9]", "", m[0])]
        twice = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(twice) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


PARTS = ["a", "b.", "@", "1", "25", ".", "-", " ", "+", "(", "_", "%", "4111111111111111", "9", "0", "é", "1.2.3.4", "٣", "256"]


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25))
def test_base(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute(text)


def test_long_texts_take_linear_time():
    model = pii.fit({})
    start = time.process_time()
    for text in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a@" * 150_000, "AB12" * 70_000, "James " * 50_000, "1-" * 150_000, "James Smith a@b.com 1.2.3.4 " * 20_000):
        pii.all_spans(text, model)
        pii.candidates(text)
    assert time.process_time() - start < 20


def test_spans_taken():
    random_ = random.Random(2)
    for _ in range(300):
        spans = [(s, s + random_.randrange(1, 9)) for s in random_.choices(range(40), k=random_.randrange(8))]
        taken = Taken(spans)
        for start in range(40):
            for end in range(start + 1, 46):
                assert taken.meets(start, end) == any(s < end and start < e for s, e in spans)


def test_reliabilities_are_found():
    random_ = random.Random(6)
    right = [0.95, 0.9, 0.85, 0.6, 0.75, 0.8]
    counts = {}
    for _ in range(20_000):
        truth = random_.random() < 0.4
        votes = [-1 if random_.random() < 0.2 else int(truth == (random_.random() < p)) for p in right]
        pattern = ("phone", *votes, 1, 2)
        counts[pattern] = counts.get(pattern, 0) + 1
    model = pii.fit(counts)
    for (yes, no), p in zip(model.rates, right):
        assert abs(yes - p) < 0.05 and abs(1 - no - p) < 0.05
    assert model.likelihood(("phone", 1, 1, 1, 1, 1, 1, 1, 2)) > 0.9
    assert model.likelihood(("phone", 0, 0, 0, 0, 0, 0, 1, 2)) < 0.1


@pytest.fixture(scope="module")
def model():
    votes = {(k, 1, 1, 1, -1, 1, 1, 1, b): 50 for k in pii.KINDS for b in (0, 1, 2)}
    votes |= {(k, 0, 0, -1, 0, 0, 0, 1, b): 50 for k in pii.KINDS for b in (0, 1, 2)}
    return pii.fit(votes)


def test_added_kinds(model):
    text = "call John Smith at 555-123-4567, ssn 123-45-6789, born on 12/03/1980, iban DE89370400440532013000, bob [at] mail [dot] com"
    base, spans = pii.all_spans(text, model)
    assert base == []
    assert [k for k, _, _ in spans] == ["email", "phone", "ssn", "iban", "birth", "person"]
    assert pii.masked_text(text, spans) == "call [PERSON] at [PHONE], ssn [SSN], born on [BIRTH], iban [IBAN], [EMAIL]"


def test_base_spans_stay(model):
    text = "a@b.com, 1.2.3.4, 4111 1111 1111 1111, +1 (375) 555-4393"
    base, spans = pii.all_spans(text, model)
    assert set(base) <= set(spans) and [s[0] for s in base] == ["email", "ip", "card", "phone"]
    assert pii.masked_text(text, spans) == "[EMAIL], [IP], [CARD], [PHONE]"


def test_overlapping_spans_become_one():
    assert pii.masked_text("abcdefgh", [("ip", 1, 4), ("card", 3, 6), ("phone", 4, 5)]) == "a[IP]gh"


def test_tables(documents, clashing):
    text = "é mail a@b.com now"
    docs = clashing(documents(text, None, "", (None, "x"), text, "clean text", "No. 4111111111111112"))
    rows = {r.doc_id: r for r in pii.report(docs).collect()}
    assert (rows[0].n_email, rows[0].n_ip, rows[0].n_card, rows[0].n_phone) == (1, 0, 0, 0)
    assert rows[0].spans == "email:7:14" and rows[4].spans == rows[0].spans
    assert rows[0].base_sha256 == hashlib.sha256(b"email:7:14").hexdigest()
    assert rows[1].spans == rows[2].spans == rows[6].spans == ""
    assert pii.report(docs.limit(0)).collect() == []
    masked = pii.masked(docs)
    assert masked.columns == docs.columns and masked.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    by_id = {r.doc_id: (r.text, r.n_chars) for r in masked.collect()}
    assert by_id[0] == ("é mail [EMAIL] now", 18) and by_id[5] == ("clean text", 10) and by_id[1] == (None, None)


def test_counts_cover_all_texts(documents):
    counts = pii.patterns(documents(*["mail a@b.com", "1.2.3.4 and 5.6.7.8"] * 5))
    assert sum(n for p, n in counts.items() if p[0] == "email") == 5
    assert sum(n for p, n in counts.items() if p[0] == "ip") == 10
    assert np.isfinite(pii.fit(counts).likelihood(next(iter(counts))))


AROUND = ["James", "Smith", "Mary Jones", "John", "Dr", "x", "é", "_", "1", " ", ".", "(", '"', "-", ":", "\n", "\u00a0", "’", "İ"]


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(AROUND), max_size=12))
def test_prefilter_loses_no_person(parts):
    text = "".join(parts)
    found = [s for s in pii.more_candidates(text) if s[0] == "person"]
    assert found == [("person", *m.span()) for m in pii.PERSON.finditer(text)]


@pytest.mark.parametrize("text", ["(James Smith)", '"Mary Jones said', "author:John Brown", "-David Miller"])
def test_persons_after_punctuation(text):
    assert [k for k, _, _ in pii.more_candidates(text)] == ["person"]
