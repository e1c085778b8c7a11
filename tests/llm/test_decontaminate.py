"""The automaton against looking up every window."""

import hashlib
import time

from footfall.llm import decontaminate as d
from footfall.llm.common import folded_words
from hypothesis import given, settings, strategies as st

words = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14)


def brute(items, text, window):
    hit, found = set(), set()
    for item, own in items:
        size = min(window, len(own))
        for i in range(len(own) - size + 1) if size else ():
            for at in range(len(text) - size + 1):
                if text[at : at + size] == own[i : i + size]:
                    found.add(item)
                    hit.update(range(at, at + size))
    return hit, found


@settings(max_examples=400, deadline=None)
@given(st.lists(words, max_size=6), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=40), st.integers(1, 6))
def test_hits(texts, document, window):
    items = [(str(i), t) for i, t in enumerate(texts)]
    spans, found = d.Automaton([(i, t, True) for i, t in items], window).hits(document)
    hit, want = brute(items, document, window)
    assert {at for s, e in spans for at in range(s, e)} == hit
    assert found == want
    assert spans == d.merged(spans)


def items_table(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id long, text string")


LONG = " ".join(f"t{i}" for i in range(20))


def test_contract(spark, documents, clashing):
    benchmark = items_table(spark, (10, LONG), (9, "Alpha, beta"), (9, "gamma"), (None, "delta"), (11, None), (12, "..."))
    docs = clashing(documents(
        f"x {LONG.upper()} y", "x " * 60 + "alpha BETA gamma", None, "", "delta", " ".join(f"t{i}" for i in range(12)), (None, "alpha beta"),
        "x " * 19 + "gamma", "x " * 20 + "gamma", "t0 " + LONG,
    ))
    rows = {r.doc_id: r for r in d.report(docs, benchmark).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    as_list = lambda r: [r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated]
    assert as_list(rows[0]) == [22, 20, 1, sha("10"), True]
    assert as_list(rows[1]) == [63, 3, 1, sha("9"), False]
    assert as_list(rows[2]) == as_list(rows[3]) == [0, 0, 0, sha(""), False]
    assert as_list(rows[4]) == [1, 1, 0, sha(""), True]
    assert as_list(rows[5]) == [12, 0, 0, sha(""), False]
    assert as_list(rows[None]) == [2, 2, 1, sha("9"), True]
    assert as_list(rows[7]) == [20, 1, 1, sha("9"), True]
    assert as_list(rows[8]) == [21, 1, 1, sha("9"), False]
    assert as_list(rows[9]) == [21, 20, 1, sha("10"), True]
    clean = d.clean(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2, 3, 5, 8]
    assert {r.contaminated for r in d.report(docs, benchmark.limit(0)).collect()} == {False}
    assert d.report(docs.limit(0), benchmark).collect() == []


def test_blocks_give_the_same(spark, documents):
    benchmark = items_table(spark, *[(i, " ".join(f"w{j}" for j in range(7 * i, 7 * i + 5 * i))) for i in range(12)])
    docs = documents(*[" ".join(f"w{j}" for j in range(i, 3 * i)) for i in range(40)])
    whole = sorted(d.with_hits(docs, benchmark).collect())
    assert sorted(d.with_hits(docs, benchmark, block=30).collect()) == whole
    assert d.automata(benchmark, block=30).count() > 3


def test_many_blocks_are_one_stage(spark, documents):
    items = [" ".join(f"b{i}w{j}" for j in range(40)) for i in range(60)]
    benchmark = items_table(spark, *enumerate(items), *enumerate(items))
    docs = documents(*[f"x {item} y" for item in items], "none of them")
    assert d.automata(benchmark, block=45).count() == 60
    rows = d.with_hits(docs, benchmark, block=45)
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    found = {r.row.doc_id: (r.n_hit, r.items) for r in rows.collect()}
    assert found == {i: (40, [str(i)]) for i in range(60)} | {60: (0, [])}


def test_windows_of_many_items_take_linear_time():
    shared = [b"s%d" % i for i in range(2000)]
    automaton = d.Automaton([(str(i), shared[:50], True) for i in range(2000)] + [("all", shared, True)], 13)
    start = time.process_time()
    spans, found = automaton.hits(shared[:50] * 4000)
    assert time.process_time() - start < 10
    assert spans == [(0, 200_000)] and len(found) == 2001


def test_spans_are_cut(spark, documents):
    benchmark = items_table(spark, (1, LONG), (2, "alpha beta"))
    docs = documents(f"Before, {LONG}; after.", "x " * 60 + "alpha beta. End", "no hit", None)
    rows = {r.doc_id: (r.text, r.n_chars) for r in d.without_spans(docs, benchmark).collect()}
    kept = "x " * 60 + "alpha beta. End"
    assert rows == {0: ("Before, after.", 14), 1: (kept, len(kept)), 2: ("no hit", 6), 3: (None, None)}


def test_long_spans_leave_kept_documents(spark, documents, clashing):
    benchmark = items_table(spark, (1, LONG), (2, " ".join(f"u{i}" for i in range(13))))
    rest = "x " * 600
    docs = clashing(documents(rest + f"Before, {LONG}; after.", rest + " ".join(f"u{i}" for i in range(13)), f"é {LONG}"))
    rows = d.clean(docs, benchmark)
    assert rows.columns == docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in rows.collect()}
    assert texts == {0: (rest + "Before, after.", 1214), 1: (docs.collect()[1].text, docs.collect()[1].n_chars)}


def test_words():
    assert folded_words("A-b_C9é, ñ'x".encode()) == ["a".encode(), b"b", "c9é".encode(), "ñ".encode(), b"x"]
