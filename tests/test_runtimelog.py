from datetime import datetime

import pytest
from footfall.functions.runtimelog import parse_runtime_log
from footfall.operators.enrich import shown_objects

HEAD = "03 Jan 2024 10:11:12,345  INFO [h1]  (com.x.Unit) - "

# rest -> shape, session, miu, page, unit, trace, message, oids
CASES = [
    ("[s1][page1][dau1][step][t-1] shown {oid=[1, 2]}", (1, "s1", None, "page1", "dau1", "t-1", " shown {oid=[1, 2]}", [1, 2])),
    ("[s1][m1][page1][dau1][step][t-1] shown {oid=[1]}", (1, "s1", "m1", "page1", "dau1", "t-1", " shown {oid=[1]}", [1])),
    ("[s1][m1][page1][dau1][step][t1] shown {oid=[7]}", (1, "s1", "m1", "page1", "dau1", "t1", " shown {oid=[7]}", [7])),
    ("[s1][page1][dau1][step][t-1] a=[5] {oid=[1, x]} end", (1, "s1", None, "page1", "dau1", "t-1", " a=[5] {oid=[1, x]}", [1, None])),
    ("[s1][page1][dau1][step][t-1] done {}", (2, "s1", None, "page1", "dau1", "t-1", " done {}", None)),
    ("[s1][m1][page1][dau1][step][t-1] done {} end", (2, "s1", "m1", "page1", "dau1", "t-1", " done {}", None)),
    ("[s1][page1][dau1]started", (3, "s1", None, "page1", "dau1", None, "started", None)),
    ("[s1][m1][page1][dau1]started", (3, "s1", "m1", "page1", "dau1", None, "started", None)),
    ("[s1][m1][page1][dau1]", (3, "s1", "m1", "page1", "dau1", None, "", None)),
    ("[s1][page1]no unit", (4, "s1", None, "page1", None, None, "no unit", None)),
    ("[s1]nothing else", None),
    ("no brackets", None),
]


@pytest.mark.parametrize("rest, want", CASES, ids=[c[0] for c in CASES])
def test_shape_and_fields(lines, rest, want):
    row = parse_runtime_log(lines(HEAD + rest)).first()
    got = (row.shape, row.session_id, row.miu_id, row.page_id, row.unit_id, row.trace, row.message, row.oids)
    assert got == (want or (None,) * 8)
    if want:
        assert row.time == datetime(2024, 1, 3, 10, 11, 12)
        assert (row.log_level, row.host, row.java_class) == ("INFO", "h1", "com.x.Unit")


def test_objects_become_rows_without_those_that_are_no_numbers(lines):
    log = lines(*(HEAD + c[0] for c in CASES))
    assert sorted(r.oid for r in shown_objects(parse_runtime_log(log)).collect()) == [1, 1, 1, 2, 7]


def test_single_spaces_do_not_make_a_line(lines):
    assert parse_runtime_log(lines((HEAD + "[s1][page1]x").replace("  ", " "))).first().shape is None


LONG = 1_000_000


@pytest.mark.parametrize(
    "line, shape",
    [
        ("x" * LONG, None),
        ("x " * (LONG // 2), None),
        ("03 Jan 2024 10:11:12 " * (LONG // 21), None),
        (HEAD + "[" * LONG, None),
        (HEAD + ") - [" * (LONG // 5), None),
        (HEAD + "[s1][page1]" + "[x" * (LONG // 2), 4),
        (HEAD + "[s1][page1][dau1][step][t-1]" + "[x" * (LONG // 2), 3),
        (HEAD + "[s1][page1][dau1][step][t-1]" + "{" * LONG, 3),
        (HEAD + "[s1][page1][dau1][step][t-1]" + "x" * LONG + "[1, 2]}", 1),
    ],
    ids=["word", "words", "times", "brackets", "dashes", "open", "open after trace", "braces", "message"],
)
def test_long_lines_take_linear_time(lines, line, shape):
    import time

    start = time.monotonic()
    assert parse_runtime_log(lines(line)).first().shape == shape
    assert time.monotonic() - start < 20
