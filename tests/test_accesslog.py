from datetime import datetime

import pytest
from footfall.functions.accesslog import parse_access_log
from footfall.operators.lines import count_lines, count_shapes
from footfall.sources.state import usable

HEAD = '10.0.0.1 - - [01/Jan/2024:00:00:07 +0000] "GET /app/'
TAIL = ' HTTP/1.1" 200 512 s1'

# request, tail -> shape, session, page, source, link, attribute, oid
CASES = [
    ("page9.do?sp=page1&link=ln5&att4=29", TAIL, (1, "s1", "page9", "page1", "ln5", "att4", 29)),
    ("page9.do?att4=29&link=ln5&sp=page1", TAIL, (1, "s1", "page9", "page1", "ln5", "att4", 29)),
    ("page9.do?link=ln5&att4=29", TAIL, (2, "s1", "page9", "page9", "ln5", "att4", 29)),
    ("page9.do?link=ln5&att4=29&att7=3", TAIL, (2, "s1", "page9", "page9", "ln5", "att4", 29)),
    ("page9.do?sp=a&sp=b&link=l1&link=l2&att4=1", TAIL, (1, "s1", "page9", "b", "l2", "att4", 1)),
    ("page9.do?xsp=page1&link=ln5&att4=29", TAIL, (2, "s1", "page9", "page9", "ln5", "att4", 29)),
    ("page9.do?sp=&link=ln5&att4=29", TAIL, (2, "s1", "page9", "page9", "ln5", "att4", 29)),
    ("page9.do?link=ln5&att4=99999999999999999999", TAIL, (2, "s1", "page9", "page9", "ln5", "att4", None)),
    ("mpage9.do", TAIL, (3, "s1", "mpage9", None, None, None, 0)),
    ("a/b/page9.do", TAIL, (3, "s1", "page9", None, None, None, 0)),
    ("page9.do?sp=page1", TAIL, (4, "s1", "page9", "page1", None, None, 0)),
    ("login.do?sp=page1", TAIL, (4, "s1", "login", "page1", None, None, 0)),
    ("page9.do?sp=page1&link=ln5", TAIL, (4, "s1", "page9", "page1", None, None, 0)),
    ("page9.do;jsessionid=s8", ' HTTP/1.1" 302 -', (5, "s8", "page9", None, None, None, 0)),
    ("page9.do;jsessionid=s8", TAIL, (5, "s8", "page9", None, None, None, 0)),
    ("page9.do;jsessionid=s8?sp=page1", TAIL, (4, "s1", "page9", "page1", None, None, 0)),
    ("page9.do?sp=page1&link=ln5&att4=29", ' HTTP/1.1" 200 - s1', None),
    ("login.do", TAIL, None),
    ("page9.do?link=ln5", TAIL, None),
    ("page9.html?sp=page1", TAIL, None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, HEAD + request + tail) for i, (request, tail, _) in enumerate(CASES)]
    return [
        parse_access_log(spark.createDataFrame([(line,)], "value string")).first() for _, line in rows
    ]


@pytest.mark.parametrize("number", range(len(CASES)), ids=[c[0] + c[1][-6:] for c in CASES])
def test_shape_and_fields(parsed, number):
    row, want = parsed[number], CASES[number][2]
    got = (
        row.shape,
        row.session_id,
        row.requested_page_id,
        row.source_page_id,
        row.clicked_link_id,
        row.clicked_attribute_id,
        row.clicked_oid,
    )
    assert got == (want or (None,) * 7)
    assert row.ip == ("10.0.0.1" if want else None)
    assert row.time == (datetime(2024, 1, 1, 0, 0, 7) if want else None)


def test_unmatched_lines_are_counted_not_lost(lines):
    log = lines(HEAD + "page9.do" + TAIL, "junk", "", HEAD + "login.do" + TAIL)
    assert {r.shape: r.lines for r in count_shapes(parse_access_log(log)).collect()} == {3: 1, 0: 3}


def test_impossible_day_is_no_time_and_is_not_taken_in(lines):
    log = lines(HEAD.replace("01/Jan", "32/Jan") + "page9.do" + TAIL, HEAD.replace("01/Jan", "1/Jan") + "page9.do" + TAIL)
    parsed = parse_access_log(log)
    assert sorted(str(r.time) for r in parsed.collect()) == ["2024-01-01 00:00:07", "None"]
    assert usable(parsed).count() == 1
    counted = {r.shape: (r.lines, r.bad_dates) for r in count_lines(parsed, "access").collect()}
    assert counted == {3: (2, 1)}


def test_separator_characters_in_a_line_do_no_harm(lines):
    mark = "\u0001"
    rows = parse_access_log(lines(mark * 8 + "x", HEAD + f"page9.do?sp=p{mark}q" + TAIL)).collect()
    assert rows[0].shape is None
    assert (rows[1].shape, rows[1].source_page_id, rows[1].session_id) == (4, "p", "s1")


LONG = 1_000_000


@pytest.mark.parametrize(
    "line",
    [
        "x" * LONG,
        "x " * (LONG // 2),
        "/" * LONG,
        HEAD + "/" * LONG,
        HEAD + "a/" * (LONG // 2),
        HEAD + "page9.do?" + "&sp=" * (LONG // 4),
        HEAD + "page9.do?" + '" 2' * (LONG // 3),
        "1 " + "[01/Jan/2024:00:00:07] " * (LONG // 23),
    ],
    ids=["word", "words", "slashes", "path", "segments", "parameters", "quotes", "times"],
)
def test_long_lines_take_linear_time(lines, line):
    import time

    start = time.monotonic()
    assert parse_access_log(lines(line)).first().shape is None
    assert time.monotonic() - start < 20


def test_whole_texts_are_read(lines):
    pad = "x" * LONG
    row = parse_access_log(lines(HEAD + f"page9.do?pad={pad}&sp=page1&link=ln5&att4=29&q={pad}" + TAIL)).first()
    assert (row.shape, row.source_page_id, row.clicked_oid, row.session_id) == (1, "page1", 29, "s1")
