import pytest
from hypothesis import given, settings, strategies as st

from ambergrid.lang import bql, find, time_filter
from ambergrid.lang.errors import ParseError, TimeFilterError, code_of

GOOD = 'FROM seed("a b") BALLOON radius=2 direction=up_down FILTER pack="p" RETURN id, depth TOP 7'


def test_parts_of_a_query():
    q = bql.parse(GOOD)
    assert (q.kind, q.value, q.radius, q.direction, q.fields, q.top, q.explain) == ("seed", "a b", 2, "up_down", ("id", "depth"), 7, False)
    assert q.filters == ({"field": "pack", "op": "=", "value": "p"},)
    tree = q.as_dict()
    assert tree["source"] == {"kind": "seed", "value": "a b"} and tree["balloon"] == {"radius": 2, "direction": "up_down"} and tree["top"] == 7


def test_case_space_and_bare_values():
    q = bql.parse("explain\n from Concept(x:1.y-z)  balloon RADIUS = 1 direction = LATERAL return a")
    assert q.explain and q.kind == "concept" and q.value == "x:1.y-z" and q.direction == "lateral" and q.top is None


@pytest.mark.parametrize(
    "text, code",
    [
        ("", "BQL_PARSE_ERROR"),
        (None, "BQL_PARSE_ERROR"),
        ("SELECT 1", "BQL_UNSUPPORTED_SYNTAX"),
        ("FROM other(x) BALLOON radius=1 direction=up RETURN a", "BQL_UNSUPPORTED_SYNTAX"),
        (GOOD.replace("radius=2", "radius=4"), "BQL_RADIUS_OUT_OF_BOUNDS"),
        (GOOD.replace("radius=2", "radius=0"), "BQL_RADIUS_OUT_OF_BOUNDS"),
        (GOOD.replace("TOP 7", "TOP 51"), "BQL_TOP_OUT_OF_BOUNDS"),
        (GOOD.replace("TOP 7", "TOP 0"), "BQL_TOP_OUT_OF_BOUNDS"),
        (GOOD + " EXEC", "BQL_UNSAFE_TOKEN"),
        (GOOD.replace("a b", "x; y"), "BQL_UNSAFE_TOKEN"),
        (GOOD.replace("a b", "the os here"), "BQL_UNSAFE_TOKEN"),
        (GOOD.replace("a b", "a__b"), "BQL_UNSAFE_TOKEN"),
        (GOOD.replace("up_down", "sideways"), "BQL_PARSE_ERROR"),
        (GOOD.replace('pack="p"', "x > 5"), "BQL_TIME_FILTER_PARSE_ERROR"),
        (GOOD.replace('pack="p"', "ts > -5"), "BQL_TIME_FILTER_PARSE_ERROR"),
        (GOOD.replace('pack="p"', "ts IN last_year"), "BQL_TIME_FILTER_PARSE_ERROR"),
        (GOOD.replace('pack="p"', "pack like p"), "BQL_TIME_FILTER_PARSE_ERROR"),
        (GOOD.replace('pack="p"', "depth = x"), "BQL_PARSE_ERROR"),
        (GOOD.replace("RETURN", "GIVE"), "BQL_PARSE_ERROR"),
        (GOOD.replace("id, depth", "id, 2x"), "BQL_PARSE_ERROR"),
    ],
)
def test_refused(text, code):
    with pytest.raises(ParseError) as error:
        bql.parse(text)
    assert code_of(error.value) == code


def test_words_inside_words_are_safe():
    assert bql.parse(GOOD.replace("a b", "cosmos walnut")).value == "cosmos walnut"


def test_first_return_ends_the_filter_even_in_quotes():
    with pytest.raises(ParseError):
        bql.parse('FROM seed(a) BALLOON radius=1 direction=up FILTER x = "a return b" RETURN c')


def test_ts_equality_is_plain_and_depth_is_a_number():
    assert bql.parse_filter("ts = 5") == dict(op="=", value="5", field="ts")
    assert bql.parse_filter("depth = 2")["value"] == 2
    assert bql.parse_filter("TS > 5") == dict(op=">", value=5, field="ts")


def test_windows_are_closed_and_end_now():
    f = time_filter.parse("ts IN Last_Hour")
    now, hour = 10_000_000, 3_600_000
    assert [time_filter.matches(t, f, now) for t in (now, now - hour, now - hour - 1, now + 1, str(now), True, None, 1.5)] == [True, True, False, False, True, False, False, False]
    with pytest.raises(TimeFilterError):
        time_filter.matches(1, {"op": "in_window", "window": "x"}, now)


def test_find():
    assert find.parse(' find Type = "CONCEPT" ') == ("type", "CONCEPT")
    assert find.parse("SELECT * FROM x") is None and find.parse("FIND size = 1") is None


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_parses_or_is_refused(text):
    try:
        bql.parse(text)
    except ParseError as error:
        assert error.code.startswith("BQL_")
