"""Parsing, canonical text and rewrites; nothing here needs Spark."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftflow.lang import ir, literals
from siftflow.lang.lexer import QueryError
from siftflow.lang.parser import parse
from siftflow.plans import rewrite

NOW = 1_706_745_600_000_000  # 2024-02-01


@pytest.mark.parametrize(
    "text,canonical",
    [
        ("*", "*"),
        ("foo bar", "foo bar"),
        ("foo AND bar or baz", "foo bar or baz"),
        ("a:(b or !c)", "(a:b or !a:c)"[1:-1]),
        ("not not foo", "foo"),
        ("-foo:bar", "!foo:bar"),
        ('"or" "fields"', '"or" "fields"'),
        ("foo-bar.baz*", '"foo-bar.baz"*'),
        ("a:=b", "a:=b"),
        ("a=b c!=d", "a:=b !c:=d"),
        ("a:=b*", "a:=b*"),
        ("a:>5 b:<=3ms", "a:range(5, inf] b:range[-inf, 3000000]"),
        ("a:>foo", "a:>foo"),
        ("ip:ipv4_range(10.1.2.3/8)", "ip:ipv4_range(10.0.0.0, 10.255.255.255)"),
        ("x:in(a, 'b c')", 'x:in(a, "b c")'),
        ("x:in(*)", "x:in(*)"),
        ('{a="b",c=~"d.*"} e', '{a="b", c=~"d.*"} e'),
        ("_stream:{a=b}", '{a="b"}'),
        ("foo # comment\n bar", "foo bar"),
        ("* | head", "* | limit 10"),
        ("* | count() if (x:y) hits", "* | stats count(*) if (x:y) as hits"),
        ("* | by (a) max(b)", '* | stats by (a) max(b) as "max(b)"'),
        ("* | error", "* | filter error"),
        ("* | order by (a desc, b) desc limit 3", "* | sort by (a desc, b) desc limit 3"),
        ("* | top by (hits)", "* | top 10 by (hits) hits as hitss"),
        ("* | eval (a - (b - c)) * -(d + 1) default '2024-01-02T03:04:05Z'", '* | math (a - (b - c)) * -(d + 1) default "2024-01-02T03:04:05Z" as "(a - (b - c)) * -(d + 1) default \\"2024-01-02T03:04:05Z\\""'),
        ("* | count()", '* | stats count(*) as "count(*)"'),
        ("* | eval a + b * 2 ^ 3 as c", "* | math a + b * 2 ^ 3 as c"),
        ("* | rm a, b* | cp c d | mv e as f", "* | delete a, b* | copy c as d | rename e as f"),
        ("options(ignore_global_time_filter=true) foo", "options(ignore_global_time_filter=true) foo"),
    ],
)
def test_canonical(text, canonical):
    q = parse(text, NOW)
    assert str(q) == canonical and parse(str(q), NOW) == q


@pytest.mark.parametrize(
    "text",
    ["", "|", "foo |", "(foo", "foo)", "a:in(b", "fields", "count foo", "* | nothing(", "* | stats", "* | stats foo()", "* | sort by a", "* | sort partition by (a)", "* | limit x", "a:range(x, 2)", "_time:foo", "_time:week_range[Foo, Fri]", "_time:day_range[25:00, 26:00)", "* | join (foo)", "x:in(foo | limit 3)", 'a:~"("', "* | stats count() a, count() a", "* | quantile(2, x)", "* | math a +", "'open", "* | stream_context time_window 0s", "* | extract_regexp \"foo\"", "{a}", "options(x=y) *"],
)
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text, NOW)


@pytest.mark.parametrize(
    "text,low,high",
    [
        ("_time:5m", NOW - 300_000_000, NOW),
        ("_time:1h offset 1h", NOW - 7_200_000_000, NOW - 3_600_000_000),
        ("_time:2024", 1_704_067_200_000_000, 1_735_689_600_000_000),
        ("_time:2023-12", 1_701_388_800_000_000, 1_704_067_200_000_000),
        ("_time:2024-01-01T00:00+02:00", 1_704_060_000_000_000, 1_704_060_060_000_000),
        ("_time:[2024-01-01, 2024-01-02]", 1_704_067_200_000_000, 1_704_240_000_000_000),
        ("_time:(2024-01-01, 2024-01-03)", 1_704_153_600_000_000, 1_704_240_000_000_000),
        ("_time:>=2024-01-01 ", 1_704_067_200_000_000, 1 << 62),
        ("_time:<2024-01-01", -(1 << 62), 1_704_067_200_000_000),
        ("_time:>1h", -(1 << 62), NOW - 3_600_000_000),
        ("_time:[now-1d, now)", NOW - 86_400_000_000, NOW),
    ],
)
def test_times(text, low, high):
    f = parse(text, NOW).filter
    assert (f.low, f.high) == (low, high)


@pytest.mark.parametrize("text,value", [("1", 1), ("1_000", 1000), ("-1.5e3", -1500), ("0x1f", 31), ("0b11", 3), ("1KiB", 1024), ("1.5GB", 1.5e9), ("1h30m", 5.4e12), ("10.0.0.1", 167772161), ("1970-01-01T00:00:01Z", 1e9), ("foo", None), ("1x", None), ("", None)])
def test_numbers(text, value):
    assert literals.number(text) == value


words = st.text(st.sampled_from("abcXYZ019_. -\"'`\\|():=!~*<>é日{}[],#\n\t"), min_size=0, max_size=8)
fields = st.sampled_from(["_msg", "a", "b.c", "x-y", "or", "fields", "é"])


def filters():
    leaf = st.one_of(
        st.builds(ir.Phrase, fields, words),
        st.builds(ir.Prefix, fields, words.filter(bool)),
        st.builds(ir.Exact, fields, words),
        st.builds(ir.ExactPrefix, fields, words),
        st.builds(ir.AnyCase, fields, words, st.booleans()),
        st.builds(ir.Members, st.sampled_from(["in", "contains_all", "contains_any"]), fields, st.lists(words, max_size=3).map(tuple)),
        st.builds(ir.Seq, fields, st.lists(words, min_size=1, max_size=3).map(tuple)),
        st.builds(ir.Range, fields, st.integers(-5, 5).map(float), st.integers(6, 9).map(float), st.booleans(), st.booleans()),
        st.builds(ir.LenRange, fields, st.integers(0, 5).map(float), st.just(float("inf"))),
        st.builds(ir.FieldCompare, fields, st.sampled_from(["eq", "le", "lt"]), fields),
    )
    return st.recursive(
        leaf,
        lambda x: st.one_of(x.filter(lambda f: not isinstance(f, ir.Not)).map(ir.Not), st.lists(x.filter(lambda f: not isinstance(f, ir.And)), min_size=2, max_size=3).map(lambda v: ir.And(tuple(v))), st.lists(x.filter(lambda f: not isinstance(f, ir.Or)), min_size=2, max_size=3).map(lambda v: ir.Or(tuple(v)))),
        max_leaves=6,
    )


@settings(max_examples=300, deadline=None)
@given(filters())
def test_text_of_filters_parses_to_them(f):
    assert parse(str(f), NOW).filter == f


@settings(max_examples=200, deadline=None)
@given(filters())
def test_tidy_is_a_fixed_point(f):
    t = rewrite.tidy(f)
    assert rewrite.tidy(t) == t


def test_rewrites():
    go = lambda t: str(rewrite.optimize(parse(t, NOW)))
    assert go("a | filter b | filter c | fields x | filter d | where e") == "a b c | fields x | filter d e"
    assert go("* | sort by (a) | limit 5") == "* | sort by (a) limit 5"
    assert go("* | sort by (a) limit 10 | offset 3 | limit 4") == "* | sort by (a) offset 3 limit 4"
    assert go("* | sort by (a) | offset 3 | offset 2") == "* | sort by (a) offset 5"
    assert go("* | uniq by (a) | limit 3") == "* | uniq by (a) limit 3"
    assert go('x:~"a.b" y:=z * w:~".*"') == 'y:=z x:~"a.b"'
    assert go("a or * or b") == "*"


def test_filters_reach_subqueries():
    q = parse("a x:in(b | fields x) | union (c) | join by (y) (options(ignore_global_time_filter=true) d | fields y)", NOW)
    out = str(rewrite.with_filter(q, ir.Phrase("_msg", "zzz")))
    assert out.count("zzz") == 3


def test_tail_and_range_rules():
    assert rewrite.can_tail(parse("a | fields b | filter c | math d + 1 as e", NOW)) == ""
    for p in ("count()", "sort by (a)", "limit 3", "top by (a)", "uniq by (a)", "facets", "union (b)", "offset 1", "first", "field_names"):
        assert rewrite.can_tail(parse(f"a | {p}", NOW))
    r = rewrite.range_stats(parse("* | stats by (a) count() n | first 2 by (n) | filter n:>1", NOW), "5m")
    assert str(r) == '* | stats by (a, _time:"5m") count(*) as n | sort by (n) partition by (_time) limit 2 | filter n:range(1, inf]'
    with pytest.raises(ValueError):
        rewrite.range_stats(parse("* | stats count() n | uniq by (n)", NOW), "5m")
    assert rewrite.rate_step(parse("_time:5m foo | rate()", NOW)) == 300.0
