"""Operators on small rows: missing is empty, order doesn't matter, and any partitioning gives the same result."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from siftflow.engine import Engine
from siftflow.frame import LogFrame
from siftflow.lang.lexer import QueryError

NOW = "2024-02-01T00:00:00Z"
SF = "/root/testdata/sf0.001"


def log(spark, rows, parts=None, **how):
    names = list(dict.fromkeys(k for r in rows for k in r))
    df = spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], ", ".join(f"`{k}` string" for k in names))
    if "_time" in names:
        df = df.withColumn("_time", F.col("_time").cast("timestamp"))
    return Engine(LogFrame.of(df.repartition(parts or random.randint(1, 4)), **how), NOW)


def run(e, query, **args):
    """Rows as dicts of the values that aren't empty, in any order."""
    out = [{k: str(v) for k, v in r.asDict().items() if v is not None and v != ""} for r in e.query(query, **args).collect()]
    return sorted(out, key=lambda d: json.dumps(d, sort_keys=True))


def want(*rows):
    return sorted(rows, key=lambda d: json.dumps(d, sort_keys=True))


TEXTS = ["an error happened", "error: x", "(error)", "errors", "ERROR", "_error", "éerror", "", None, "no Error; error_1"]


def test_quantiles_of_many_values_are_exact(spark):
    n = 150_000
    df = spark.range(n).selectExpr("IF(id % 30 = 0, NULL, 'g') AS g", "concat('v', (id * 7919) % 150000) AS t", "CAST(IF(id % 50 = 1, NULL, (id * 7919) % 150000) AS BIGINT) AS x", "CAST((id * 7919) % 150000 AS DOUBLE) AS y")
    got = Engine(LogFrame.of(df.repartition(3)), NOW).query("* | stats by (g) quantile(0.37, t) a, median(t) b, quantile(0.37, x) c, quantile(0, x) d, median(x) if (x:>100) e, quantile(0.999, y) f, quantile(1, y) h, median(x) if (x:<0) i, count() n").collect()
    rows = [(i % 30 > 0, i * 7919 % n, i % 50 != 1) for i in range(n)]
    at = lambda vs, phi: sorted(vs)[min(int(phi * len(vs)), len(vs) - 1)] if vs else None
    for r in got:
        own = [(v, there) for g, v, there in rows if g == (r.g == "g")]
        ys = [v for v, _ in own]
        xs = [v if there else -1 for v, there in own]
        none = lambda v: None if v == -1 else v
        assert (r.a, r.b, r.f, r.h, r.i, r.n) == (f"v{at(ys, 0.37)}", f"v{at(ys, 0.5)}", at(ys, 0.999), max(ys), None, len(own))
        assert (r.c, r.d, r.e) == (none(at(xs, 0.37)), none(min(xs)), at([x for x in xs if x > 100], 0.5))
    assert len(got) == 2


PHRASES = ["error", "(error)", "x", "", ":", "é", "1", "no", "error; ", "an error", "err", "a.b"]


@pytest.mark.parametrize("limit", [0, 1000])
def test_contains_subquery_of_many_values(spark, monkeypatch, limit):
    from siftflow.operators import filters

    rows = [{"kind": "t", "i": str(i), "msg": t} for i, t in enumerate(TEXTS + ["a.b: an error", "axb", "-", "error"])] + [{"kind": "p", "p": p} for p in PHRASES]
    e = log(spark, rows)
    ids = lambda q: sorted(int(r["i"]) for r in run(e, f"kind:=t {q} | fields i"))
    listed = lambda ps: ", ".join(json.dumps(p) for p in ps)
    some = ['p:=error or p:="an error"', 'p:="" kind:=p', "p:=x or p:=1", 'p:=":" or p:="(error)"', "kind:=p p:*", "kind:=p", "p:=none"]
    picked = [["error", "an error"], [""], ["x", "1"], [":", "(error)"], [p for p in PHRASES if p], PHRASES, []]
    wanted = {(k, n, neg): ids(f"{neg}msg:{k}({listed(ps)})") for k in ("contains_any", "contains_all") for n, ps in enumerate(picked) if ps for neg in ("", "!")}
    either = ids("(i:=7 or msg:contains_any(x, 1))")
    monkeypatch.setattr(filters, "MAX_INLINE", limit)
    assert {(k, n, neg): ids(f"{neg}msg:{k}(kind:=p ({some[n]}) | fields p)") for k, n, neg in wanted} == wanted
    assert ids("(i:=7 or msg:contains_any(kind:=p (p:=x or p:=1) | fields p))") == either
    assert ids("msg:contains_any(p:=none | fields p)") == []


def test_contains_any_of_more_values_than_the_plan_takes(spark):
    e = log(spark, [{"p": f"word {i}"} for i in range(10_050)] + [{"msg": "a word 10049"}, {"msg": "word 10050"}, {"msg": "no"}])
    assert run(e, "msg:contains_any(p:* | fields p) | fields msg") == [{"msg": "a word 10049"}]


def test_contains_any_of_all_benchmark_items(spark):
    from siftflow import catalog

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    has = lambda t, p: re.search(("(?<!\\w)" if p[0].isalnum() else "") + re.escape(p) + ("(?!\\w)" if p[-1].isalnum() else ""), t) is not None
    got = [r.doc_id for r in catalog.QUERIES["filter_contains_any_subquery_whole"](spark, SF).collect()]
    assert sorted(got) == sorted(d for d, t in docs if any(has(t, p) for p in items)) and got


def brute_units(event, user):
    from datetime import UTC, datetime

    out, rest = "", event
    for name, size in (("w", 604_800_000), ("d", 86_400_000), ("h", 3_600_000), ("m", 60_000)):
        out, rest = out + (f"{rest // size}{name}" if rest >= size else ""), rest % size
    if event >= 1000:
        out += (f"{rest // 1000}.{rest % 1000:03}".rstrip("0").rstrip(".") + "s") if rest else ""
    else:
        out = f"{event}ms" if event else "0s"
    return f"{out} {'.'.join(str(b) for b in event.to_bytes(4))} {datetime.fromtimestamp(user, UTC):%Y-%m-%dT%H:%M:%SZ}"


def test_units_of_all_events(spark, tmp_path):
    from siftflow import catalog

    r = random.Random(4)
    ids = [0, 1, 999, 1000, 1001, 1010, 1024, 59_999, 60_000, 60_001, 99_999, 3_600_000, 86_400_000, 604_800_000, 2**24, 2**32 - 1] + [r.randrange(2**r.randrange(10, 33)) for _ in range(300)]
    rows = [(i, r.randrange(2_000_000_000)) for i in dict.fromkeys(ids)]
    made = spark.createDataFrame(rows, "event_id long, user_id long").selectExpr("event_id", "timestamp'2024-01-01' AS ts", "user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props")
    made.write.parquet(f"{tmp_path}/events.parquet")
    for at in (str(tmp_path), SF.replace("sf0.001", "sf0.01")):
        events = [tuple(x) for x in spark.read.parquet(f"{at}/events.parquet").select("event_id", "user_id").collect()]
        assert {tuple(x) for x in catalog.QUERIES["pipe_format_units_whole"](spark, at).collect()} == {(e, brute_units(e, u)) for e, u in events}


@pytest.mark.parametrize(
    "query,found",
    [
        ("error", [0, 1, 2]),
        ("error*", [0, 1, 2, 3, 9]),
        ("i(error)", [0, 1, 2, 4, 9]),
        ("i(ERR*)", [0, 1, 2, 3, 4, 9]),
        ('"error happened"', [0]),
        ('"error:"', [1]),
        ('"(error"', [2]),
        ('""', [7, 8]),
        ("!error", [3, 4, 5, 6, 7, 8, 9]),
        ("_msg:*", [0, 1, 2, 3, 4, 5, 6, 9]),
        ('_msg:=""', [7, 8]),
        ("_msg:!=errors", [0, 1, 2, 4, 5, 6, 7, 8, 9]),
        ("~err", [0, 1, 2, 3, 5, 6, 9]),
        ("!~err", [4, 7, 8]),
        ("seq(an, happened)", [0]),
        ("seq(happened, an)", []),
        ("contains_all(an, error)", [0]),
        ("contains_any(errors, ERROR)", [3, 4]),
        ("in(errors, ERROR)", [3, 4]),
        ('in("", errors)', [3, 7, 8]),
        ("in()", []),
        ("len_range(6, 7)", [2, 3, 5, 6]),
        ("len_range(0, 0)", [7, 8]),
        ("string_range(a, f)", [0, 1, 3]),
        ("(error or errors) !happened", [1, 2, 3]),
        ("nothing:x", []),
        ('nothing:="" error', [0, 1, 2]),
        ("*:errors", [3]),
        ("=error*", [1, 3]),
    ],
)
def test_text_filters(spark, query, found):
    e = log(spark, [{"_msg": t, "i": str(i)} for i, t in enumerate(TEXTS)])
    assert sorted(int(r["i"]) for r in run(e, query)) == found


VALUES = ["5", "5.5", "1KiB", "1500ms", "10.0.0.7", "2024-01-02T03:04:05Z", "0x10", "foo", "", None, "-3", "NaN", "1_000", "1d"]


@pytest.mark.parametrize(
    "query,found",
    [
        ("v:>5", [1, 2, 3, 4, 5, 6, 12, 13]),
        ("v:range[5, 5.5]", [0, 1]),
        ("v:range(5, 16]", [1, 6]),
        ("v:<0", [10]),
        ("v:>=1KB v:<=1KiB", [2, 12]),
        ("v:>1s v:<2d", [3, 13]),
        ("v:ipv4_range(10.0.0.0/24)", [4]),
        ("v:ipv4_range(10.0.0.8, 10.0.0.9)", []),
        ("v:>=2024-01-01T00:00:00Z v:<2024-02-01T00:00:00Z", [5]),
        ("v:>e", [7]),
        ("v:=5", [0]),
        ("v:lt_field(w)", [8, 9, 10]),
        ("v:eq_field(v2)", [8, 9]),
    ],
)
def test_number_filters(spark, query, found):
    e = log(spark, [{"v": t, "w": "3", "v2": None, "i": str(i)} for i, t in enumerate(VALUES)])
    assert sorted(int(r["i"]) for r in run(e, query)) == found


def test_nan_of_native_columns_matches_nothing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (float("inf"),)], "x double")
    e = Engine(LogFrame(df), NOW)
    assert [r["n"] for r in run(e, "x:>0 | count() n")] == ["2"]
    assert [r["n"] for r in run(e, "!x:>0 | count() n")] == ["2"]
    assert run(e, "x:>0 | stats sum(x) s") == [{"s": "inf"}]


@pytest.mark.parametrize(
    "pipe,before,after",
    [
        ("fields a, z", [{"a": "1", "b": "2"}], [{"a": "1"}]),
        ("fields a*", [{"a": "1", "ab": "2", "b": "3"}], [{"a": "1", "ab": "2"}]),
        ("delete a*", [{"a": "1", "ab": "2", "b": "3"}], [{"b": "3"}]),
        ("copy a as b, b as c", [{"a": "1", "b": "2"}], [{"a": "1", "b": "1", "c": "1"}]),
        ("rename a as b", [{"a": "1", "b": "2"}], [{"b": "1"}]),
        ("rename a* as x*", [{"a1": "1", "a2": "2", "b": "3"}], [{"x1": "1", "x2": "2", "b": "3"}]),
        ("copy z as a", [{"a": "1", "b": "2"}], [{"b": "2"}]),
        ("drop_empty_fields", [{"a": "", "b": "2"}, {"a": "", "b": None}], [{"b": "2"}]),
        ("field_names", [{"a": "1", "b": ""}, {"a": "2", "b": "x"}], [{"name": "a", "hits": "2"}, {"name": "b", "hits": "1"}]),
        ("pack_json as j | fields j", [{"b": 'x"y', "a": "1", "c": ""}], [{"j": '{"b":"x\\"y","a":"1"}'}]),
        ("pack_logfmt fields (a, b) as j | fields j", [{"a": "1", "b": "x y"}], [{"j": 'a=1 b="x y"'}]),
        ('extract "ip=<ip> " from a', [{"a": "foo ip=1.2.3.4 bar"}, {"a": "none", "ip": "old"}], [{"a": "foo ip=1.2.3.4 bar", "ip": "1.2.3.4"}, {"a": "none"}]),
        ('extract "<x>=<y>,<_>;<z>" from a', [{"a": 'k="v,1",rest;end'}], [{"a": 'k="v,1",rest;end', "x": "k", "y": "v,1", "z": "end"}]),
        ('extract "k=<plain:y>;" from a', [{"a": 'k="v";'}], [{"a": 'k="v";', "y": '"v"'}]),
        ('extract if (b:x) "k=<y>" from a', [{"a": "k=1", "b": "x"}, {"a": "k=2", "b": "z", "y": "old"}], [{"a": "k=1", "b": "x", "y": "1"}, {"a": "k=2", "b": "z", "y": "old"}]),
        ('extract "k=<y>" from a keep_original_fields', [{"a": "k=1", "y": "old"}], [{"a": "k=1", "y": "old"}]),
        ('extract "k=<y>" from a skip_empty_results', [{"a": "z", "y": "old"}], [{"a": "z", "y": "old"}]),
        ('extract_regexp "(?P<user_id>[0-9]+)-(?P<b>x)?" from a', [{"a": "q 12-x"}, {"a": "q"}], [{"a": "q 12-x", "user_id": "12", "b": "x"}, {"a": "q"}]),
        ('format "<uc:a>/<q:b>/<hexencode:a>/<z>" as c', [{"a": "xy", "b": 'p"q'}], [{"a": "xy", "b": 'p"q', "c": 'XY/"p\\"q"/7879/'}]),
        ('format "<duration:a> <duration_seconds:b> <ipv4:c>" as d | fields d', [{"a": "3723000000000", "b": "1m3.5s", "c": "16909060"}], [{"d": "1h2m3s 63.5 1.2.3.4"}]),
        ('format "<time:a>,<base64decode:b>,<urldecode:c>,<hexnumdecode:d>" as e | fields e', [{"a": "1700000000123", "b": "Zm9v", "c": "a%20b%zz", "d": "ff"}], [{"e": "2023-11-14T22:13:20.123Z,foo,a%20b%zz,255"}]),
        ("math a + b * 2 as c, c / 0 as d, -a ^ 2 as e, z default 7 as f, round(a / 3, 0.1) as g, max(a, z) as h | fields c, d, e, f, g, h", [{"a": "1", "b": "2KB"}], [{"c": "4001.0", "d": "inf", "e": "1.0", "f": "7.0", "g": "0.3", "h": "1.0"}]),
        ("math 7 % 4 as a, 6 & 3 as b, 6 or 3 as c, 6 xor 3 as d, abs(-2) as e, ceil(1.2) as f, floor(-1.2) as g, ln(exp(2)) as h, min(3, 1) as i | fields a, b, c, d, e, f, g, h, i", [{"q": "1"}], [{"a": "3.0", "b": "2.0", "c": "7.0", "d": "5.0", "e": "2.0", "f": "2.0", "g": "-2.0", "h": "2.0", "i": "1.0"}]),
        ('replace ("a", "bb") at x', [{"x": "aXa"}], [{"x": "bbXbb"}]),
        ('replace ("a", "bb") at x limit 1', [{"x": "aXa"}], [{"x": "bbXa"}]),
        ('replace ("a", "") at x limit 2', [{"x": "aaa"}, {"x": "ba"}], [{"x": "a"}, {"x": "b"}]),
        ('replace_regexp ("([0-9]+)-(?P<n>x)", "${2}<$1>") at x', [{"x": "12-x 3-x"}], [{"x": "x<12> x<3>"}]),
        ('replace_regexp ("[0-9]", "_") at x limit 2', [{"x": "123"}], [{"x": "__3"}]),
        ("collapse_nums at x", [{"x": "2024-01-02T10:20:30.123Z pid=77 deadbeef foo12 1a 12ms"}], [{"x": "<N>-<N>-<N>T<N>:<N>:<N>.<N>Z pid=<N> <N> foo12 1a <N>ms"}]),
        ("collapse_nums at x prettify", [{"x": "2024-01-02T10:20:30.123Z 10.1.2.3 0a1b2c3d-1111-2222-3333-444455556666"}], [{"x": "<DATETIME> <IP4> <UUID>"}]),
        ("decolorize x", [{"x": "\x1b[1;31mred\x1b[0m"}], [{"x": "red"}]),
        ("len(x) as n", [{"x": "é1"}], [{"x": "é1", "n": "3"}]),
        ("json_array_len(x) as n", [{"x": "[1,[2,3]]"}, {"x": "foo"}], [{"x": "[1,[2,3]]", "n": "2"}, {"x": "foo", "n": "0"}]),
        ("hash(x) as n | fields n", [{"x": "abc"}], [{"n": str(0x44BC2CF5AD770999 & ((1 << 53) - 1))}]),
        ("unpack_json from x fields (a, b.c)", [{"x": '{"a":1,"b":{"c":[1,"q"]}}'}, {"x": "bad", "a": "old"}], [{"x": '{"a":1,"b":{"c":[1,"q"]}}', "a": "1", "b.c": '[1,"q"]'}, {"x": "bad", "a": "old"}]),
        ("unpack_json from x fields (a, b)", [{"x": '{"a":1}', "b": "old"}], [{"x": '{"a":1}', "a": "1"}]),
        ("unpack_json from x fields (a, b) skip_empty_results", [{"x": '{"a":1}', "b": "old"}], [{"x": '{"a":1}', "a": "1", "b": "old"}]),
        ("unpack_json from x keep_original_fields", [{"x": '{"a":1,"b":2}', "b": "old"}], [{"x": '{"a":1,"b":2}', "a": "1", "b": "old"}]),
        ("unpack_json if (c:y) from x fields (a, n*)", [{"x": '{"a":1,"n1":2}', "c": "y", "n1": "o"}, {"x": '{"a":1,"n1":2}', "n1": "o"}], [{"x": '{"a":1,"n1":2}', "c": "y", "a": "1", "n1": "2"}, {"x": '{"a":1,"n1":2}', "n1": "o"}]),
        ("unpack_json from x result_prefix p.", [{"x": '{"a":1.50,"b":{"c":true,"d":null}}'}, {"x": "bad"}], [{"x": '{"a":1.50,"b":{"c":true,"d":null}}', "p.a": "1.50", "p.b.c": "true"}, {"x": "bad"}]),
        ("unpack_logfmt from x", [{"x": 'a=1 b="c d" e'}], [{"x": 'a=1 b="c d" e', "a": "1", "b": "c d"}]),
        ("unpack_syslog from x fields (app_name, proc_id, sd@1.k, message, level) | delete x", [{"x": '<165>1 2021-02-03T04:05:06.7Z box tool 99 M1 [sd@1 k="v\\"1"] hi'}, {"x": "<38>Nov  9 01:02:03 box loader[1]: Begins"}], [{"app_name": "tool", "proc_id": "99", "sd@1.k": 'v"1', "message": "hi", "level": "notice"}, {"app_name": "loader", "proc_id": "1", "message": "Begins", "level": "info"}]),
        ("unpack_words from x as y drop_duplicates | fields y", [{"x": "foo,bar foo тест_1"}], [{"y": '["foo","bar","тест_1"]'}]),
        ("unroll by (a, b)", [{"a": "[1,2]", "b": '["x"]', "c": "q"}, {"a": "bad", "b": "", "c": "r"}], [{"a": "1", "b": "x", "c": "q"}, {"a": "2", "c": "q"}, {"c": "r"}]),
        ("sort by (a) | limit 2", [{"a": "10"}, {"a": "9"}, {"a": "x10"}, {"a": "x9"}], [{"a": "9"}, {"a": "10"}]),
        ("last 2 by (a) rank as r", [{"a": "1"}, {"a": "x10"}, {"a": "x9"}], [{"a": "x10", "r": "1"}, {"a": "x9", "r": "2"}]),
        ("sort by (a) partition by (b) limit 1 rank", [{"a": "2", "b": "x"}, {"a": "1", "b": "x"}, {"a": "3"}], [{"a": "1", "b": "x", "rank": "1"}, {"a": "3", "rank": "1"}]),
        ("sort by (a) rank as r offset 1", [{"a": "1"}, {"a": "2"}, {"a": "3"}], [{"a": "2", "r": "2"}, {"a": "3", "r": "3"}]),
        ("uniq by (a) with hits", [{"a": "1"}, {"a": "1"}, {"a": ""}, {"b": "x"}], [{"a": "1", "hits": "2"}, {"hits": "2"}]),
        ("uniq by (a) with hits limit 1 | fields hits", [{"a": "1"}, {"a": "1"}, {"a": "2"}], [{"hits": "0"}]),
        ("top 2 by (a) rank", [{"a": x} for x in "bbaac"], [{"a": "a", "hits": "2", "rank": "1"}, {"a": "b", "hits": "2", "rank": "2"}]),
        ("facets 1", [{"a": "x", "c": "k"}, {"a": "x", "c": "k"}, {"a": "y", "c": "k"}, {"b": "z" * 200}, {"b": "q"}], [{"field_name": "a", "field_value": "x", "hits": "2"}, {"field_name": "c", "field_value": "k", "hits": "3"}]),
        ("field_values a", [{"a": "1"}, {"a": "1"}], [{"a": "1", "hits": "2"}]),
        ("stats by (b) count() n, count(a) na, count_empty(a) ea, count_uniq(a) ua", [{"a": "1", "b": "x"}, {"a": "", "b": "x"}, {"a": "1"}], [{"b": "x", "n": "2", "na": "1", "ea": "1", "ua": "1"}, {"n": "1", "na": "1", "ea": "0", "ua": "1"}]),
        ("stats sum(a) s, avg(a, b) v, min(a) lo, max(a) hi, sum_len(a) l", [{"a": "10", "b": "x"}, {"a": "9"}, {"a": "1KB", "b": "1"}], [{"s": "1019.0", "v": "255.0", "lo": "9", "hi": "1KB", "l": "6"}]),
        ("stats min(a) lo, max(b) hi", [{"a": "v1.10", "b": "v1.10"}, {"a": "v1.9", "b": "v1.9"}], [{"lo": "v1.9", "hi": "v1.10"}]),
        ("stats sum(a) s, count() n", [{"a": "x"}], [{"s": "nan", "n": "1"}]),
        ("stats quantile(0.5, a) q, median(a) m, quantile(0, a) z, quantile(1, a) o", [{"a": str(i)} for i in range(10)], [{"q": "5", "m": "5", "z": "0", "o": "9"}]),
        ("stats median(b) m, median(*) all, quantile(0.9, a, b) q, count() n", [{"a": "2", "b": "3"}, {"a": "1"}, {"a": "v10", "b": "54"}], [{"m": "3", "all": "3", "q": "v10", "n": "3"}]),
        ("stats min(*) lo, min(b) none, row_max(z) r", [{"a": "2", "b": "3"}, {"a": "1"}], [{"lo": "1", "r": "{}"}]),
        ("stats uniq_values(a) u, values(b) v, uniq_values(a) limit 1 w", [{"a": "10", "b": "q"}, {"a": "9", "b": "q"}, {"a": "9", "b": "q"}], [{"u": '["9","10"]', "v": '["q","q","q"]', "w": '["9"]'}]),
        ("stats row_min(a, b) lo, row_max(a) hi, row_any(z) any", [{"a": "10", "b": "x"}, {"a": "9", "b": "y"}, {"b": "z"}], [{"lo": '{"b":"y"}', "hi": '{"a":"10","b":"x"}', "any": "{}"}]),
        ("stats json_values(a) j", [{"a": "1", "b": "x"}], [{"j": '[{"a":"1"}]'}]),
        ("stats histogram(a) h | json_array_len(h) as n | unroll by (h) | unpack_json from h fields (vmrange, hits) | delete h", [{"a": "5"}, {"a": "5"}, {"a": "x"}, {"a": "7"}], [{"vmrange": "4.642e+00...5.275e+00", "hits": "2", "n": "2"}, {"vmrange": "6.813e+00...7.743e+00", "hits": "1", "n": "2"}]),
        ("stats histogram(z) h", [{"a": "2"}], [{"h": "[]"}]),
        ("stats count() if (a:x) n, count() if () m", [{"a": "x"}, {"a": "y"}], [{"n": "1", "m": "2"}]),
        ("stats by (a:10) count() n", [{"a": "5"}, {"a": "-5"}, {"a": "foo"}, {"a": "19"}], [{"a": "0", "n": "1"}, {"a": "-10", "n": "1"}, {"a": "foo", "n": "1"}, {"a": "10", "n": "1"}]),
        ("stats by (a:/24) count() n", [{"a": "1.2.3.4"}, {"a": "1.2.3.9"}, {"a": "q"}], [{"a": "1.2.3.0", "n": "2"}, {"a": "q", "n": "1"}]),
        ("stats by (a:1m) count() n", [{"a": "61s"}, {"a": "1m59s"}], [{"a": "1m", "n": "2"}]),
        ("count() | filter \"count(*)\":>1", [{"a": "1"}, {"a": "2"}], [{"count(*)": "2"}]),
        ("offset 1 | count() n", [{"a": "1"}, {"a": "2"}, {"a": "3"}], [{"n": "2"}]),
        ("join by (a) (b:z | fields a, c) prefix p_", [{"a": "1", "b": "x"}, {"a": "1", "b": "z", "c": "k"}, {"a": "2", "b": "x"}], [{"a": "1", "b": "x", "p_c": "k"}, {"a": "1", "b": "z", "c": "k", "p_c": "k"}, {"a": "2", "b": "x"}]),
        ("join by (a) (b:z | fields a, c) inner", [{"a": "1", "b": "x", "c": "own"}, {"a": "", "b": "x"}, {"b": "z", "c": "k"}], [{"b": "x", "c": "k"}, {"b": "z", "c": "k"}]),
        ("union (a:1 | fields a)", [{"a": "1", "b": "x"}], [{"a": "1", "b": "x"}, {"a": "1"}]),
        ("filter a:in(b:x | fields a)", [{"a": "1", "b": "x"}, {"a": "1"}, {"a": "2"}], [{"a": "1", "b": "x"}, {"a": "1"}]),
        ("filter !a:in(b:x | fields a)", [{"a": "1", "b": "x"}, {"a": "1"}, {"a": "2"}, {"b": "y"}], [{"a": "2"}, {"b": "y"}]),
        ("filter b:y or !a:in(b:x | fields a)", [{"a": "1", "b": "x"}, {"a": "1", "b": "y"}, {"a": "2"}], [{"a": "1", "b": "y"}, {"a": "2"}]),
        ("filter c:contains_all(b:x | fields a)", [{"a": "k1", "b": "x", "c": "k1 k2"}, {"a": "k2", "b": "x", "c": "k1"}], [{"a": "k1", "b": "x", "c": "k1 k2"}]),
        ('format if (a:in(b:x | fields a)) "hit" as h', [{"a": "1", "b": "x"}, {"a": "2"}], [{"a": "1", "b": "x", "h": "hit"}, {"a": "2"}]),
    ],
)
def test_pipes(spark, pipe, before, after):
    for parts in (1, 3):
        assert run(log(spark, before, parts), f"* | {pipe}") == want(*after)


def times(n, step=60):
    import datetime as dt

    return [(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=step * i)).strftime("%Y-%m-%dT%H:%M:%SZ") for i in range(n)]


def test_stream_context(spark):
    rows = [{"_time": t, "_msg": f"m{i}", "app": "a" if i % 2 else "b"} for i, t in enumerate(times(40))]
    e = log(spark, rows, stream=["app"])
    got = [r._msg for r in e.query("m9 or m11 or m31 or m0 | stream_context before 1 after 2").orderBy("app", "_time", F.col("_msg") == "---").collect()]
    assert got == ["m7", "m9", "m11", "m13", "m15", "---", "m29", "m31", "m33", "m35", "m0", "m2", "m4"]
    assert e.query("m9 | stream_context before 5 time_window 3m").count() == 2


def test_streams_and_hits(spark):
    rows = [{"_time": t, "_msg": "x", "app": "a" if i % 3 else 'b"c', "n": str(i)} for i, t in enumerate(times(12, 3600))]
    e = log(spark, rows, stream=["app"])
    assert {(r.value, r.hits) for r in e.streams("*").collect()} == {('{app="a"}', 8), ('{app="b\\"c"}', 4)}
    one = e.stream_ids("{app=a}").collect()
    assert len(one) == 1 and len(one[0].value) == 48
    assert e.query(f"_stream_id:{one[0].value}").count() == 8
    assert e.query('{app=~"b.*"}').count() == 4 and e.query("{app!=a}").count() == 4 and e.query("{app not_in (a)}").count() == 4 and e.query('{none=""}').count() == 12
    assert sum(r.hits for r in e.hits("*", "2h").collect()) == 12
    assert e.hits("*", "1d", fields=["app"]).count() == 2
    assert {r.name for r in e.stream_field_names("*").collect()} == {"app"}
    assert {(r.value, r.hits) for r in e.stream_field_values("*", "app").collect()} == {("a", 8), ('b"c', 4)}
    assert [r.n for r in e.query("*", limit=2).collect()] == ["11", "10"]
    assert e.query("*", start="2024-01-01T03:00:00Z", end="2024-01-01T05:00:00Z").count() == 3
    s = {(r.metric, r.labels["app"]): r.value for r in e.stats("* | stats by (app) count() c, max(n) m").collect()}
    assert s[("c", "a")] == 8
    assert e.stats_range("* | stats by (app) count() c", "6h").count() == 4
    assert {x.line for x in e.json_lines("n:=3 | fields n, app").collect()} == {'{"app":"b\\"c","n":"3"}'}


def test_time_filters(spark):
    e = log(spark, [{"_time": t, "_msg": "x"} for t in times(48, 3600)])
    n = lambda q: e.query(q).count()
    assert n("_time:2024-01-02") == 24 and n("_time:2024-01-01T05") == 1 and n("_time:<2024-01-01T02:00:00Z") == 2
    assert n("_time:day_range[08:00, 10:00)") == 4 and n("_time:day_range[08:00, 10:00) offset 1h") == 4
    assert n("_time:week_range[Mon, Mon]") == 24 and n("_time:week_range(Mon, Wed)") == 24
    assert n("!_time:2024-01-02") == 24 and n("_time:32d") == 48 and n("_time:>30d12h") == 12


def test_rates_use_the_time_filter(spark):
    e = log(spark, [{"_time": t, "_msg": "x"} for t in times(60, 1)])
    assert run(e, "_time:[2024-01-01T00:00:00Z, 2024-01-01T00:01:00Z) | rate() r") == [{"r": "1.0"}]
    assert run(e, "* | stats by (_time:30s) rate() r | fields r") == [{"r": "1.0"}, {"r": "1.0"}]
    assert run(e, "* | rate() r") == [{"r": "60.0"}]


def test_errors_are_raised(spark):
    e = log(spark, [{"a": "1"}])
    for q in ("* | fields a | stream_context before 1", '* | format "<nope:a>" as b', "* | stats by (a:xyz) count()"):
        with pytest.raises(QueryError):
            e.query(q)


def test_extra_map_fields_and_wildcards(spark):
    df = spark.createDataFrame([("m", {"k": "1", "z": "5"}), ("n", {})], "_msg string, extra map<string,string>")
    e = Engine(LogFrame(df, extra="extra"), NOW)
    assert run(e, "k:=1 | fields _msg, z") == [{"_msg": "m", "z": "5"}]


def test_plans(spark):
    """Filters and columns reach the scan; nothing is shuffled for rows; top-k doesn't sort all."""
    from siftflow import catalog

    def plan(name, q):
        return catalog.engine(spark, SF, name).query(q)._jdf.queryExecution().executedPlan().toString()

    p = plan("orders", "o_orderstatus:=F o_totalprice:>1000 _time:1995 | fields o_orderkey")
    assert "EqualTo(o_orderstatus,F)" in p and "GreaterThan(o_totalprice,1000.0)" in p and "GreaterThanOrEqual(o_orderdate" in p and "Exchange" not in p
    assert "o_custkey" not in p.split("ReadSchema")[1]
    assert "TakeOrderedAndProject" in plan("orders", "* | sort by (o_totalprice) limit 3")
    assert plan("events", "* | stats by (event_type) count() n, sum(value) s").count("Exchange hashpartitioning") == 1
    e = catalog.engine(spark, SF, "orders", "customer")
    p = e.query("_table:=orders | fields o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert p.count("Scan parquet") == 1


TOLD = ["1", "a\"b\\c/d", "é\n\t", "", None, "[1]", "null", "<&>\u2028", "{}"]


@pytest.mark.parametrize("call", ["values(a)", "values(a, b)", "values(*)", "json_values(a, b)", "json_values(*)", "json_values(none)"])
def test_unrolled_values_are_not_gathered(spark, call):
    """Row by row what the array of a group's values gives, which is still made beside another function."""
    e = log(spark, [{"g": g, "a": a, "b": b} for g in ("x", "y", None) for a, b in zip(TOLD, reversed(TOLD))])
    query = f"* | stats by (g) {call} v | unroll by (v)"
    plan = e.query(query)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Exchange hashpartitioning" not in plan
    assert run(e, query) == run(e, f"* | stats by (g) {call} v, count() n | unroll by (v) | delete n")
    # where more than the rows of values is asked for, groups are gathered as before
    assert run(e, "* | stats by (g) values(a) if (a:none) v | unroll by (v)") == want({"g": "x"}, {"g": "y"}, {})
    assert run(e, "z:none | stats values(a) v | unroll by (v)") == [{}]
    assert len(run(e, "* | stats by (g) values(a) v, count() n | unroll by (v)")) == 27


def test_unroll_reads_an_array_once(spark):
    e = log(spark, [{"a": json.dumps([str(i) for i in range(50_000)]), "b": "[1]"}])
    df = e.query("* | unroll by (a, b)")
    assert "sequence(" not in df._jdf.queryExecution().executedPlan().toString()  # no lambda that reads the text for each position
    assert df.agg(F.count("*"), F.sum(F.col("a").cast("long")), F.sum(F.col("b").try_cast("long"))).first() == (50_000, 50_000 * 49_999 // 2, 1)


def same_as_sql(spark, at, name, rows):
    """A registered query over made events, and its SQL, which reads them in order."""
    import duckdb

    from siftflow import catalog

    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{at}/events.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet/*.parquet'")
    found = con.execute(catalog.ORACLES[name])
    columns = [x[0] for x in found.description]
    got = sorted(map(tuple, catalog.QUERIES[name](spark, str(at)).select(*columns).collect()))
    assert got and got == sorted(found.fetchall())


def made_events(values):
    import datetime as dt

    return [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i % 7, t, v, f'{{"k": {i}}}') for i, (t, v) in enumerate(values)]


def test_histogram_bounds_of_zeros_as_in_sql(spark, tmp_path):
    """The SQL counts values above zero only, so the query does; histogram() itself has a bucket for zeros, as the reference has."""
    values = [(t, v) for t in ("a", "b") for v in (0.0, None, -1.0, 0.01, 1.0, 1.0, 9.99, 10.0, 560.21)] + [("zeros", 0.0), ("zeros", -0.0)]
    same_as_sql(spark, tmp_path, "stats_histogram_bounds", made_events(values))
    assert run(log(spark, [{"a": "0"}, {"a": "0"}]), "* | stats histogram(a) h") == [{"h": '[{"vmrange":"0...1.000e-09","hits":2}]'}]


def test_rows_of_ties_as_in_sql(spark, tmp_path):
    """Of rows with the same extreme value the first one counts: 9 comes before 10, and before 109."""
    same_as_sql(spark, tmp_path, "stats_rows", made_events([("ab"[i % 2], (0.0, 5.0, None, 7.5)[i // 9 % 4]) for i in range(9, 150)]))


@pytest.mark.parametrize("kind", ["long", "double", "string", "boolean", "timestamp", "date", "decimal(9,2)"])
def test_row_extremes_of_every_type(spark, kind):
    texts = {"boolean": ["true", "false"], "timestamp": ["2024-01-01 00:00:00", "1969-12-31 23:59:59.5"], "date": ["2024-01-01", "1950-01-01"], "string": ["a", "ab", "a10", "a9", "1KB", "7", "-3", "é", "\U0001f600", "z"]}.get(kind, ["-5", "0", "3", "10"])
    texts += {"long": [str(2**63 - 1), str(-(2**63))], "double": ["inf", "-inf", "NaN", "-0.0", "1e-5"]}.get(kind, [])
    df = spark.createDataFrame([(x, i) for i, x in enumerate(texts * 6)] + [(None, -1)], "x string, i long").selectExpr(f"CAST(x AS {kind}) AS x", "i")
    fr = LogFrame.of(df.repartition(3))
    r = Engine(fr, NOW).query("* | stats row_min(x, i) lo, row_max(x, i) hi").first()
    rows = df.select(fr.order("x").alias("k"), "i").where("x IS NOT NULL")
    lowest, highest = (rows.where(F.col("k") == rows.agg(f("k")).first()[0]).agg(F.min("i")).first()[0] if kind != "string" else rows.orderBy(F.col("k").asc() if f is F.min else F.col("k").desc(), "i").first().i for f in (F.min, F.max))
    assert (json.loads(r.lo), json.loads(r.hi)) == ({"i": str(lowest)}, {"i": str(highest)})


def test_entry_and_catalog(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
