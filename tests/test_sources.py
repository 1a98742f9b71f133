"""Readers, the store and streams."""

import datetime as dt
import json
import struct

import pytest
from pyspark.sql import functions as F

from siftflow.engine import Engine
from siftflow.frame import LogFrame
from siftflow.lang.lexer import QueryError
from siftflow.sources import common, formats, protobuf, store
from siftflow.sources.common import Ingest
from siftflow.streaming import tail

NOW = "2024-02-01T00:00:00Z"


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def bodies(spark, *values):
    return spark.createDataFrame([(bytearray(v),) for v in values], "value binary")


def got(df):
    return sorted(({"_time": r._time.isoformat(), "_msg": r._msg, "_stream": r._stream, **r.fields} for r in common.accepted(df).collect()), key=str)


def test_json_lines(spark):
    how = Ingest(time_fields=("ts",), msg_fields=("m", "_msg"), stream_fields=("host.name", "none"), ignore_fields=("x*",), decolorize_fields=("_msg",), extra_fields=(("dc", "eu"),), now=NOW)
    df = formats.json_lines(
        lines(spark, '{"ts":"2024-01-02T03:04:05.5Z","_msg":"\\u001b[1mhi","host":{"name":"h1","os":{"v":1.50}},"tags":["a",1],"ok":true,"nil":null,"e":"","x1":"q"}', "", "bad", '{"ts":1704164645,"m":"two","_msg":"one"}', '{"ts":0}', '{"ts":"never","_msg":"z"}', "[1]"),
        how=how,
    )
    assert got(df) == sorted([
        {"_time": "2024-01-02T03:04:05.500000", "_msg": "hi", "_stream": '{host.name="h1"}', "host.name": "h1", "host.os.v": "1.50", "tags": '["a",1]', "ok": "true", "dc": "eu"},
        {"_time": "2024-01-02T03:04:05", "_msg": "two", "_stream": "{}", "dc": "eu"},
        {"_time": "2024-02-01T00:00:00", "_msg": None, "_stream": "{}", "dc": "eu"},
    ], key=str)
    assert common.rejected(df).count() == 3
    assert common.accepted(df, past_days=7, now=NOW).count() == 1
    e = Engine(common.log(common.accepted(df)), NOW)
    assert e.query("hi host.name:=h1 | fields tags").collect()[0].tags == '["a",1]'
    assert e.query("* | stats by (host.name) count() n").count() == 2


@pytest.mark.parametrize("raw,us", [("1704164645", 1704164645000000), ("1704164645.25", 1704164645250000), ("1704164645123", 1704164645123000), ("1704164645123456", 1704164645123456), ("1704164645123456789", 1704164645123456), ("2024-01-02", 1704153600000000), ("2024-01-02T03:04:05+01:00", 1704161045000000), ("2024-01-02 03:04:05Z", 1704164645000000), ("-", 1706745600000000), ("foo", None)])
def test_times(spark, raw, us):
    t = spark.createDataFrame([(raw,)], "t string").select(F.unix_micros(common.event_time(F.col("t"), NOW))).first()[0]
    assert t == us


def test_elastic_bulk(spark):
    body = '{"create":{"_index":"a"}}\n{"@timestamp":"2024-01-02","message":"one"}\n\n{"index":{}}\n{"@timestamp":"1704164645123","message":"two","a":{"b":1}}\n'
    rows = got(formats.elastic_bulk(lines(spark, body)))
    assert [(r["_msg"], r.get("a.b")) for r in rows] == [("one", None), ("two", "1")]


def test_loki(spark):
    body = json.dumps({"streams": [{"stream": {"app": "x"}, "values": [["1704164645123456789", "hello"], ["1704164645123456789", '{"_msg":"in","k":"v"}', {"trace": "t1"}]]}]})
    rows = got(formats.loki_json(lines(spark, body, "bad"), how=Ingest(stream_fields=("app",))))
    assert [(r["_msg"], r.get("k"), r.get("trace"), r["_stream"]) for r in rows] == [("hello", None, None, '{app="x"}'), ("in", "v", "t1", '{app="x"}')]


def _f(n, v):
    out = lambda x: bytes([x & 127 | 128]) + out(x >> 7) if x > 127 else bytes([x])
    if isinstance(v, int):
        return out(n << 3) + out(v)
    v = v.encode() if isinstance(v, str) else v
    return out(n << 3 | 2) + out(len(v)) + v


def test_loki_protobuf(spark):
    import pyarrow as pa

    entry = _f(1, _f(1, 1704164645) + _f(2, 5000)) + _f(2, "hello") + _f(3, _f(1, "trace") + _f(2, "t1"))
    push = _f(1, _f(1, '{app="x", q="a\\"b"}') + _f(2, entry))
    packed = pa.Codec("snappy").compress(push).to_pybytes()
    rows = got(formats.loki_protobuf(bodies(spark, packed, b"bad"), how=Ingest(stream_fields=("app",))))
    assert rows == [{"_time": "2024-01-02T03:04:05.000005", "_msg": "hello", "_stream": '{app="x"}', "app": "x", "q": 'a"b', "trace": "t1"}]


def test_otel(spark):
    attr = lambda k, v: _f(1, k) + _f(2, v)
    rec = b"\x09" + (1704164645 * 10**9).to_bytes(8, "little") + _f(2, 9) + _f(5, _f(1, "hello")) + _f(6, attr("n", _f(3, 7))) + _f(6, attr("d", b"\x21" + struct.pack("<d", 1.5))) + _f(6, attr("m", _f(6, _f(1, attr("x", _f(1, "y")))))) + _f(9, b"\x01\x02") + _f(10, b"\x03")
    req = _f(1, _f(1, _f(1, attr("service.name", _f(1, "svc")))) + _f(2, _f(1, _f(1, "lib")) + _f(2, rec)))
    how = Ingest(stream_fields=("service.name",))
    want = [{"_time": "2024-01-02T03:04:05", "_msg": "hello", "_stream": '{service.name="svc"}', "service.name": "svc", "scope.name": "lib", "n": "7", "d": "1.5", "m.x": "y", "severity": "info", "trace_id": "0102", "span_id": "03"}]
    assert got(formats.otel_protobuf(bodies(spark, req, b"\xff"), how=how)) == want
    body = {"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}, "scopeLogs": [{"scope": {"name": "lib"}, "logRecords": [{"timeUnixNano": "1704164645000000000", "severityNumber": 9, "body": {"stringValue": "hello"}, "traceId": "0102", "spanId": "03", "attributes": [{"key": "n", "value": {"intValue": "7"}}, {"key": "d", "value": {"doubleValue": 1.5}}, {"key": "m", "value": {"kvlistValue": {"values": [{"key": "x", "value": {"stringValue": "y"}}]}}}]}]}]}]}
    assert got(formats.otel_json(lines(spark, json.dumps(body)), how=how)) == want


def test_syslog(spark):
    rows = got(formats.syslog(lines(spark, "<165>1 2021-02-03T04:05:06.7Z box tool 99 - - hi there", "<13>Jan  2 03:04:05 h2 cron[7]: job", ""), year=2024))
    assert [(r["_time"], r["_msg"], r["_stream"]) for r in rows] == [("2021-02-03T04:05:06.700000", "hi there", '{app_name="tool",hostname="box",proc_id="99"}'), ("2024-01-02T03:04:05", "job", '{app_name="cron",hostname="h2",proc_id="7"}')]


def test_journald(spark):
    text = b"two\nlines"
    body = b"__REALTIME_TIMESTAMP=1704164645000001\n__CURSOR=x\nPRIORITY=3\n_HOSTNAME=h\nMESSAGE\n" + len(text).to_bytes(8, "little") + text + b"\nA=b\n\n__REALTIME_TIMESTAMP=1704164646000000\nMESSAGE=next\n"
    rows = got(formats.journald(bodies(spark, body)))
    assert [(r["_time"], r["_msg"], r["_stream"], r.get("level"), r.get("__CURSOR")) for r in rows] == [("2024-01-02T03:04:05.000001", "two\nlines", '{_HOSTNAME="h"}', "error", None), ("2024-01-02T03:04:06", "next", "{}", None, None)]


def test_datadog(spark):
    body = json.dumps([{"message": "m", "ddtags": "env:prod,x", "ddsource": "s", "timestamp": 1704164645123}, {"message": '{"a":1}'}])
    rows = got(formats.datadog(lines(spark, body), how=Ingest(now=NOW)))
    assert [(r["_msg"], r.get("env"), r.get("x"), r.get("a"), r["_time"]) for r in rows] == [("m", "prod", "no_label_value", None, "2024-01-02T03:04:05.123000"), (None, None, None, "1", "2024-02-01T00:00:00")]


def test_varints():
    assert protobuf.varint(b"\xac\x02", 0) == (300, 2) and list(protobuf.message(_f(3, 300) + _f(4, "x"))) == [(3, 300), (4, b"x")]


def test_store(spark, tmp_path):
    path = str(tmp_path / "log")
    made = [json.dumps({"_time": f"2024-01-{d:02}T0{h}:00:00Z", "_msg": f"m{d}", "app": f"a{h % 2}"}) for d in range(1, 6) for h in range(4)]
    df = common.accepted(formats.json_lines(lines(spark, *made), how=Ingest(stream_fields=("app",))))
    store.append(df, path)
    e = Engine(store.read(spark, path), NOW)
    q = e.query("_time:2024-01-03 app:=a1")
    assert q.count() == 2
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_day" in plan
    assert len(q.inputFiles()) < len(e.frame.df.inputFiles()) or "_day" in plan
    assert e.query('{app="a1"} _time:2024-01-03').count() == 2 and e.query('{app!~"a.*"}').count() == 0 and e.query("{none=''}").count() == 20
    assert [(r.name, r.hits) for r in e.stream_field_names("*").collect()] == [("app", 20)]
    assert {(r.value, r.hits) for r in e.stream_field_values("_time:2024-01-01", "app").collect()} == {("a0", 2), ("a1", 2)}
    assert e.query("m3 {app=a0} | stream_context before 1 time_window 2d").where("_msg != '---'").count() == 3
    store.compact(spark, path, dt.date(2024, 1, 2), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 4
    assert store.retain(spark, path, dt.date(2024, 1, 5), days=2) == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    assert store.retain(spark, path, dt.date(2024, 1, 5), max_bytes=1) == [dt.date(2024, 1, 3)]
    assert store.read(spark, path).df.count() == 8


def test_native_and_generated(spark, tmp_path):
    g = store.generated(spark, 50)
    g.write.parquet(str(tmp_path / "g"))
    rows = formats.native(spark, str(tmp_path / "g"), Ingest(stream_fields=("host",)))
    e = Engine(common.log(common.accepted(rows)), NOW)
    assert e.query("* | stats count() n, count_uniq(_stream) s").collect()[0].n == 50
    assert e.query("u8_0:>=0 ip_0:ipv4_range(0.0.0.0/0) json_0:foo").count() == 50


def stream_of(spark, path, df):
    df.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_tail(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, 0, s), f"{'error' if s % 2 else 'ok'} n={s}", "a") for s in range(10)]
    df = spark.createDataFrame(rows, "_time timestamp, _msg string, app string").coalesce(1)
    e = Engine(LogFrame(stream_of(spark, str(tmp_path / "s"), df), ("app",)), NOW)
    out = drained(e.tail('error | extract "n=<n>" | math n * 2 as m | fields n, m'), "tail_rows")
    assert sorted((r.n, r.m) for r in out.collect()) == [(str(s), 2.0 * s) for s in (1, 3, 5, 7, 9)]
    for bad in ("* | count()", "* | sort by (_time)", "* | limit 3"):
        with pytest.raises(QueryError):
            e.tail(bad)


def test_late_rows_are_dropped(spark, tmp_path):
    path = str(tmp_path / "late")
    make = lambda *s: spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, x), f"m{x}", "a" if x < 50 else "b") for x in s], "_time timestamp, _msg string, app string").coalesce(1)
    import time

    df = stream_of(spark, path, make(5, 3))
    time.sleep(1.1)
    make(4, 6, 50).write.mode("append").parquet(path)
    e = Engine(LogFrame(df, ("app",)), NOW)
    out = drained(e.tail("* | fields _msg", drop_late=True), "tail_late")
    assert sorted(r._msg for r in out.collect()) == ["m3", "m5", "m50", "m6"]


def test_windows(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), "x", "a" if m % 2 else "b") for m in range(30)] + [(dt.datetime(2024, 1, 1, 5, 0), "end", "a")]
    df = spark.createDataFrame(rows, "_time timestamp, _msg string, app string").coalesce(1)
    fr = LogFrame(stream_of(spark, str(tmp_path / "w"), df), ("app",))
    out = drained(tail.windowed_stats(fr, "10 minutes", [F.count("*").alias("n")], ["app"], watermark="1 minute"), "windows")
    assert {(r._time.minute, r.app, r.n) for r in out.collect()} == {(m, a, 5) for m in (0, 10, 20) for a in "ab"}
    twice = df.unionByName(df)
    fr = LogFrame(stream_of(spark, str(tmp_path / "d"), twice.coalesce(1)), ("app",))
    assert drained(tail.deduplicated(fr, ["_time", "app"]).df, "dedup").count() == 31
    s = drained(tail.session_stats(LogFrame(stream_of(spark, str(tmp_path / "e"), df), ("app",)), "5 minutes", [F.count("*").alias("n")], watermark="1 minute"), "sessions")
    assert [r.n for r in s.collect()] == [30]


def test_replicate(spark, tmp_path):
    df = stream_of(spark, str(tmp_path / "r"), spark.createDataFrame([("x",)], "_msg string"))
    outs = [str(tmp_path / f"sink{i}") for i in range(2)]
    sinks = [lambda d, epoch, o=o: d.write.mode("append").parquet(o) for o in outs]
    store.replicate(df, sinks, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert [spark.read.parquet(o).count() for o in outs] == [1, 1]


def test_bodies_go_back_in_small_batches():
    """A batch of many bodies of many rows never is in Python as a whole."""
    import pyarrow as pa

    from siftflow.functions import udfs

    class Frame:
        @staticmethod
        def mapInArrow(run, schema):
            return run

    held, most = 0, 0

    class Row(dict):
        def __init__(self, n):
            nonlocal held, most
            super().__init__(a=str(n), b="x")
            held += 1
            most = max(most, held)

        def __del__(self):
            nonlocal held
            held -= 1

    bodies = lambda n, fn: udfs.read(Frame, fn)(iter([pa.RecordBatch.from_pydict({"value": pa.array([str(i) for i in range(n)] + [None])})]))
    found = list(bodies(500, lambda x: [Row(int(x) * 100 + i) for i in range(100)] if x != "7" else [None]))
    maps = [m for b in found for m in b.column(0).to_pylist()]
    assert [m and dict(m) for m in maps] == [m for i in range(500) for m in ([{"a": str(i * 100 + j), "b": "x"} for j in range(100)] if i != 7 else [None])]
    assert max(b.num_rows for b in found) == udfs.AT_ONCE and most <= 200
    assert [b.column(0).to_pylist() for b in bodies(2, lambda x: [{}] if x == "0" else [])] == [[[]]]


@pytest.mark.parametrize("make", [formats.loki_json, formats.loki_protobuf, formats.otel_json, formats.otel_protobuf, formats.journald, formats.datadog])
def test_readers_of_bodies_hold_no_arrays_of_rows(spark, make):
    kind = "binary" if make in (formats.loki_protobuf, formats.otel_protobuf, formats.journald) else "string"
    plan = make(spark.range(1).selectExpr(f"CAST('x' AS {kind}) AS value"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "explode" not in plan.lower() and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("name", ["source_json_lines", "source_loki_protobuf", "source_otel_protobuf", "source_journald", "store_compaction", "stream_tail_resumed", "stream_sessions", "stream_windows"])
def test_registered_queries(spark, name):
    import duckdb

    from siftflow import catalog, catalog_ingest  # noqa: F401

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet'")
    want = con.execute(catalog.ORACLES[name])
    names = [x[0] for x in want.description]
    plain = lambda rows: sorted((tuple(x.replace(tzinfo=None) if isinstance(x, dt.datetime) else x for x in r) for r in rows), key=str)
    rows = plain(catalog.QUERIES[name](spark, at).select(*names).collect())
    assert rows and rows == plain(want.fetchall())


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from siftflow import tables

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        conf = {}
        sparkContext = Context

    with pytest.raises(ValueError, match="share"):
        tables.shared_dir(Session)
