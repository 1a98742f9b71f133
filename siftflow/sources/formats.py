"""Readers: each gives rows() of common.py from text or files; accepted() and rejected() then part them.

Readers of lines take any DataFrame with a `value` column, a streaming one too. Readers of bodies take one request or file per
row, which is what such protocols send and what bounds a row's size.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftflow.functions import udfs
from siftflow.sources import protobuf
from siftflow.sources.common import Ingest, rows

def _lines(src: SparkSession | DataFrame, path: str | None) -> DataFrame:
    return src if isinstance(src, DataFrame) else src.read.text(path)


def _bodies(src: SparkSession | DataFrame, path: str | None) -> DataFrame:
    return src if isinstance(src, DataFrame) else src.read.text(path, wholetext=True)


def _files(src: SparkSession | DataFrame, path: str | None) -> DataFrame:
    return src if isinstance(src, DataFrame) else src.read.format("binaryFile").load(path).select(F.col("content").alias("value"))


def _guarded(fn):
    """A body that can't be read is one bad row."""

    def run(x):
        try:
            return fn(x)
        except (ValueError, KeyError, IndexError, TypeError, AttributeError, OSError):
            return [None]

    return run


def _parsed(df: DataFrame, fn) -> DataFrame:
    return udfs.read(df.select("value"), _guarded(fn))


def json_lines(src, path: str | None = None, how: Ingest = Ingest()) -> DataFrame:
    """One object per line; nested objects become dotted fields. Blank lines are skipped."""
    df = _lines(src, path).where(F.trim("value") != "")
    return rows(df.select(udfs.each(udfs.flat_json, udfs.MAP)("value").alias("fields")), how)


def elastic_bulk(src, path: str | None = None, how: Ingest = Ingest()) -> DataFrame:
    """Bodies of alternating command and document lines."""
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    docs = _bodies(src, path).select(F.posexplode(lines).alias("i", "value")).where("i % 2 = 1").select("value")
    return json_lines(docs, None, how.but(time_fields=("@timestamp", "_time"), msg_fields=("message", "_msg")))


def _loki_row(labels: dict, ns, line: str, meta: dict) -> dict:
    out = dict(labels) | dict(meta) | {"_time": str(ns)}
    inner = udfs.flat_json(line) if line.lstrip().startswith("{") else None
    return out | inner if inner is not None else out | {"_msg": line}


def _loki_json(body: str) -> list[dict]:
    out = []
    for s in json.loads(body)["streams"]:
        labels = {k: str(v) for k, v in (s.get("stream") or {}).items()}
        for v in s.get("values") or []:
            out.append(_loki_row(labels, v[0], v[1], udfs.flattened(v[2]) if len(v) > 2 else {}))
    return out


def loki_labels(body: str) -> list[str]:
    return sorted({k for s in json.loads(body).get("streams", []) for k in s.get("stream") or {}})


def loki_json(src, path: str | None = None, how: Ingest = Ingest()) -> DataFrame:
    """{"streams":[{"stream":{..},"values":[[ns, line, {..}], ..]}, ..]}; a line that is a JSON object is parsed."""
    return rows(_parsed(_bodies(src, path), _loki_json), how)


_LABEL = re.compile(r'(\w+)\s*=\s*"((?:[^"\\]|\\.)*)"')


def _loki_proto(body: bytes) -> list[dict]:
    out = []
    for n, stream in protobuf.message(protobuf.unsnappy(body)):
        if n != 1:
            continue
        labels: dict[str, str] = {}
        entries = []
        for k, v in protobuf.message(stream):
            if k == 1:
                labels = {a: b.replace('\\"', '"').replace("\\\\", "\\") for a, b in _LABEL.findall(v.decode())}
            elif k == 2:
                entries.append(v)
        for e in entries:
            ns, line, meta = 0, "", {}
            for k, v in protobuf.message(e):
                if k == 1:
                    t = dict(protobuf.message(v))
                    ns = protobuf.signed(t.get(1, 0)) * 10**9 + t.get(2, 0)
                elif k == 2:
                    line = v.decode()
                elif k == 3:
                    p = dict(protobuf.message(v))
                    meta[p.get(1, b"").decode()] = p.get(2, b"").decode()
            out.append(_loki_row(labels, ns, line, meta))
    return out


def loki_protobuf(src, path: str | None = None, how: Ingest = Ingest()) -> DataFrame:
    """Snappy-compressed push requests, one per file."""
    return rows(_parsed(_files(src, path), _loki_proto), how)


# ---------------------------------------------------------------- OpenTelemetry

SEVERITIES = ["unspecified", *[f"{s}{n or ''}" for s in "trace debug info warn error fatal".split() for n in ("", 2, 3, 4)]]


def _any(b: bytes):
    for n, v in protobuf.message(b):
        if n == 1:
            return v.decode()
        if n == 2:
            return bool(v)
        if n == 3:
            return protobuf.signed(v)
        if n == 4:
            return protobuf.double(v)
        if n == 5:
            return [_any(x) for k, x in protobuf.message(v) if k == 1]
        if n == 6:
            return _attributes([x for k, x in protobuf.message(v) if k == 1])
        if n == 7:
            return v.hex()
    return None


def _attributes(items: list[bytes]) -> dict:
    out = {}
    for b in items:
        kv = dict(protobuf.message(b))
        out[kv.get(1, b"").decode()] = _any(kv.get(2, b""))
    return out


def _otel_row(resource: dict, scope: dict, rec: dict) -> dict:
    out = udfs.flattened(resource) | {f"scope.{k}": v for k, v in udfs.flattened(scope).items()}
    out |= udfs.flattened(rec["attributes"])
    body = rec["body"]
    if isinstance(body, dict):
        out |= udfs.flattened(body)
    elif body is not None:
        out["_msg"] = udfs.json_text(body)
    out["_time"] = str(rec["time"] or rec["observed"] or 0)
    out["severity"] = rec["text"] or (SEVERITIES[rec["number"]] if 0 < rec["number"] < len(SEVERITIES) else SEVERITIES[0])
    for k in ("trace_id", "span_id"):
        if rec[k]:
            out[k] = rec[k]
    return out


def _otel_proto(body: bytes) -> list[dict]:
    out = []
    for n, rl in protobuf.message(body):
        if n != 1:
            continue
        resource, scopes = {}, []
        for k, v in protobuf.message(rl):
            if k == 1:
                resource = _attributes([x for i, x in protobuf.message(v) if i == 1])
            elif k == 2:
                scopes.append(v)
        for s in scopes:
            scope, records = {}, []
            for k, v in protobuf.message(s):
                if k == 1:
                    p = list(protobuf.message(v))
                    scope = {name: x.decode() for i, name in ((1, "name"), (2, "version")) for j, x in p if j == i} | _attributes([x for j, x in p if j == 3])
                elif k == 2:
                    records.append(v)
            for r in records:
                rec = {"time": 0, "observed": 0, "number": 0, "text": "", "body": None, "trace_id": "", "span_id": ""}
                attrs = []
                for k, v in protobuf.message(r):
                    if k in (1, 11):
                        rec["time" if k == 1 else "observed"] = v
                    elif k == 2:
                        rec["number"] = v
                    elif k == 3:
                        rec["text"] = v.decode()
                    elif k == 5:
                        rec["body"] = _any(v)
                    elif k == 6:
                        attrs.append(v)
                    elif k in (9, 10):
                        rec["trace_id" if k == 9 else "span_id"] = v.hex()
                out.append(_otel_row(resource, scope, rec | {"attributes": _attributes(attrs)}))
    return out


def _json_any(v):
    if not isinstance(v, dict):
        return None
    for k, x in v.items():
        if k == "intValue":
            return int(x)
        if k == "arrayValue":
            return [_json_any(i) for i in x.get("values", [])]
        if k == "kvlistValue":
            return {i["key"]: _json_any(i.get("value")) for i in x.get("values", [])}
        return x
    return None


def _otel_json(body: str) -> list[dict]:
    out = []
    attributes = lambda items: {i["key"]: _json_any(i.get("value")) for i in items or []}
    for rl in json.loads(body)["resourceLogs"]:
        resource = attributes((rl.get("resource") or {}).get("attributes"))
        for s in rl.get("scopeLogs") or []:
            sc = s.get("scope") or {}
            scope = {k: sc[k] for k in ("name", "version") if sc.get(k)} | attributes(sc.get("attributes"))
            for r in s.get("logRecords") or []:
                rec = {"time": int(r.get("timeUnixNano") or 0), "observed": int(r.get("observedTimeUnixNano") or 0), "number": int(r.get("severityNumber") or 0), "text": r.get("severityText") or "", "body": _json_any(r.get("body")), "trace_id": r.get("traceId") or "", "span_id": r.get("spanId") or "", "attributes": attributes(r.get("attributes"))}
                out.append(_otel_row(resource, scope, rec))
    return out


def otel_protobuf(src, path: str | None = None, how: Ingest = Ingest()) -> DataFrame:
    """Export requests, one per file; resource attributes tell streams apart."""
    return rows(_parsed(_files(src, path), _otel_proto), how)


def otel_json(src, path: str | None = None, how: Ingest = Ingest()) -> DataFrame:
    return rows(_parsed(_bodies(src, path), _otel_json), how)


# ---------------------------------------------------------------- syslog, journald, datadog, native


def syslog(src, path: str | None = None, how: Ingest = Ingest(), year: int | None = None, offset_us: int = 0) -> DataFrame:
    """Lines of RFC 3164 or RFC 5424; batch files, or a stream of lines from a socket."""
    import time

    y = year or time.gmtime().tm_year
    df = _lines(src, path).where(F.trim("value") != "")
    how = how.but(time_fields=("timestamp",), msg_fields=("message",), stream_fields=("hostname", "app_name", "proc_id"))
    return rows(df.select(udfs.each(lambda x: udfs.syslog(x, y, offset_us), udfs.MAP)("value").alias("fields")), how)


def _journal(body: bytes) -> list[dict]:
    out, now, i = [], {}, 0
    while i <= len(body):
        end = body.find(b"\n", i)
        line = body[i:] if end < 0 else body[i:end]
        nxt = len(body) + 1 if end < 0 else end + 1
        if not line:
            if now:
                out.append(now)
            now = {}
        elif b"=" in line:
            k, _, v = line.partition(b"=")
            now[k.decode()] = v.decode(errors="replace")
        else:  # a name, then eight bytes of length, the value and a line feed
            n = int.from_bytes(body[nxt : nxt + 8], "little")
            if nxt + 8 + n > len(body):
                raise ValueError("a value is cut off")
            now[line.decode()] = body[nxt + 8 : nxt + 8 + n].decode(errors="replace")
            nxt += 8 + n + 1
        i = nxt
    if now:
        out.append(now)
    for r in out:
        if "PRIORITY" in r and r["PRIORITY"].isdigit() and int(r["PRIORITY"]) < 8:
            r["level"] = udfs.LEVELS[int(r["PRIORITY"])]
        if "__REALTIME_TIMESTAMP" in r:
            r["_time"] = r["__REALTIME_TIMESTAMP"]
        for k in [k for k in r if k.startswith("__")]:
            del r[k]
    return out


def journald(src, path: str | None = None, how: Ingest = Ingest()) -> DataFrame:
    """The export format, one upload per file; __* fields are dropped, times are micros."""
    how = how.but(msg_fields=("MESSAGE",), stream_fields=("_MACHINE_ID", "_HOSTNAME", "_SYSTEMD_UNIT"))
    return rows(_parsed(_files(src, path), _journal), how)


def _datadog(body: str) -> list[dict]:
    v = json.loads(body)
    out = []
    for r in v if isinstance(v, list) else [v]:
        flat = udfs.flattened(r)
        for tag in flat.pop("ddtags", "").split(","):
            k, _, x = tag.partition(":")
            if k.strip():
                flat[k.strip()] = x.strip() or "no_label_value"
        if "message" in flat:
            inner = udfs.flat_json(flat["message"]) if flat["message"].lstrip().startswith("{") else None
            flat.pop("message") if inner else None
            flat |= inner or {}
        if "timestamp" in flat:
            flat["_time"] = flat.pop("timestamp")
        out.append(flat)
    return out


def datadog(src, path: str | None = None, how: Ingest = Ingest()) -> DataFrame:
    """Arrays of messages, one request per row; ddtags become fields."""
    return rows(_parsed(_bodies(src, path), _datadog), how.but(msg_fields=("message", "_msg")))


def native(spark: SparkSession, path: str, how: Ingest = Ingest()) -> DataFrame:
    """Parquet whose columns are fields; typed values become text."""
    from siftflow.functions.values import as_str

    df = spark.read.parquet(path)
    pairs = [x for f in df.schema.fields for x in (F.lit(f.name), as_str(F.col(f"`{f.name}`"), f.dataType))]
    return rows(df.select(F.create_map(*pairs).alias("fields")), how)
