"""Arrow UDFs for what no built-in function expresses. They see batches, never rows one by one through the JVM."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAP = T.MapType(T.StringType(), T.StringType())


def each(fn: Callable, kind) -> Callable[..., Column]:
    """fn applied to every value of a batch; null gives null."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fn(x) for x in s], dtype=object)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


#: Maps per batch that goes back to the JVM.
AT_ONCE = 1000


def read(df: DataFrame, fn: Callable) -> DataFrame:
    """`fields`: the maps that fn gives for each value of df's only column, null for what can't be read; a null value gives none.

    However many maps a batch of values gives, a task holds those of one value and AT_ONCE more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, items = [], [], []  # where each map begins, or None

        def batch() -> pa.RecordBatch:
            text = pa.array(items, pa.string())
            maps = pa.MapArray.from_arrays(pa.array([*at, len(keys)], pa.int32()), pa.array(keys, pa.string()), text)
            return pa.RecordBatch.from_arrays([maps], ["fields"])

        for b in batches:
            for x in b.column(0):
                for m in fn(x.as_py()) if x.is_valid else ():
                    at.append(None if m is None else len(keys))
                    if m:
                        keys += m.keys()
                        items += m.values()
                    if len(at) >= AT_ONCE:
                        yield batch()
                        at, keys, items = [], [], []
        if at:
            yield batch()

    return df.mapInArrow(run, T.StructType([T.StructField("fields", MAP)]))


# ---------------------------------------------------------------- JSON


def json_text(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    return json.dumps(v, separators=(",", ":"), ensure_ascii=False)


class _Raw(float):
    """A number that keeps its text."""

    def __new__(cls, s):
        x = super().__new__(cls, s)
        x.text = s
        return x


def _loads(text: str):
    return json.loads(text, parse_float=_Raw, parse_int=_Raw)


def _plain(v) -> str | None:
    if isinstance(v, _Raw):
        return v.text
    if isinstance(v, list):
        return "[" + ",".join(json.dumps(x, ensure_ascii=False) if isinstance(x, str) else "null" if x is None else _object(x) if isinstance(x, dict) else _plain(x) for x in v) + "]"
    return json_text(v)


def _object(v: dict) -> str:
    return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + (json.dumps(x, ensure_ascii=False) if isinstance(x, str) else "null" if x is None else _object(x) if isinstance(x, dict) else _plain(x)) for k, x in v.items()) + "}"


def flattened(v: dict, prefix: str = "", out: dict | None = None) -> dict[str, str]:
    """Nested objects as dotted names; nulls are left out; arrays, numbers and booleans become text."""
    out = {} if out is None else out
    for k, x in v.items():
        if isinstance(x, dict):
            flattened(x, prefix + k + ".", out)
        elif x is not None:
            out[prefix + k] = _plain(x)
    return out


def flat_json(text: str) -> dict[str, str] | None:
    """The fields of a JSON object; null for other text."""
    if not text.lstrip().startswith("{"):
        return None
    try:
        v = _loads(text)
    except ValueError:
        return None
    return {k or "_msg": x for k, x in flattened(v).items()} if isinstance(v, dict) else None


# ---------------------------------------------------------------- logfmt

_LOGFMT = re.compile(r'([^\s="]+)(?:=("(?:[^"\\]|\\.)*"|\S*))?')


def unquoted(v: str) -> str:
    if len(v) > 1 and v[0] == v[-1] == '"':
        try:
            return json.loads(v)
        except ValueError:
            return v[1:-1]
    if len(v) > 1 and v[0] == v[-1] == "`":
        return v[1:-1]
    return v


def logfmt(text: str) -> dict[str, str]:
    return {m[1]: unquoted(m[2] or "") for m in _LOGFMT.finditer(text)}


# ---------------------------------------------------------------- syslog

_PRI = re.compile(r"<(\d{1,3})>")
_5424 = re.compile(r"1 (\S+) (\S+) (\S+) (\S+) (\S+) ")
_3164 = re.compile(r"([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d|\d{4}-\d\d-\d\dT\S+) (\S+) ")
_TAG = re.compile(r"([^\s\[:]+)(?:\[([^\]]*)\])?:\s?")
_SD = re.compile(r'\[([^\s\]"]+)((?: [^\s="\]]+="(?:[^"\\]|\\.)*")*)\]')
_PARAM = re.compile(r' ([^\s="\]]+)="((?:[^"\\]|\\.)*)"')
FACILITIES = "kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp security console solaris-cron local0 local1 local2 local3 local4 local5 local6 local7".split()
LEVELS = "emerg alert critical error warning notice info debug".split()


def syslog(text: str, year: int = 1970, offset_us: int = 0) -> dict[str, str]:
    """Fields of an RFC 3164 or RFC 5424 line. RFC 3164 has no year: the given one is taken; offset_us is its zone's."""
    from datetime import datetime, timedelta

    out: dict[str, str] = {}
    if not text:
        return out
    m = _PRI.match(text)
    if m:
        pri = int(m[1])
        out |= {"priority": m[1], "facility": str(pri // 8), "severity": str(pri % 8), "level": LEVELS[pri % 8]}
        if pri // 8 < len(FACILITIES):
            out["facility_keyword"] = FACILITIES[pri // 8]
        text = text[m.end() :]
    if m := _5424.match(text):
        out["format"] = "rfc5424"
        for k, v in zip(("timestamp", "hostname", "app_name", "proc_id", "msg_id"), m.groups()):
            if v != "-":
                out[k] = v
        rest = text[m.end() :]
        if rest.startswith("-"):
            rest = rest[1:]
        while s := _SD.match(rest):
            for p in _PARAM.finditer(s[2]):
                out[f"{s[1]}.{p[1]}"] = re.sub(r'\\(["\\\]])', r"\1", p[2])
            if not s[2]:
                out[s[1]] = ""
            rest = rest[s.end() :]
        out["message"] = rest[1:] if rest.startswith(" ") else rest
        return out
    out["format"] = "rfc3164"
    if m := _3164.match(text):
        stamp = m[1]
        if stamp[0].isdigit():
            out["timestamp"] = stamp
        else:
            try:
                t = datetime.strptime(f"{year} {stamp}", "%Y %b %d %H:%M:%S") - timedelta(microseconds=offset_us)
                out["timestamp"] = t.strftime("%Y-%m-%dT%H:%M:%S.000Z")
            except ValueError:
                out["message"] = text
                return out
        out["hostname"] = m[2]
        text = text[m.end() :]
    if m := _TAG.match(text):
        out["app_name"] = m[1]
        if m[2] is not None:
            out["proc_id"] = m[2]
        text = text[m.end() :]
    out["message"] = text
    return out


# ---------------------------------------------------------------- patterns


def pattern_steps(pattern: str) -> list[tuple[str, str, str]]:
    """(literal before, field, option) of a<x>b<opt:y>c; a last literal has an empty field."""
    parts = re.split(r"<([^<>]*)>", pattern)
    out = []
    for i in range(0, len(parts), 2):
        f = parts[i + 1] if i + 1 < len(parts) else ""
        opt, _, f2 = f.rpartition(":") if ":" in f else ("", "", f)
        out.append((html.unescape(parts[i]), f2.strip() or ("_" if i + 1 < len(parts) else ""), opt.strip()))
    return out


def extracted(text: str, steps: list[tuple[str, str, str]]) -> dict[str, str]:
    """The first literal is looked for anywhere, each later one after the value before it; fields after a miss are empty."""
    out = {f: "" for _, f, _ in steps if f and f != "_"}
    at = text.find(steps[0][0])
    if at < 0:
        return out
    rest = text[at + len(steps[0][0]) :]
    for i, (_, f, opt) in enumerate(steps):
        if not f:
            break
        after = steps[i + 1][0] if i + 1 < len(steps) else ""
        value, used = None, 0
        if opt != "plain" and rest[:1] in ('"', "`"):
            m = re.match(r'"(?:[^"\\]|\\.)*"|`[^`]*`', rest)
            if m:
                value, used = unquoted(m[0]), m.end()
                if after and not rest.startswith(after, used):  # the value counts, what follows doesn't
                    if f != "_":
                        out[f] = value
                    return out
        if value is None:
            used = rest.find(after) if after else len(rest)
            if used < 0:
                return out
            value = rest[:used]
        if f != "_":
            out[f] = value
        rest = rest[used + len(after) :]
    return out


def hash53(text: str) -> int:
    return xxhash.xxh64_intdigest(text) & ((1 << 53) - 1)


def unhexed(text: str) -> str:
    try:
        return bytes.fromhex(text).decode()
    except ValueError:
        return text


def unbased(text: str) -> str:
    import base64

    try:
        return base64.b64decode(text, validate=True).decode()
    except ValueError:
        return text


def unurled(text: str) -> str:
    from urllib.parse import unquote_plus

    return text if re.search(r"%(?![0-9a-fA-F]{2})", text) else unquote_plus(text, errors="strict") if _utf8(text) else text


def _utf8(text: str) -> bool:
    from urllib.parse import unquote_to_bytes

    try:
        unquote_to_bytes(text).decode()
    except UnicodeDecodeError:
        return False
    return True


def replace_first(pattern: str, new: str, limit: int) -> Callable[[str], str]:
    p = re.compile(re.sub(r"\(\?<([A-Za-z_])", r"(?P<\1", pattern))
    to = re.sub(r"\$\{(\w+)\}|\$(\d+)", lambda m: rf"\g<{m[1] or m[2]}>", new.replace("\\", "\\\\"))
    return lambda s: p.sub(to, s, count=limit)
