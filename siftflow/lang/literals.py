"""Numbers, durations, sizes and times as they are written in queries."""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta, timezone

from siftflow.lang.lexer import QueryError

UNIT_NS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9, "y": 365 * 86400 * 10**9}
UNIT_BYTES = {"b": 1}
for _i, _c in enumerate("kmgtp", 1):
    UNIT_BYTES |= {_c: 1000**_i, _c + "b": 1000**_i, _c + "i": 1024**_i, _c + "ib": 1024**_i}
_DURATION = re.compile(r"(\d+(?:\.\d+)?)(ns|us|µs|μs|ms|s|m|h|d|w|y)")
_BYTES = re.compile(r"(\d+(?:\.\d+)?)([kmgtp]i?b?|b)", re.I)
_NUMBER = re.compile(r"[+-]?(\d[\d_]*\.?[\d_]*|\.\d+)(e[+-]?\d+)?$", re.I)
_IP = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$")


def _units(text: str, part: re.Pattern, units: dict[str, int], fold: bool) -> float | None:
    sign, rest = (-1, text[1:]) if text.startswith("-") else (1, text)
    at, total = 0, 0.0
    while at < len(rest):
        if not (m := part.match(rest, at)):
            return None
        total += float(m[1]) * units[m[2].lower() if fold else m[2]]
        at = m.end()
    return sign * total if rest else None


def duration_ns(text: str) -> float | None:
    return _units(text, _DURATION, UNIT_NS, False)


def duration_us(text: str) -> int:
    ns = duration_ns(text)
    if ns is None:
        raise QueryError(f"{text!r} isn't a duration")
    return int(ns // 1000)


def size_bytes(text: str) -> float | None:
    return _units(text, _BYTES, UNIT_BYTES, True)


def ipv4(text: str) -> int | None:
    m = _IP.match(text)
    if not m or any(int(x) > 255 for x in m.groups()):
        return None
    return sum(int(x) << s for x, s in zip(m.groups(), (24, 16, 8, 0)))


def plain_number(text: str) -> float | None:
    low = text.lower()
    if low in ("inf", "+inf", "-inf", "nan"):
        return float(low)
    if m := re.match(r"([+-]?)0(x[0-9a-f]+|b[01]+|o[0-7]+)$", low):
        return float(int(m[1] + "0" + m[2], 0))
    return float(text.replace("_", "")) if _NUMBER.match(text) else None


def number(text: str) -> float | None:
    """A number with or without units, a timestamp in nanoseconds, or an address; None if it is none of them."""
    for f in (plain_number, duration_ns, size_bytes):
        if (x := f(text)) is not None:
            return x
    if (t := instant_us(text)) is not None:
        return t * 1000.0
    x = ipv4(text)
    return None if x is None else float(x)


def count(text: str) -> int:
    x = number(text)
    if x is None or x < 0 or math.isnan(x):
        raise QueryError(f"{text!r} isn't a number of rows")
    return (1 << 62) if math.isinf(x) else int(x)


_TIME = re.compile(r"(\d{4})(?:-(\d{2})(?:-(\d{2})(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?)?)?)?)?(Z|[+-]\d{2}:\d{2})?$")
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def micros(t: datetime) -> int:
    return (t - EPOCH) // timedelta(microseconds=1)


def time_span(text: str) -> tuple[int, int] | None:
    """From the start up to but without the end of what the text names, in micros: 2024 is a year, 2024-05 a month, ... ."""
    m = _TIME.match(text)
    if not m:
        return None
    y, mo, d, h, mi, s, frac, zone = m.groups()
    try:
        t = datetime(int(y), int(mo or 1), int(d or 1), int(h or 0), int(mi or 0), int(s or 0), tzinfo=timezone.utc)
    except ValueError:
        return None
    low = micros(t)
    if frac:
        low += int(frac[:6].ljust(6, "0"))
        high = low + 10 ** max(0, 6 - len(frac))
    elif s:
        high = low + 10**6
    elif mi:
        high = low + 60 * 10**6
    elif h:
        high = low + 3600 * 10**6
    elif d:
        high = low + 86400 * 10**6
    elif mo:
        high = micros(t.replace(year=t.year + t.month // 12, month=t.month % 12 + 1))
    else:
        high = micros(t.replace(year=t.year + 1))
    if zone and zone != "Z":
        shift = (int(zone[1:3]) * 60 + int(zone[4:6])) * 60 * 10**6 * (1 if zone[0] == "+" else -1)
        low, high = low - shift, high - shift
    return low, high


def instant_us(text: str) -> int | None:
    if len(text) < 10 or not (s := time_span(text)):
        return None
    return s[0]


def unix_us(text: str) -> int | None:
    """A unix time whose size tells its unit: seconds below 1e11, then millis below 1e14, micros below 1e17, nanos."""
    if not re.match(r"-?\d+(\.\d+)?$", text):
        return None
    x = float(text)
    a = abs(x)
    if a < 1e11:
        return round(x * 1e6)
    if a < 1e14:
        return round(x * 1e3)
    return round(x) if a < 1e17 else round(x / 1e3)
