"""A reader of the protobuf wire format, enough for log messages."""

from __future__ import annotations

import struct
from collections.abc import Iterator


def varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[i]
        n |= (c & 127) << shift
        i += 1
        if c < 128:
            return n, i
        shift += 7


def message(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field: a number, or the bytes of a string or a message."""
    i = 0
    while i < len(b):
        tag, i = varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = varint(b, i)
        elif kind == 1:
            v, i = int.from_bytes(b[i : i + 8], "little"), i + 8
        elif kind == 2:
            n, i = varint(b, i)
            if i + n > len(b):
                raise ValueError("a field is cut off")
            v, i = b[i : i + n], i + n
        elif kind == 5:
            v, i = int.from_bytes(b[i : i + 4], "little"), i + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, v


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def double(n: int) -> float:
    return struct.unpack("<d", n.to_bytes(8, "little"))[0]


def unsnappy(b: bytes) -> bytes:
    import pyarrow as pa

    size, _ = varint(b, 0)
    return pa.Codec("snappy").decompress(b, size).to_pybytes()


def number(n: int) -> bytes:
    """A varint."""
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(n: int, v: int | float | str | bytes) -> bytes:
    """One field of the wire format: a varint, a double, or bytes with their length before them."""
    if isinstance(v, float):
        return number(n << 3 | 1) + struct.pack("<d", v)
    if isinstance(v, int):
        return number(n << 3) + number(v)
    v = v.encode() if isinstance(v, str) else v
    return number(n << 3 | 2) + number(len(v)) + v


def fixed64(n: int, v: int) -> bytes:
    return number(n << 3 | 1) + v.to_bytes(8, "little")


def snappy(b: bytes) -> bytes:
    import pyarrow as pa

    return pa.Codec("snappy").compress(b).to_pybytes()
