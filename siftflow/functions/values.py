"""Values as the language sees them, built as Columns so that they stay in generated code.

Native columns keep their types. as_str gives the text of any value, '' for a missing one; as_num its number as a double,
null if it has none. Text is a number if it is one with or without units (1.5KiB, 2h30m), a timestamp (nanoseconds), or an
address.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftflow.lang.literals import UNIT_BYTES, UNIT_NS

RFC3339 = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})?$"
IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)\.(25[0-5]|2[0-4]\d|1?\d?\d)$"
PLAIN = r"^[+-]?(\d[\d_]*\.?[\d_]*|\.\d+)([eE][+-]?\d+)?$"
DURATION = r"(\d+(?:\.\d+)?)(ns|us|µs|μs|ms|s|m|h|d|w|y)"
SIZE = r"(\d+(?:\.\d+)?)([KMGTPkmgtp]i?[Bb]?|[Bb])"
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
INT64 = 9.223372036854775e18


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, NUMERIC)


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def text_of_double(c: Column) -> Column:
    """Shortest text without an exponent: 10000000000, 0.5, 1."""
    s = c.cast("string")
    long = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    whole = (F.abs(c) < F.lit(1e18)) & (F.floor(c) == c)
    return F.when(F.isnan(c), "NaN").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").when(whole, F.when(F.abs(c) < F.lit(1e18), c).cast("long").cast("string")).when(s.contains("E"), F.coalesce(F.when(F.abs(c) < F.lit(1e19), long), s)).otherwise(s)


def text_of_time(c: Column) -> Column:
    s = F.regexp_replace(F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    # seconds that end in zeros have no fraction to trim
    base = F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(F.when(F.length(s) < F.length(base), base).otherwise(s), F.lit("Z"))


def as_str(c: Column, t: T.DataType) -> Column:
    """The text of a value; '' where it is missing."""
    if isinstance(t, T.StringType):
        return F.coalesce(c, F.lit(""))
    if isinstance(t, T.NullType):
        return F.lit("")
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.coalesce(text_of_double(c.cast("double")), F.lit(""))
    if is_time(t):
        return F.coalesce(text_of_time(c), F.lit(""))
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def units(text: Column, part: str, table: dict[str, int], fold: bool = False) -> Column:
    """Sum of the number-unit pairs that text consists of."""
    numbers, names = F.regexp_extract_all(text, F.lit(part), 1), F.regexp_extract_all(text, F.lit(part), 2)
    scale = F.create_map(*[F.lit(x) for kv in table.items() for x in (kv[0], float(kv[1]))])
    each = F.zip_with(numbers, names, lambda n, u: n.cast("double") * F.element_at(scale, F.lower(u) if fold else u))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return F.when(text.startswith("-"), -total).otherwise(total)


def duration_ns(text: Column) -> Column:
    """Nanoseconds of a duration, null for other text."""
    return F.when(text.rlike(f"^-?(?:{DURATION})+$"), units(text, DURATION, UNIT_NS))


def size_bytes(text: Column) -> Column:
    return F.when(text.rlike(f"^-?(?:{SIZE})+$"), units(text, SIZE, UNIT_BYTES, True))


def plain_number(text: Column) -> Column:
    low = F.lower(text)
    digits = F.when(text.rlike(PLAIN), F.regexp_replace(text, "_", "")).when(low.isin("inf", "+inf"), "Infinity").when(low == "-inf", "-Infinity")
    return digits.try_cast("double")


def radix_number(text: Column) -> Column:
    low = F.lower(text)
    body = F.regexp_replace(low, "^[+-]?0[xbo]", "")
    sign = F.when(low.startswith("-"), -1.0).otherwise(1.0)
    of = [F.when(low.rlike(f"^[+-]?0{c}[{d}]+$"), sign * F.conv(body, base, 10).try_cast("double")) for c, d, base in (("x", "0-9a-f", 16), ("b", "01", 2), ("o", "0-7", 8))]
    return F.coalesce(*of)


def instant_ns(text: Column) -> Column:
    return F.when(text.rlike(RFC3339), F.unix_micros(text.try_cast("timestamp")).cast("double") * 1000.0)


def ipv4_number(text: Column) -> Column:
    """Null for text that isn't an address."""
    p = [F.regexp_extract(text, IPV4, i).try_cast("long") for i in range(1, 5)]
    return F.when(text.rlike(IPV4), ((p[0] * 256 + p[1]) * 256 + p[2]) * 256 + p[3])


def ipv4_text(n: Column) -> Column:
    n = n.cast("long")
    return F.concat_ws(".", *[(F.shiftright(n, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)])


def text_number(text: Column) -> Column:
    """The number of a text; the cheap forms are tried first, and only text that starts like a number gets further."""
    starts = text.rlike(r"^[+-]?[.0-9]")
    return F.coalesce(plain_number(text), F.when(starts, F.coalesce(duration_ns(text), size_bytes(text), radix_number(text), instant_ns(text), ipv4_number(text).cast("double"))))


def as_num(c: Column, t: T.DataType) -> Column:
    """A double, null where there is no number; NaN counts as none."""
    if is_numeric(t):
        d = c.cast("double")
        return F.when(~F.isnan(d), d) if isinstance(t, (T.FloatType, T.DoubleType)) else d
    if is_time(t):
        return F.unix_micros(c.cast("timestamp")).cast("double") * 1000.0
    if isinstance(t, T.BooleanType) or isinstance(t, T.NullType):
        return F.lit(None).cast("double")
    return text_number(as_str(c, t))


def duration_text(ns: Column) -> Column:
    """1w2d3h4m5.6s; below a second ms, µs and ns."""
    ns = ns.cast("long")
    a = F.abs(ns)
    out, rest = [], a
    for name, size in (("w", 7 * 86400 * 10**9), ("d", 86400 * 10**9), ("h", 3600 * 10**9), ("m", 60 * 10**9)):
        n = ((rest - F.pmod(rest, F.lit(size))) / F.lit(size)).cast("long")
        out.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(name))).otherwise(""))
        rest = F.pmod(rest, F.lit(size))
    seconds = F.when(rest > 0, F.concat(text_of_double(rest.cast("double") / 1e9), F.lit("s"))).otherwise("")
    small = F.when(a == 0, "0s").when(a < 1000, F.concat(a.cast("string"), F.lit("ns"))).when(a < 10**6, F.concat(text_of_double(a / 1e3), F.lit("µs"))).when(a < 10**9, F.concat(text_of_double(a / 1e6), F.lit("ms"))).otherwise(F.concat(*out, seconds))
    return F.when(ns < 0, F.concat(F.lit("-"), small)).when(ns.isNotNull(), small)


def natural(text: Column) -> Column:
    """Text whose byte order is the natural order: runs of digits compare as numbers."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=\\d)", ""), 24, "0")).otherwise(p)), "")


def sort_key(c: Column, t: T.DataType) -> Column:
    """What values are ordered by: themselves if they have a type; text as numbers first, by value, then by natural order."""
    if not isinstance(t, (T.StringType, T.NullType)):
        return c
    s = as_str(c, t)
    n = text_number(s)
    return F.struct(F.when(s == "", 0).when(n.isNotNull(), 1).otherwise(2).alias("class"), F.coalesce(n, F.lit(0.0)).alias("n"), natural(s).alias("s"))
