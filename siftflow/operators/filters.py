"""Filters as Columns. condition() is true or false, never null, so that NOT means what it says; keeping() may be null for false."""

from __future__ import annotations

from contextvars import ContextVar
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftflow.frame import LogFrame, c
from siftflow.functions import text, values
from siftflow.lang import ir, literals
from siftflow.lang.lexer import QueryError

#: Values of a subquery that contains_any and contains_all take into the plan; more are joined by their words, but in the if of a pipe or in stream_context, where they are an error.
MAX_INLINE = 10_000


#: Whether null may stand for false: so where rows are kept by a condition with no NOT above it. Only bare comparisons are pushed to the scan.
_LOOSE: ContextVar[bool] = ContextVar("loose", default=False)


def sure(x: Column) -> Column:
    return x if _LOOSE.get() else F.coalesce(x, F.lit(False))


def keeping(f: ir.Filter, frame: LogFrame) -> Column:
    """The condition for where(): null drops a row like false, so comparisons stay bare."""
    token = _LOOSE.set(True)
    try:
        return condition(f, frame)
    finally:
        _LOOSE.reset(token)


def strict(f: ir.Filter, frame: LogFrame, flags: dict[int, str] | None = None) -> Column:
    token = _LOOSE.set(False)
    try:
        return condition(f, frame, flags)
    finally:
        _LOOSE.reset(token)


def all_of(cols) -> Column:
    return reduce(and_, cols) if cols else F.lit(True)


def any_of(cols) -> Column:
    return reduce(or_, cols) if cols else F.lit(False)


def condition(f: ir.Filter, frame: LogFrame, flags: dict[int, str] | None = None) -> Column:
    """flags: names of the columns that hold the results of subqueries, by id of their filter."""
    go = lambda x: condition(x, frame, flags)
    if isinstance(f, ir.Noop):
        return F.lit(True)
    if isinstance(f, ir.And):
        return all_of([go(x) for x in f.of])
    if isinstance(f, ir.Or):
        return any_of([go(x) for x in f.of])
    if isinstance(f, ir.Not):
        return ~strict(f.of, frame, flags)
    if flags and id(f) in flags:
        return sure(c(flags[id(f)]))
    if getattr(f, "field", None) == ir.ALL:  # any of the fields
        from dataclasses import replace

        return any_of([go(replace(f, field=x)) for x in frame.columns])
    return CONDITIONS[type(f)](f, frame)


def _literal(value: str, t: T.DataType):
    """value as a literal of the column's own type if it is the text of one, so that the comparison reaches the scan."""
    if isinstance(t, values.INTEGRAL):
        x = literals.plain_number(value)
        return F.lit(int(x)).cast(t) if x is not None and value.lstrip("-").isdigit() and str(int(x)) == value and abs(x) < 2**53 else None
    if isinstance(t, T.BooleanType):
        return F.lit(value == "true") if value in ("true", "false") else None
    return None


def exact(f: ir.Exact, frame: LogFrame) -> Column:
    t, x = frame.type(f.field), frame.col(f.field)
    if f.value == "":
        return ~frame.filled(f.field)
    if isinstance(t, T.StringType):
        return sure(x == f.value)
    if (lit := _literal(f.value, t)) is not None:
        return sure(x == lit)
    if isinstance(t, values.INTEGRAL + (T.BooleanType,)):
        return F.lit(False)
    return frame.text(f.field) == f.value


def exact_prefix(f: ir.ExactPrefix, frame: LogFrame) -> Column:
    if isinstance(frame.type(f.field), T.StringType) and f.value:
        return sure(frame.col(f.field).startswith(f.value))
    return frame.text(f.field).startswith(f.value)


def members(f: ir.Members, frame: LogFrame, values_: list[str] | None = None) -> Column:
    if f.anything:
        return F.lit(True)
    if f.query is not None and values_ is None:
        raise QueryError("a subquery must be run before its filter is translated")
    vals = list(f.values) if values_ is None else values_
    if f.kind == "in":
        t = frame.type(f.field)
        if isinstance(t, T.StringType) and vals and "" not in vals:
            return sure(frame.col(f.field).isin(vals))
        lits = [_literal(v, t) for v in vals]
        if vals and all(x is not None for x in lits):
            return sure(frame.col(f.field).isin(lits))
        return frame.text(f.field).isin(vals) if vals else F.lit(False)
    s = frame.text(f.field)
    if f.kind == "contains_all":
        return all_of([text.has_phrase(s, v) for v in vals if v])
    return any_of([text.has_phrase(s, v) for v in vals])


def containing(texts: DataFrame, phrases: DataFrame, every: bool) -> DataFrame:
    """The distinct rows of texts (__key) that have any, or every one, of the distinct phrases (v).

    A phrase meets the texts that have its rarest word, by their hash, and is then looked for in them; those without a word meet all texts.
    """
    found = text.has_phrase_of(F.col("__key"), F.col("v"))
    phrases = phrases.where("v != ''") if every else phrases
    words = phrases.select("v", text.distinct_words(F.col("v")).alias("w"))
    own = words.select("v", F.explode("w").alias("word"))
    texts = texts.distinct()
    places = texts.select(F.xxhash64("__key").alias("h"), F.explode(text.distinct_words(F.col("__key"))).alias("word")).join(own.select("word").distinct(), "word", "left_semi")
    often = places.groupBy("word").agg(F.count("*").alias("n"))
    rarest = own.join(often, "word").groupBy("v").agg(F.min(F.struct("n", "word"))["word"].alias("word"))
    meet = places.join(rarest, "word").select("h", "v")
    bare = words.where(F.size("w") == 0).select("v")
    keyed = F.xxhash64("__key") == F.col("h")
    if not every:
        return texts.join(meet, keyed & found, "left_semi").union(texts.join(bare, found, "left_semi")).distinct()
    pairs = texts.join(meet, keyed & found).select("__key", "v").union(texts.join(bare, found).select("__key", "v")).union(texts.select("__key", F.lit(None).cast("string")))
    return pairs.groupBy("__key").agg(F.count("v").alias("n")).join(phrases.agg(F.count("*").alias("n")), "n", "left_semi").select("__key")


def number_range(f: ir.Range, frame: LogFrame) -> Column:
    inf = float("inf")
    t = frame.type(f.field)
    x = frame.col(f.field) if values.is_numeric(t) else frame.number(f.field)

    def bound(v: float):
        return F.lit(int(v)).cast("long") if isinstance(t, values.INTEGRAL) and v == int(v) and abs(v) < 2**53 else F.lit(float(v))

    tests = []
    if f.low != -inf or not f.with_low:
        tests.append(x >= bound(f.low) if f.with_low else x > bound(f.low)) if abs(f.low) != inf else tests.append(x > F.lit(f.low))
    if f.high != inf or not f.with_high:
        tests.append(x <= bound(f.high) if f.with_high else x < bound(f.high)) if abs(f.high) != inf else tests.append(x < F.lit(f.high))
    if isinstance(t, (T.FloatType, T.DoubleType)):
        tests.append(~F.isnan(x))  # Spark orders NaN above all numbers
    return sure(all_of(tests)) if tests else x.isNotNull()


def string_compare(f: ir.StringCompare, frame: LogFrame) -> Column:
    s = frame.text(f.field)
    return {"<": s < f.value, "<=": s <= f.value, ">": s > f.value, ">=": s >= f.value}[f.op]


def ipv4_range(f: ir.IPv4Range, frame: LogFrame) -> Column:
    return sure(values.ipv4_number(frame.text(f.field)).between(f.low, f.high))


def field_compare(f: ir.FieldCompare, frame: LogFrame) -> Column:
    a, b = frame.text(f.field), frame.text(f.other)
    if f.op == "eq":
        ta, tb = frame.type(f.field), frame.type(f.other)
        return frame.key(f.field).eqNullSafe(frame.key(f.other)) if ta == tb else a == b
    x, y = frame.number(f.field), frame.number(f.other)
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x <= y if f.op == "le" else x < y).otherwise(a <= b if f.op == "le" else a < b)


def value_type(f: ir.ValueType, frame: LogFrame) -> Column:
    """The storage type is the column's type, the same for all rows."""
    t = frame.type(f.field)
    own = {T.StringType: "string", T.ByteType: "int64", T.ShortType: "int64", T.IntegerType: "int64", T.LongType: "int64", T.FloatType: "float64", T.DoubleType: "float64", T.TimestampType: "time" if f.field == ir.TIME else "iso8601"}
    return F.lit(own.get(type(t), "string") == f.type and frame.has(f.field))


def _time(frame: LogFrame) -> Column:
    return frame.col(ir.TIME).cast("timestamp")


def time_range(f: ir.TimeRange, frame: LogFrame) -> Column:
    far, tests, t = 1 << 61, [], frame.col(ir.TIME)
    at = lambda us: F.timestamp_micros(F.lit(us)) if not isinstance(frame.type(ir.TIME), T.TimestampNTZType) else F.timestamp_micros(F.lit(us)).cast("timestamp_ntz")
    if f.low > -far:
        tests.append(t >= at(f.low))
    if f.high < far:
        tests.append(t < at(f.high))
    if frame.day and f.high > f.low:  # the partitions that can hold such rows
        day = c(frame.day)
        if f.low > -far:
            tests.append(day >= F.to_date(F.timestamp_micros(F.lit(f.low))))
        if f.high < far:
            tests.append(day <= F.to_date(F.timestamp_micros(F.lit(f.high - 1))))
    return sure(all_of(tests)) if tests else t.isNotNull()


def day_range(f: ir.DayRange, frame: LogFrame) -> Column:
    us = F.pmod(F.unix_micros(_time(frame)) - F.lit(f.offset), F.lit(86_400_000_000))
    return sure((us >= f.low) & (us < f.high))


def week_range(f: ir.WeekRange, frame: LogFrame) -> Column:
    days = F.floor((F.unix_micros(_time(frame)) - F.lit(f.offset)) / F.lit(86_400_000_000))
    return sure(F.pmod(days + 4, F.lit(7)).between(f.low, f.high))  # the epoch was a Thursday


def stream(f: ir.StreamFilter, frame: LogFrame) -> Column:
    def one(label: str, op: str, vals: tuple[str, ...]) -> Column:
        own = label in frame.stream
        if op in ("=~", "!~"):
            x = frame.label(label).rlike(f"^(?:{text.java_re(vals[0])[0]})$")
        elif own:
            x = strict(ir.Exact(label, vals[0]) if op in ("=", "!=") else ir.Members("in", label, vals), frame)
        else:
            x = frame.label(label).isin(list(vals)) if vals else F.lit(False)
        return ~x if op in ("!=", "!~", "not_in") else x

    return any_of([all_of([one(*t) for t in a]) for a in f.of])


CONDITIONS = {
    ir.Phrase: lambda f, fr: text.has_phrase(fr.text(f.field), f.text),
    ir.Prefix: lambda f, fr: text.has_prefix(fr.text(f.field), f.text) if f.text else fr.filled(f.field),
    ir.AnyCase: lambda f, fr: (text.has_prefix if f.prefix else text.has_phrase)(F.lower(fr.text(f.field)), f.text.lower()),
    ir.Exact: exact,
    ir.ExactPrefix: exact_prefix,
    ir.Regexp: lambda f, fr: text.matches_re(fr.text(f.field), f.pattern),
    ir.Members: members,
    ir.Seq: lambda f, fr: text.has_sequence(fr.text(f.field), list(f.phrases)),
    ir.Range: number_range,
    ir.StringCompare: string_compare,
    ir.StringRange: lambda f, fr: (fr.text(f.field) >= f.low) & (fr.text(f.field) < f.high),
    ir.LenRange: lambda f, fr: F.length(fr.text(f.field)).between(f.low if f.low > -1e18 else 0, f.high if f.high < 2**31 else 2**31 - 1),
    ir.IPv4Range: ipv4_range,
    ir.FieldCompare: field_compare,
    ir.ValueType: value_type,
    ir.TimeRange: time_range,
    ir.DayRange: day_range,
    ir.WeekRange: week_range,
    ir.StreamFilter: stream,
    ir.StreamIds: lambda f, fr: fr.text(ir.STREAM_ID).isin(list(f.values)),
}
