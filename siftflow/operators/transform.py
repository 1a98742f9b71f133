"""Operators on single rows."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftflow.frame import LogFrame
from siftflow.functions import text, udfs, values
from siftflow.lang import ir, literals
from siftflow.lang.lexer import QueryError
from siftflow.operators.filters import condition
from siftflow.operators.project import put

#: Fields that unpacking everything may add; more are an error.
MAX_FIELDS = 1000


def chosen(fr: LogFrame, iff: ir.Filter | None, field: str, new: Column) -> Column:
    """new where the condition holds, else the field as it was; the type stays the field's if both are the same."""
    if iff is None or isinstance(iff, ir.Noop):
        return new
    return F.when(condition(iff, fr), new).otherwise(fr.text(field))


def results(fr: LogFrame, p, new: dict[str, Column]) -> LogFrame:
    """Sets text results under the rules of keep_original_fields, skip_empty_results and if."""
    out = {}
    for f, x in new.items():
        old = fr.text(f)
        x = F.coalesce(x, F.lit(""))
        if p.keep:
            x = F.when(old != "", old).otherwise(x)
        elif p.skip_empty:
            x = F.when(x != "", x).otherwise(old)
        out[f] = chosen(fr, p.iff, f, x)
    return put(fr, out)


def extract(p: ir.Extract, fr: LogFrame) -> LogFrame:
    s = fr.text(p.source)
    if p.regexp:
        java, groups = text.java_re(p.pattern)
        # Spark's regexp_extract takes the first match and gives '' without one
        return results(fr, p, {f: F.regexp_extract(s, java, i) for f, i in groups.items()})
    steps = udfs.pattern_steps(p.pattern)
    fields = list(dict.fromkeys(f for _, f, _ in steps if f and f != "_"))
    if not fields:
        raise QueryError("extract needs a field")
    if all(opt == "plain" or not f for _, f, opt in steps) and all(lit for lit, _, _ in steps[1:]):
        return results(fr, p, plain_pattern(s, steps))
    m = udfs.each(lambda x: udfs.extracted(x, steps), udfs.MAP)(s)
    held = put(fr, {"__extracted": m})
    out = results(held, p, {f: F.try_element_at("__extracted", F.lit(f)) for f in fields})
    return out.with_df(out.df.drop("__extracted"))


def plain_pattern(s: Column, steps) -> dict[str, Column]:
    """A pattern without unquoting as nested built-ins: each literal is searched for after the value before it."""
    first = steps[0][0]
    rest = F.when(F.instr(s, first) > 0, F.substring(s, F.instr(s, first) + len(first), F.length(s))) if first else s
    out = {}
    for i, (_, f, _) in enumerate(steps):
        if not f:
            break
        after = steps[i + 1][0] if i + 1 < len(steps) else ""
        if after:
            at = F.instr(rest, after)
            value = F.when(at > 0, F.substring(rest, F.lit(1), at - 1))
            rest = F.when(at > 0, F.substring(rest, at + len(after), F.length(rest)))
        else:
            value = rest
        if f != "_":
            out[f] = value
    return out


def _seconds(ns: Column) -> Column:
    return values.text_of_double(ns / F.lit(1e9))


def _format_time(s: Column) -> Column:
    """Of a unix time to its last nanosecond, which a timestamp of micros couldn't hold."""
    n = F.when(s.rlike(r"^-?\d{1,19}(\.\d{1,9})?$"), s).try_cast("decimal(38,9)")
    a = F.abs(n)
    ns = F.when(a < 10**11, n * 10**9).when(a < 10**14, n * 10**6).when(a < 10**17, n * 1000).otherwise(n).cast("decimal(28,0)")
    seconds = F.floor(ns / F.lit(10**9)).cast("long")
    rest = (ns - seconds.cast("decimal(19,0)") * F.lit(10**9)).cast("long")
    frac = F.regexp_replace(F.concat(F.lit("."), F.lpad(rest.cast("string"), 9, "0")), r"\.?0+$", "")
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), frac, F.lit("Z"))


OPTIONS = {
    "q": lambda s: F.regexp_replace(F.to_json(F.struct(s.alias("x"))), r'^\{"x":(.*)\}$', "$1"),
    "uc": F.upper,
    "lc": F.lower,
    "time": _format_time,
    "duration": lambda s: values.duration_text(values.plain_number(s)),
    "duration_seconds": lambda s: _seconds(values.duration_ns(s)),
    "ipv4": lambda s: F.when(values.plain_number(s).between(0, 2**32 - 1), values.ipv4_text(values.plain_number(s))),
    "hexencode": lambda s: F.hex(s.cast("binary")),
    "hexdecode": udfs.each(udfs.unhexed, T.StringType()),
    "hexnumencode": lambda s: F.lpad(F.hex(s.try_cast("long")), 16, "0"),
    "hexnumdecode": lambda s: F.when(s.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(s, 16, 10)),
    "base64encode": lambda s: F.base64(s.cast("binary")),
    "base64decode": udfs.each(udfs.unbased, T.StringType()),
    "urlencode": F.url_encode,
    "urldecode": udfs.each(udfs.unurled, T.StringType()),
}


def format_(p: ir.Format, fr: LogFrame) -> LogFrame:
    """Values that an option can't read pass through unchanged."""
    parts = []
    for lit, f, opt in udfs.pattern_steps(p.pattern):
        if lit:
            parts.append(F.lit(lit))
        if f and f != "_":
            s = fr.text(f)
            if opt and opt not in OPTIONS:
                raise QueryError(f"unknown option {opt} of format")
            parts.append(F.when(s == "", s).otherwise(F.coalesce(OPTIONS[opt](s), s)) if opt else s)
    return results(fr, p, {p.result: F.concat(*parts) if parts else F.lit("")})


# ---------------------------------------------------------------- math


def _nan(x: Column) -> Column:
    return F.coalesce(x, F.lit(float("nan")))


def _long(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= values.INT64), F.lit(0)).otherwise(x).cast("long")


def _divide(a: Column, b: Column) -> Column:
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return F.when(b != 0, a / F.when(b != 0, b)).when(F.isnan(a) | F.isnan(b) | (a == 0), nan).when(a > 0, inf).otherwise(-inf)


def _remainder(a: Column, b: Column) -> Column:
    return F.when((b == 0) | F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(F.try_mod(a, b))


def _extreme(fn, args: list[Column]) -> Column:
    """NaN arguments are ignored unless all are."""
    known = [F.when(~F.isnan(a), a) for a in args]
    return _nan(known[0] if len(known) == 1 else fn(*known))


def _round(x: Column, *step: Column) -> Column:
    if not step:
        return F.when(F.isnan(x), x).otherwise(F.round(x))
    n = step[0]
    x = F.when(F.abs(x) == float("inf"), F.lit(float("nan"))).otherwise(x)
    # the multiple is rounded to the digits of the step, so that 0.1 x 3 is 0.3
    digits = F.greatest(F.lit(0), F.lit(1) - F.floor(F.log10(F.abs(n)))) + 6
    exact = F.round(_divide(x, n)) * n
    scale = F.pow(F.lit(10.0), digits)
    return F.when(F.isnan(exact) | (F.abs(exact) > 1e9), exact).otherwise(F.round(exact * scale) / scale)


def math_column(e: ir.MathExpr, fr: LogFrame) -> Column:
    """A double, NaN where there is no number."""
    if e.op == "num":
        return F.lit(float(literals.number(e.value)))
    if e.op == "field":
        return _nan(fr.number(e.value))
    a = [math_column(x, fr) for x in e.args]
    if len(a) == 1 and e.op == "-":
        return -a[0]
    both_bits = lambda op: F.when(F.isnan(a[0]) | F.isnan(a[1]), F.lit(float("nan"))).otherwise(op(_long(a[0]), _long(a[1])).cast("double"))
    match e.op:
        case "+":
            return a[0] + a[1]
        case "-":
            return a[0] - a[1]
        case "*":
            return a[0] * a[1]
        case "/":
            return _divide(*a)
        case "%":
            return _remainder(*a)
        case "^":
            return F.pow(*a)
        case "&":
            return both_bits(lambda x, y: x.bitwiseAND(y))
        case "or":
            return both_bits(lambda x, y: x.bitwiseOR(y))
        case "xor":
            return both_bits(lambda x, y: x.bitwiseXOR(y))
        case "default":
            return F.when(F.isnan(a[0]), a[1]).otherwise(a[0])
        case "abs":
            return F.abs(a[0])
        case "ceil" | "floor":
            op = F.ceil if e.op == "ceil" else F.floor
            return F.when(F.isnan(a[0]) | (F.abs(a[0]) >= 2**53), a[0]).otherwise(op(F.when(F.abs(a[0]) < 2**53, a[0])).cast("double"))
        case "exp":
            return F.exp(a[0])
        case "ln":
            return F.when(a[0] > 0, F.ln(F.when(a[0] > 0, a[0]))).when(a[0] == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
        case "now":
            return F.unix_micros(F.current_timestamp()).cast("double") * 1000.0
        case "rand":
            return F.rand()
        case "round":
            return _round(*a)
        case "max":
            return _extreme(F.greatest, a)
        case "min":
            return _extreme(F.least, a)
    raise QueryError(f"unknown math operation {e.op}")


def math(p: ir.Math, fr: LogFrame) -> LogFrame:
    for e, r in p.of:
        fr = put(fr, {r: math_column(e, fr)})
    return fr


# ---------------------------------------------------------------- text


def replace(p: ir.Replace, fr: LogFrame) -> LogFrame:
    s = fr.text(p.at)
    if p.regexp:
        if p.limit:
            new = udfs.each(udfs.replace_first(p.old, p.new, p.limit), T.StringType())(s)
        else:
            java, groups = text.java_re(p.old)
            to = p.new
            for n, i in groups.items():
                to = to.replace("${" + n + "}", f"${{{i}}}").replace(f"${n}", f"${i}")
            new = F.regexp_replace(s, java, re.sub(r"\$\{(\d+)\}", r"$\1", to))
    elif not p.old:
        new = s
    elif p.limit:
        # up to the limit-th old text, and the rest as it is
        head = F.substring_index(s, p.old, p.limit)
        tail = F.substring(s, F.length(head) + 1, F.length(s))
        new = F.concat(F.replace(head, F.lit(p.old), F.lit(p.new)), F.when(tail.startswith(p.old), F.concat(F.lit(p.new), F.substring(tail, F.lit(len(p.old) + 1), F.length(s)))).otherwise(tail))
    else:
        new = F.replace(s, F.lit(p.old), F.lit(p.new))
    return put(fr, {p.at: chosen(fr, p.iff, p.at, new)})


def collapse_nums(p: ir.CollapseNums, fr: LogFrame) -> LogFrame:
    return put(fr, {p.at: chosen(fr, p.iff, p.at, text.collapsed(fr.text(p.at), p.prettify))})


def decolorize(p: ir.Decolorize, fr: LogFrame) -> LogFrame:
    return put(fr, {p.at: text.decolorized(fr.text(p.at))})


def field_function(p: ir.FieldFunction, fr: LogFrame) -> LogFrame:
    s = fr.text(p.source)
    if p.kind == "len":
        return put(fr, {p.result: F.octet_length(s).cast("long")})
    if p.kind == "json_array_len":
        if isinstance(fr.type(p.source), T.ArrayType):
            return put(fr, {p.result: F.coalesce(F.array_size(fr.col(p.source)), F.lit(0)).cast("long")})
        return put(fr, {p.result: F.coalesce(F.json_array_length(s), F.lit(0)).cast("long")})
    return put(fr, {p.result: udfs.each(udfs.hash53, T.LongType())(s)})


def _json_path(f: str) -> list[str]:
    esc = f.replace("'", "\\'")
    return [f"$['{esc}']"] + (["$." + f] if "." in f and all(x.replace("_", "a").isalnum() for x in f.split(".")) else [])


def unpack(p: ir.Unpack, fr: LogFrame) -> LogFrame:
    """Fields that are named are set, to nothing if the source lacks them; fields that a wildcard matches only where they are.

    Text that isn't a JSON object leaves its row as it was.
    """
    s = fr.text(p.source)
    named = [f for f in p.of if not f.endswith("*")]
    applies = s.startswith("{") if p.kind == "json" else F.lit(True)
    if p.iff is not None:
        applies = applies & condition(p.iff, fr)
    if p.kind == "json" and len(named) == len(p.of):
        return set_unpacked(fr, p, {f: (F.coalesce(*[F.get_json_object(s, x) for x in _json_path(f)]), applies) for f in named})
    year, off = time.gmtime().tm_year, p.offset or 0
    parse = {"json": udfs.flat_json, "logfmt": udfs.logfmt, "syslog": lambda x: udfs.syslog(x, year, off)}[p.kind]
    held = put(fr, {"__unpacked": udfs.each(parse, udfs.MAP)(s), "__applies": applies})
    m, names = F.col("__unpacked"), {f: F.col("__applies") for f in named}
    if len(named) < len(p.of):
        for k in discovered(held.with_df(held.df.where("__applies")), "__unpacked"):
            if k not in names and any(f == ir.ALL or f.endswith("*") and k.startswith(f[:-1]) for f in p.of):
                names[k] = F.col("__applies") & F.coalesce(F.map_contains_key(m, k), F.lit(False))
    out = set_unpacked(held, p, {f: (F.try_element_at(m, F.lit(f)), where) for f, where in names.items()})
    return out.with_df(out.df.drop("__unpacked", "__applies"))


def set_unpacked(fr: LogFrame, p: ir.Unpack, new: dict[str, tuple[Column, Column]]) -> LogFrame:
    """new: by field its text and where it is set."""
    out = {}
    for f, (x, where) in new.items():
        f = p.prefix + f
        old, x = fr.text(f), F.coalesce(x, F.lit(""))
        if p.keep:
            x = F.when(old != "", old).otherwise(x)
        elif p.skip_empty:
            x = F.when(x != "", x).otherwise(old)
        out[f] = F.when(where, x).otherwise(old)
    return put(fr, out) if out else fr


def discovered(fr: LogFrame, column: str) -> list[str]:
    """The keys of a map column, by a pass over the data: schemas are static, so what is unpacked must be known first."""
    keys = [r[0] for r in fr.df.select(F.explode(F.map_keys(column)).alias("k")).distinct().limit(MAX_FIELDS + 1).collect()]
    if len(keys) > MAX_FIELDS:
        raise QueryError(f"more than {MAX_FIELDS} fields; name the ones that are needed")
    return sorted(keys)


def unpack_words(p: ir.UnpackWords, fr: LogFrame) -> LogFrame:
    w = text.word_list(fr.text(p.source))
    return put(fr, {p.result: F.to_json(F.array_distinct(w) if p.distinct else w)})


def unroll(p: ir.Unroll, fr: LogFrame) -> LogFrame:
    """Arrays side by side, the shorter ones padded; a row without any array stays one row of empty values."""

    def items(f: str) -> Column:
        t = fr.type(f)
        if isinstance(t, T.ArrayType):
            return F.transform(fr.col(f), lambda x: values.as_str(x, t.elementType))
        return F.when(fr.text(f).startswith("["), F.transform(F.from_json(fr.text(f), "array<string>"), lambda x: F.coalesce(x, F.lit("null"))))

    lists = [F.coalesce(items(f), F.array().cast("array<string>")) for f in p.of]
    if p.iff is not None:
        lists = [F.when(condition(p.iff, fr), x).otherwise(F.array(fr.text(f))) for f, x in zip(p.of, lists)]
    # zipped at once: a lambda over positions would read each array's text anew for every item
    out = fr.df.withColumn("__u", F.explode_outer(F.arrays_zip(*lists)))
    return fr.with_df(out.withColumns({f: F.coalesce(F.col("__u").getField(str(i)), F.lit("")) for i, f in enumerate(p.of)}).drop("__u"))


def sample(p: ir.Sample, fr: LogFrame) -> LogFrame:
    return fr if p.n <= 1 else fr.with_df(fr.df.sample(1.0 / p.n))
