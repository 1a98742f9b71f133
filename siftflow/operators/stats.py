"""The stats operator: grouping keys with buckets, and the aggregate functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftflow.frame import LogFrame, c
from siftflow.functions import values
from siftflow.lang import ir, literals
from siftflow.lang.lexer import QueryError
from siftflow.operators.filters import all_of, any_of, condition
from siftflow.tables import written

STEPS = {"nanosecond": 1, "microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}
CALENDAR = {"week", "month", "year"}
#: Steps per decade of the histogram's buckets.
PER_DECADE = 18


def time_bucket(t: Column, bucket: str, offset: str) -> Column:
    off = literals.duration_us(offset) if offset else 0
    t = t.cast("timestamp")
    if bucket in CALENDAR:
        moved = F.timestamp_micros(F.unix_micros(t) - off) if off else t
        start = F.date_trunc(bucket, moved)
        return F.timestamp_micros(F.unix_micros(start) + off) if off else start
    step = STEPS.get(bucket) or literals.duration_us(bucket)
    if step <= 0:
        raise QueryError("a bucket must be positive")
    us = F.unix_micros(t) - F.lit(off)
    return F.timestamp_micros(us - F.pmod(us, F.lit(step)) + F.lit(off))


def _ip_mask(bucket: str) -> int:
    n = int(bucket[1:])
    return (0xFFFFFFFF << (32 - n)) & 0xFFFFFFFF


def bucketed(k: ir.GroupKey, fr: LogFrame) -> Column:
    """The group key: its bucket's start; values that have none stay as they are."""
    if not k.bucket:
        return fr.key(k.field)
    t = fr.type(k.field)
    if values.is_time(t):
        return time_bucket(fr.col(k.field), k.bucket, k.offset)
    if k.bucket.startswith("/"):
        s = fr.text(k.field)
        n = values.ipv4_number(s)
        return F.when(n.isNotNull(), values.ipv4_text(n.bitwiseAND(F.lit(_ip_mask(k.bucket))))).otherwise(s)
    step, off = literals.number(k.bucket), literals.number(k.offset) if k.offset else 0.0
    if not step or off is None:
        if k.bucket in STEPS or k.bucket in CALENDAR:
            s = fr.text(k.field)
            at = F.when(s.rlike(values.RFC3339), s.try_cast("timestamp"))
            return F.when(at.isNotNull(), values.text_of_time(time_bucket(at, k.bucket, k.offset))).otherwise(s)
        raise QueryError(f"bad bucket {k.bucket}")
    whole = step == int(step) and off == int(off)
    if isinstance(t, values.INTEGRAL) and whole:
        x = fr.col(k.field).cast("long") - F.lit(int(off))
        start = x - F.pmod(x, F.lit(int(step))) + F.lit(int(off))
        # numbers that aren't negative have no bucket below zero
        return F.when((x < 0) & (x + F.lit(int(off)) >= 0), F.lit(0).cast("long")).otherwise(start) if off > 0 else start
    digits = 0 if whole else max(len(repr(step).partition(".")[2]), len(repr(off).partition(".")[2]))

    def floor(x: Column) -> Column:
        return F.round(F.floor((x - off) / F.lit(step) + F.lit(1e-12)) * F.lit(step) + off, digits)

    if values.is_numeric(t):
        return floor(fr.col(k.field).cast("double"))
    s = fr.text(k.field)
    plain, dur, ip = values.plain_number(s), values.duration_ns(s), values.ipv4_number(s)
    if literals.duration_ns(k.bucket) is not None:
        at = F.when(s.rlike(values.RFC3339), s.try_cast("timestamp"))
        timed = F.when(at.isNotNull(), values.text_of_time(time_bucket(at, k.bucket, k.offset)))
    else:
        timed = F.lit(None).cast("string")
    return (
        F.when(timed.isNotNull(), timed)
        .when(plain.isNotNull(), values.text_of_double(floor(plain)))
        .when(dur.isNotNull(), values.duration_text(floor(dur)))
        .when(ip.isNotNull(), values.ipv4_text(floor(ip.cast("double"))))
        .otherwise(s)
    )


# ---------------------------------------------------------------- functions


def _typed(f: ir.StatsFunc, fr: LogFrame) -> list[str]:
    return fr.expand(f.args)


def _only(fr: LogFrame, f: ir.StatsFunc) -> Callable[[Column], Column]:
    """Puts the function's if around what is aggregated."""
    if f.iff is None or isinstance(f.iff, ir.Noop):
        return lambda x: x
    ok = condition(f.iff, fr)
    return lambda x: F.when(ok, x)


def count(f, fr, only) -> Column:
    if f.args == (ir.ALL,):
        return F.count(only(F.lit(1)))
    return F.count(only(F.when(any_of([fr.filled(n) for n in _typed(f, fr)]), 1)))


def count_empty(f, fr, only) -> Column:
    return F.count(only(F.when(all_of([~fr.filled(n) for n in _typed(f, fr)]), 1)))


def _tuple(f, fr) -> Column:
    names = _typed(f, fr)
    return F.when(any_of([fr.filled(n) for n in names]), F.struct(*[fr.key(n).alias(f"f{i}") for i, n in enumerate(names)]))


def count_uniq(f, fr, only) -> Column:
    n = F.count_distinct(only(_tuple(f, fr)))
    return F.least(n, F.lit(f.limit)) if f.limit else n


def count_uniq_hash(f, fr, only) -> Column:
    n = F.count_distinct(only(F.when(any_of([fr.filled(x) for x in _typed(f, fr)]), F.xxhash64(*[fr.key(x) for x in _typed(f, fr)]))))
    return F.least(n, F.lit(f.limit)) if f.limit else n


def _numbers(f, fr, only) -> tuple[Column, Column]:
    """Sum and count of the numbers of all fields together; an integral sum stays one."""
    names = _typed(f, fr)
    whole = names and all(isinstance(fr.type(n), values.INTEGRAL) for n in names)
    total = n = None
    for x in names:
        v = only(fr.col(x).cast("long") if whole else fr.number(x))
        s, k = F.coalesce(F.sum(v), F.lit(0 if whole else 0.0)), F.count(v)
        total, n = (s, k) if total is None else (total + s, n + k)
    return (total, n) if total is not None else (F.lit(None).cast("double"), F.count(F.lit(None)))


def sum_(f, fr, only) -> Column:
    """NaN if no value is a number; missing if the columns are integral, which have no NaN."""
    total, n = _numbers(f, fr, only)
    whole = all(isinstance(fr.type(x), values.INTEGRAL) for x in _typed(f, fr))
    return F.when(n > 0, total) if whole else F.when(n > 0, total).otherwise(F.lit(float("nan")))


def avg(f, fr, only) -> Column:
    total, n = _numbers(f, fr, only)
    return F.when(n > 0, total / F.when(n > 0, n)).otherwise(F.lit(float("nan")))


def _counts_empty(f) -> bool:
    """A field that is named counts where it is missing; one that a wildcard finds counts where it is."""
    return not any(a.endswith("*") for a in f.args)


def _extreme(f, fr, only, low: bool) -> Column:
    """Empty values of named fields are the smallest. Text compares in natural order; the value itself is returned."""
    names = _typed(f, fr)
    kinds = {type(fr.type(n)) for n in names}
    pick, both = (F.min, F.least) if low else (F.max, F.greatest)
    if len(kinds) == 1 and not kinds & {T.StringType, T.NullType}:
        found = [pick(only(fr.col(n))) for n in names]
        best = found[0] if len(found) == 1 else both(*found)
        if low and _counts_empty(f):
            empty = [F.count(only(F.when(~fr.filled(n), 1))) > 0 for n in names]
            return F.when(~any_of(empty), best)
        return best
    rows = [F.struct(values.sort_key(F.when(fr.text(n) != "", fr.text(n)), T.StringType()).alias("k"), fr.text(n).alias("v")) for n in names]
    rows = rows if _counts_empty(f) else [F.when(fr.filled(n), r) for n, r in zip(names, rows)]
    found = [pick(only(r)) for r in rows]
    return (found[0] if len(found) == 1 else both(*found))["v"]


def natively(f, fr) -> bool:
    """Whether a quantile is one of a single column of numbers or times, which order as they are."""
    names = _typed(f, fr)
    return len(names) == 1 and (values.is_numeric(fr.type(names[0])) or values.is_time(fr.type(names[0])))


def ranked_values(f: ir.StatsFunc, keyed: LogFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Each group's distinct values with their number and the running number within a range partition, and what comes before each partition.

    Text, and several fields together, are in natural order; missing values of a named field are the smallest. The partitioned
    values are a written table, as another run could draw other boundaries.
    """
    only, names = _only(keyed, f), _typed(f, keyed)
    if natively(f, keyed):
        t, x = keyed.type(names[0]), keyed.col(names[0])
        x = x if values.is_time(t) or not _counts_empty(f) else x.cast("long" if isinstance(t, values.INTEGRAL) else "double")
        rows = keyed.df.select(*keys, only(F.struct(x.alias("v"))).alias("r")).where("r IS NOT NULL").select(*keys, "r.v")
        rows = rows.where("v IS NOT NULL") if values.is_time(t) or not _counts_empty(f) else rows
        order = F.col("v")
    else:
        every = F.array(*[only(keyed.text(n) if _counts_empty(f) else F.when(keyed.filled(n), keyed.text(n))) for n in names])
        rows = keyed.df.select(*keys, F.explode(every).alias("v")).where("v IS NOT NULL")
        order = values.sort_key(F.when(F.col("v") != "", F.col("v")), T.StringType())
    counts = rows.groupBy(*keys, "v").agg(F.count("*").alias("n")).withColumn("k", order)
    parts = counts.repartitionByRange(*keys, "k", "v").withColumn("p", F.spark_partition_id())
    placed = written(parts.withColumn("upto", F.sum("n").over(Window.partitionBy("p", *keys).orderBy("k", "v").rowsBetween(Window.unboundedPreceding, 0))), "quantile")
    group = Window.partitionBy(*keys)
    sizes = placed.groupBy(*keys, "p").agg(F.sum("n").alias("s"))  # one row per group and partition
    before = F.coalesce(F.sum("s").over(group.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed, sizes.select(*[F.col(k).alias(f"{k}n") for k in keys], F.col("p").alias("pn"), "s", before.alias("b"), F.sum("s").over(group).alias("total"))


def quantile(f: ir.StatsFunc, keys: list[str], placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """The value at int(phi x n) in order."""
    at = F.least(F.floor(F.col("total") * F.lit(float(f.phi))), F.col("total") - 1)
    found = sizes.withColumn("at", at - F.col("b")).where("at >= 0 AND at < s")
    on = [F.col("p") == F.col("pn"), F.col("upto") > F.col("at"), F.col("upto") - F.col("n") <= F.col("at")] + [F.col(k).eqNullSafe(F.col(f"{k}n")) for k in keys]
    return placed.join(found, on).select(*keys, F.col("v").alias("__h"))


def row_any(f, fr, only) -> Column:
    return F.coalesce(F.first(only(fr.row_json(f.args)), ignorenulls=True), F.lit("{}"))


def _descending(x: Column, t: T.DataType) -> Column | None:
    """Orders by min as the order key x of type t does by max; None for types that have no such key."""
    if isinstance(t, values.INTEGRAL):
        return F.bitwise_not(x)  # -x could overflow
    if isinstance(t, T.BooleanType):
        return ~x
    if values.is_time(t):
        return -F.unix_micros(x.cast("timestamp"))
    if isinstance(t, (T.StringType, T.NullType)):
        # inverted digits, and a mark above all digits at the end, so that a prefix comes after what it begins
        s = F.concat(F.translate(F.hex(x["s"]), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
        return F.struct((-x["class"]).alias("class"), (-x["n"]).alias("n"), s.alias("s"))
    if isinstance(t, (T.FloatType, T.DoubleType)):  # NaN is the largest
        return F.struct((~F.isnan(x)).alias("number"), (-x).alias("n"))
    return -x if isinstance(t, T.DecimalType) else None


def _row_extreme(f, fr, only, low: bool) -> Column:
    key, out = f.args[0], f.args[1:] or (ir.ALL,)
    k = only(F.when(fr.filled(key), fr.order(key)))
    # of rows with equal keys the one with the smallest values, field by field, so that the result doesn't depend on their order
    ties = [fr.col(n) if values.is_numeric(fr.type(n)) or values.is_time(fr.type(n)) else fr.text(n) for n in fr.expand(out)]
    by = k if low else _descending(k, fr.type(key))
    best = F.struct((k if by is None else by).alias("k"), *[x.alias(f"t{i}") for i, x in enumerate(ties)], fr.row_json(out).alias("r"))
    return F.coalesce((F.max if by is None else F.min)(F.when(k.isNotNull(), best))["r"], F.lit("{}"))


def sum_len(f, fr, only) -> Column:
    parts = [F.coalesce(F.sum(only(F.octet_length(fr.text(n)).cast("long"))), F.lit(0)) for n in _typed(f, fr)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def uniq_values(f, fr, only) -> Column:
    """Sorted in natural order. Without a limit it's one array, as is that of values(), and must fit in a task; see bounded() for those with one."""
    sets = [F.collect_set(only(F.when(fr.text(n) != "", fr.text(n)))) for n in _typed(f, fr)]
    merged = sets[0] if len(sets) == 1 else F.array_distinct(F.concat(*sets))
    keyed = F.array_sort(F.transform(merged, lambda x: F.struct(values.sort_key(x, T.StringType()).alias("k"), x.alias("v"))))
    out = F.transform(keyed, lambda x: x["v"])
    return F.to_json(F.slice(out, 1, f.limit) if f.limit else out)


def values_(f, fr, only) -> Column:
    lists = [F.collect_list(only(fr.text(n))) for n in _typed(f, fr)]
    out = lists[0] if len(lists) == 1 else F.concat(*lists)
    return F.to_json(F.slice(out, 1, f.limit) if f.limit else out)


def json_values(f, fr, only) -> Column:
    out = F.collect_list(only(fr.row_json(f.args)))
    return F.concat(F.lit("["), F.array_join(F.slice(out, 1, f.limit) if f.limit else out, ","), F.lit("]"))


def bounded(f: ir.StatsFunc, keyed: LogFrame, keys: list[str]) -> DataFrame:
    """values, json_values and uniq_values with a limit: a group's rows are cut to it before they are gathered, and in each partition before they are shuffled."""
    only, names = _only(keyed, f), _typed(f, keyed)
    text = keyed.row_json(f.args) if f.kind == "json_values" else None
    each = [only(text)] if text is not None else [only(F.when(keyed.text(n) != "", keyed.text(n)) if f.kind == "uniq_values" else keyed.text(n)) for n in names]
    rows = keyed.df.select(*keys, F.explode(F.array(*each)).alias("v")).where("v IS NOT NULL")
    if f.kind == "uniq_values":
        rows = rows.distinct().withColumn("k", values.sort_key(F.col("v"), T.StringType()))
    order = ["k", "v"] if f.kind == "uniq_values" else [F.lit(0)]
    kept = rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= f.limit)
    found = F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"])
    as_text = F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")) if f.kind == "json_values" else F.to_json(found)
    return kept.groupBy(*keys).agg(as_text.alias("__h"))


FUNCTIONS = {
    "count": count,
    "count_empty": count_empty,
    "count_uniq": count_uniq,
    "count_uniq_hash": count_uniq_hash,
    "sum": sum_,
    "avg": avg,
    "min": lambda f, fr, only: _extreme(f, fr, only, True),
    "max": lambda f, fr, only: _extreme(f, fr, only, False),
    "row_any": row_any,
    "row_min": lambda f, fr, only: _row_extreme(f, fr, only, True),
    "row_max": lambda f, fr, only: _row_extreme(f, fr, only, False),
    "sum_len": sum_len,
    "uniq_values": uniq_values,
    "values": values_,
    "json_values": json_values,
}


def column(f: ir.StatsFunc, fr: LogFrame, step_s: float | None) -> Column:
    only = _only(fr, f)
    if f.kind in ("rate", "rate_sum"):
        x = count(f, fr, only) if f.kind == "rate" else sum_(f, fr, only)
        return x.cast("double") / F.lit(float(step_s)) if step_s else x.cast("double")
    return FUNCTIONS[f.kind](f, fr, only)


def bucket_text(v: Column) -> Column:
    """The text of the logarithmic bucket of a number."""
    i = F.floor(F.log10(v) * PER_DECADE)

    def edge(k: Column) -> Column:
        e = F.floor(k / PER_DECADE)
        m = F.round(F.pow(F.lit(10.0), k / F.lit(float(PER_DECADE)) - e), 3)
        up = m >= 10
        e, m = F.when(up, e + 1).otherwise(e), F.when(up, F.lit(1.0)).otherwise(m)
        return F.concat(F.format_string("%.3f", m), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))

    return F.when(v > 0, F.concat(edge(i), F.lit("..."), edge(i + 1))).when(v == 0, F.lit("0...1.000e-09"))


def histogram(f: ir.StatsFunc, keyed: LogFrame, keys: list[str]):
    """Hits per bucket, first by group and bucket, then as JSON per group; a group has at most a few hundred buckets."""
    v = _only(keyed, f)(keyed.number(f.args[0]))
    rows = keyed.df.select(*keys, v.alias("__v")).where(F.col("__v") >= 0).select(*keys, bucket_text(F.col("__v")).alias("vmrange"), F.floor(F.log10(F.when(F.col("__v") > 0, F.col("__v"))) * PER_DECADE).alias("i"))
    hits = rows.groupBy(*keys, "vmrange", "i").agg(F.count("*").alias("hits"))
    return hits.groupBy(*keys).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("i", "vmrange", "hits"))), lambda x: F.struct(x["vmrange"].alias("vmrange"), x["hits"].alias("hits")))).alias("__h"))


def stats(p: ir.Stats, fr: LogFrame, step_s: float | None = None) -> LogFrame:
    names = [k.field for k in p.by]
    if not step_s:  # a rate is per second of the bucket of time, if there is one
        step_s = next((s for k in p.by if k.field == ir.TIME and k.bucket and (s := bucket_seconds(k.bucket))), None)
    keys = {f"__g{i}": bucketed(k, fr) for i, k in enumerate(p.by)}
    ranked = {}

    def quantiles(f: ir.StatsFunc, keyed: LogFrame, keys: list[str]) -> DataFrame:
        """Quantiles of the same values share a table."""
        of = (f.args, f.iff)
        if of not in ranked:
            ranked[of] = ranked_values(f, keyed, keys)
        return quantile(f, keys, *ranked[of])

    def apart(f: ir.StatsFunc):
        """What makes a function that needs an aggregation of its own, and its value where there is nothing."""
        if f.kind == "histogram":
            return histogram, "[]"
        if f.kind in ("values", "json_values", "uniq_values") and f.limit:
            return bounded, "[]"
        return (quantiles, None if natively(f, fr) else "") if f.kind in ("quantile", "median") else None

    own = [f for f in p.funcs if not apart(f)]
    base = fr.with_df(fr.df.withColumns(keys)) if keys else fr
    df = base.df.groupBy(*keys).agg(*([column(f, fr, step_s).alias(f.result) for f in own] or [F.count(F.lit(1)).alias("__n")]))
    for i, f in enumerate(p.funcs):
        if apart(f):
            make, nothing = apart(f)
            h = make(f, base, list(keys))
            if keys:
                h = h.select(*[F.col(k).alias(f"{k}h") for k in keys], F.col("__h").alias(f"__h{i}"))
                df = df.join(h, [F.col(k).eqNullSafe(F.col(f"{k}h")) for k in keys], "left").drop(*[f"{k}h" for k in keys])
            else:
                df = df.withColumn("__one", F.lit(1)).join(h.select(F.lit(1).alias("__one"), F.col("__h").alias(f"__h{i}")), "__one", "left").drop("__one")
            df = df.withColumn(f.result, F.col(f"__h{i}") if nothing is None else F.coalesce(F.col(f"__h{i}"), F.lit(nothing)))
    return fr.with_df(df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c(f.result) for f in p.funcs]))


def unrolled(p: ir.Stats, u: ir.Unroll, fr: LogFrame) -> LogFrame | None:
    """What unroll makes of the only function's values per group, row by row, so that no group is gathered; None where it isn't just that.

    A group has a row here if it has a value. Without keys, or with an if, one without values would be a row too.
    """
    f = p.funcs[0]
    ifs = [x for x in (f.iff, u.iff) if x is not None and not isinstance(x, ir.Noop)]
    if len(p.funcs) > 1 or f.kind not in ("values", "json_values") or f.limit or ifs or not p.by or u.of != (f.result,) or f.result in [k.field for k in p.by]:
        return None
    each = [fr.row_json(f.args)] if f.kind == "json_values" else [fr.text(n) for n in _typed(f, fr)]
    if not each:
        return None
    return fr.with_df(fr.df.select(*[bucketed(k, fr).alias(k.field) for k in p.by], (each[0] if len(each) == 1 else F.explode(F.array(*each))).alias(f.result)))


def bucket_seconds(bucket: str) -> float | None:
    if bucket in STEPS:
        return STEPS[bucket] / 1e6
    if bucket in CALENDAR:
        return {"week": 7 * 86400.0}.get(bucket)
    ns = literals.duration_ns(bucket)
    return ns / 1e9 if ns else None
