"""What all readers share: from a map of text fields to a row of the log.

A row has _time, _msg, _stream, _stream_id, _day and `fields`, a map of the other fields; empty values are dropped. Rows whose
time can't be read go to rejected(), never into the log.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftflow.frame import LogFrame
from siftflow.functions import text, values


@dataclass(frozen=True)
class Ingest:
    """Names may end in * where fields are ignored or decolorized. now: the time of rows without one; the clock's if None."""

    time_fields: tuple[str, ...] = ("_time",)
    msg_fields: tuple[str, ...] = ("_msg",)
    stream_fields: tuple[str, ...] = ()
    ignore_fields: tuple[str, ...] = ()
    decolorize_fields: tuple[str, ...] = ()
    extra_fields: tuple[tuple[str, str], ...] = ()
    default_msg: str = ""
    now: str | None = None

    def but(self, **new) -> Ingest:
        """self with the given settings where they aren't set."""
        blank = Ingest()
        return replace(self, **{k: v for k, v in new.items() if getattr(self, k) == getattr(blank, k)})


def named(k: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | (k.startswith(p[:-1]) if p.endswith("*") else k == p)
    return out


def first_of(fields: Column, names: tuple[str, ...]) -> Column:
    """The first value that isn't empty; null if there is none."""
    got = [F.try_element_at(fields, F.lit(n)) for n in names]
    return F.coalesce(*[F.when(x != "", x) for x in got]) if got else F.lit(None).cast("string")


def event_time(raw: Column, now: str | None) -> Column:
    """Nothing, 0 and - are now; numbers are unix times whose size tells the unit; the rest is RFC 3339. Null if it can't be read."""
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    n = F.when(raw.rlike(r"^-?\d+(\.\d+)?$"), raw.cast("decimal(38,9)"))
    a = F.abs(n)
    us = F.when(a < 10**11, n * 10**6).when(a < 10**14, n * 1000).when(a < 10**17, n).otherwise(n / 1000)
    day = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw.try_cast("timestamp"))
    return F.when(raw.isNull() | raw.isin("", "0", "-"), at).when(n.isNotNull(), F.timestamp_micros(us.cast("long"))).otherwise(F.coalesce(F.when(raw.rlike(values.RFC3339), raw.try_cast("timestamp")), day))


def rows(df: DataFrame, how: Ingest, fields: str = "fields") -> DataFrame:
    """df has a map column of text fields; null maps are lines that couldn't be read, and stay null."""
    m = F.col(fields)
    if how.extra_fields:
        extra = F.create_map(*[F.lit(x) for kv in how.extra_fields for x in kv])
        m = F.map_concat(F.map_filter(m, lambda k, v: ~k.isin([k2 for k2, _ in how.extra_fields])), extra)
    if how.decolorize_fields:
        m = F.transform_values(m, lambda k, v: F.when(named(k, how.decolorize_fields), text.decolorized(v)).otherwise(v))
    m = F.map_filter(m, lambda k, v: (v != "") & ~named(k, how.ignore_fields))
    labels = [F.when(F.coalesce(F.try_element_at("m", F.lit(s)), F.lit("")) != "", F.concat(F.lit(f'{s}="'), F.replace(F.replace(F.try_element_at("m", F.lit(s)), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))) for s in sorted(how.stream_fields)]
    held = df.select(m.alias("m"))
    msg = F.coalesce(first_of(F.col("m"), how.msg_fields), F.lit(how.default_msg or None))
    used = how.time_fields + how.msg_fields
    out = held.select(
        event_time(first_of(F.col("m"), how.time_fields), how.now).alias("_time"),
        msg.alias("_msg"),
        F.concat(F.lit("{"), F.concat_ws(",", *labels), F.lit("}")).alias("_stream"),
        F.map_filter("m", lambda k, v: ~k.isin(list(used))).alias("fields"),
        F.col("m").isNull().alias("_bad"),
    )
    return out.withColumn("_stream_id", F.concat(F.lit("0" * 16), F.md5("_stream"))).withColumn("_day", F.to_date("_time"))


COLUMNS = ["_time", "_msg", "_stream", "_stream_id", "fields", "_day"]


def accepted(df: DataFrame, past_days: float | None = None, future_days: float | None = None, now: str | None = None) -> DataFrame:
    """Rows that could be read, within the retention and the future that is allowed."""
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    ok = ~F.col("_bad") & F.col("_time").isNotNull()
    us = F.unix_micros("_time") - F.unix_micros(at)
    if past_days is not None:
        ok = ok & (us >= -int(past_days * 86_400_000_000))
    if future_days is not None:
        ok = ok & (us <= int(future_days * 86_400_000_000))
    return df.where(ok).select(COLUMNS)


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col("_bad") | F.col("_time").isNull())


def log(df: DataFrame) -> LogFrame:
    """Accepted rows as a log whose fields are looked up by name in the map."""
    return LogFrame(df, (), "fields", "_day")


def columns(df: DataFrame, names: list[str], stream: tuple[str, ...] = ()) -> LogFrame:
    """The log with some of its fields as columns of their own, so that scans read and prune them."""
    m = F.col("fields")
    return LogFrame(df.select("_time", "_msg", *[F.try_element_at(m, F.lit(n)).alias(n) for n in names], F.map_filter(m, lambda k, v: ~k.isin(names)).alias("fields"), "_day"), stream, "fields", "_day")
