"""The live tail of a query over a stream, and windowed statistics with a watermark.

A tail takes only pipes that look at one row at a time. Rows of a stream are emitted in the order of their time, batch by
batch: a row that isn't later than what its stream last emitted is late and dropped, as in a tail that polls.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftflow.frame import LogFrame, c
from siftflow.lang import ir
from siftflow.lang.lexer import QueryError
from siftflow.plans import rewrite
from siftflow.plans.compile import Compiler

#: How long rows may be late before Spark forgets about their duplicates.
LATENESS = "5 seconds"


def tail(engine, query: str, drop_late: bool = False, lateness: str = LATENESS, **args) -> DataFrame:
    """A streaming DataFrame of the query's rows; engine's frame must be over a streaming DataFrame."""
    q = engine.parse(query, **args)
    if bad := rewrite.can_tail(q):
        raise QueryError(f"{bad} can't be used in a live tail")
    fr = engine.frame
    if drop_late:
        fr = fr.with_df(in_order(fr))
    return Compiler(fr).run(q).df


def watermarked(fr: LogFrame, lateness: str) -> DataFrame:
    """The stream with its watermark, which needs an instant; local times count as times of the session's zone."""
    return fr.df.withColumn(ir.TIME, c(ir.TIME).cast("timestamp")).withWatermark(ir.TIME, lateness)


def deduplicated(fr: LogFrame, keys: list[str], lateness: str = LATENESS) -> LogFrame:
    """Rows that a source sent again within the lateness are dropped."""
    df = watermarked(fr, lateness).dropDuplicatesWithinWatermark(keys)
    return fr.with_df(df)


def in_order(fr: LogFrame) -> DataFrame:
    """Drops rows that aren't later than the last emitted row of their stream; the state is one timestamp per stream."""
    df = fr.df.withColumn("__stream", fr.text(ir.STREAM_ID))
    names = fr.df.columns
    schema = fr.df.schema

    def keep(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -(1 << 62)
        top = last
        for pdf in pdfs:
            us = pdf[ir.TIME].to_numpy("datetime64[us]").astype("int64")
            fresh = pdf[us > last].sort_values(ir.TIME, kind="stable")
            top = max(top, int(us.max()) if len(us) else top)
            yield fresh[names]
        state.update((top,))

    return df.groupBy("__stream").applyInPandasWithState(keep, schema, "last long", "append", "NoTimeout")


def windowed_stats(fr: LogFrame, step: str, aggregates: list, by: list[str] | None = None, slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Statistics per window of time and fields; a window is final when the watermark has passed its end."""
    df = watermarked(fr, watermark)
    w = F.window(c(ir.TIME), step, slide) if slide else F.window(c(ir.TIME), step)
    return df.groupBy(w.alias("window"), *[fr.key(b).alias(b) for b in by or []]).agg(*aggregates).select(F.col("window.start").alias(ir.TIME), *[c(b) for b in by or []], *[c(n) for n in agg_names(df, aggregates)])


def agg_names(df: DataFrame, aggregates: list) -> list[str]:
    return df.select(*[F.lit(0).alias(a._jc.toString().rpartition(" AS ")[2].strip("`")) for a in aggregates]).columns


def session_stats(fr: LogFrame, gap: str, aggregates: list, by: list[str] | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Statistics per session: rows of the same fields whose times are at most a gap apart."""
    df = watermarked(fr, watermark)
    keys = [fr.key(b).alias(b) for b in by or []] or [F.pmod(F.unix_micros(c(ir.TIME)), F.lit(1)).alias("__all")]  # Spark wants a key beside the session, and no constant
    return df.groupBy(F.session_window(c(ir.TIME), gap).alias("session"), *keys).agg(*aggregates).drop("__all")
