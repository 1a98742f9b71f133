"""The read API over one log: row queries, hits, facets, statistics, fields and streams, and the live tail."""

from __future__ import annotations

import time as clock

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftflow.frame import LogFrame, c
from siftflow.lang import ir, literals
from siftflow.lang.lexer import QueryError
from siftflow.lang.parser import parse
from siftflow.operators import rowset
from siftflow.plans import rewrite
from siftflow.plans.compile import Compiler


class Engine:
    """now: what relative times are measured from; the clock's time if None."""

    def __init__(self, frame: LogFrame, now: str | int | None = None):
        self.frame, self.now = frame, literals.instant_us(now) if isinstance(now, str) else now

    def parse(self, query: str | ir.Query, start=None, end=None, extra_filters: str = "", extra_stream_filters: str = "") -> ir.Query:
        """The plan, with the span of time and the extra filters in it and in all queries inside it."""
        now = self.now if self.now is not None else clock.time_ns() // 1000
        q = parse(query, now) if isinstance(query, str) else query
        extra: list[ir.Filter] = []
        if start is not None or end is not None:
            far = 1 << 62
            low = self._instant(start, False) if start is not None else -far
            high = self._instant(end, True) if end is not None else far
            extra.append(ir.TimeRange(low, high, f"[{start or 0}, {end or 'now'})"))
        for text in (extra_filters, extra_stream_filters):
            if text:
                extra.append(parse(text, now).filter)
        return rewrite.with_filter(q, ir.And(tuple(extra))) if extra else q

    @staticmethod
    def _instant(x, end: bool) -> int:
        if isinstance(x, (int, float)):
            return literals.unix_us(str(x))
        s = literals.time_span(x)
        if s is None:
            raise QueryError(f"{x!r} isn't a time")
        return s[1] if end and s[1] - s[0] > 1 else s[0]

    def run(self, query: str | ir.Query, **args) -> LogFrame:
        return Compiler(self.frame).run(self.parse(query, **args))

    def query(self, query: str | ir.Query, limit: int | None = None, **args) -> DataFrame:
        """Rows. With a limit and nothing in the query that needs all rows, the newest ones."""
        q = self.parse(query, **args)
        fr = Compiler(self.frame).run(q)
        if limit is None:
            return fr.df
        if not rewrite.can_tail(q) and fr.has(ir.TIME):
            return fr.df.orderBy(F.desc(ir.TIME)).limit(limit)
        return fr.df.limit(limit)

    def explain(self, query: str, mode: str = "formatted", **args) -> None:
        self.query(query, **args).explain(mode)

    def json_lines(self, query: str, limit: int | None = None, **args) -> DataFrame:
        """Rows as JSON of strings without empty values, one column `line`."""
        df = self.query(query, limit, **args)
        fr = self.frame.with_df(df)
        return df.select(fr.row_json((ir.ALL,)).alias("line"))

    # ------------------------------------------------------------ statistics

    def hits(self, query: str, step: str = "1d", offset: str = "", fields: list[str] | None = None, fields_limit: int = 0, **args) -> DataFrame:
        """Rows per step of time and values of `fields`; pipes are dropped. Beyond fields_limit the groups of fewest hits are merged."""
        from dataclasses import replace

        q = replace(self.parse(query, **args), pipes=())
        by = tuple(ir.GroupKey(f) for f in fields or ())
        s = ir.Stats((ir.GroupKey(ir.TIME, step, offset), *by), (ir.StatsFunc("count", (ir.ALL,), "hits"),))
        df = Compiler(self.frame).run(replace(q, pipes=(s,))).df
        if fields and fields_limit:
            total = df.groupBy(*[c(f) for f in fields]).agg(F.sum("hits").alias("__t")).orderBy(F.desc("__t"), *[c(f) for f in fields]).limit(fields_limit)
            keep = total.select(*[c(f).alias(f"__f{i}") for i, f in enumerate(fields)], F.lit(True).alias("__keep"))
            df = df.join(F.broadcast(keep), [c(f).eqNullSafe(F.col(f"__f{i}")) for i, f in enumerate(fields)], "left")
            df = df.withColumns({f: F.when(F.col("__keep"), c(f)) for f in fields}).groupBy(c(ir.TIME), *[c(f) for f in fields]).agg(F.sum("hits").alias("hits"))
        return df

    def facets(self, query: str, limit: int = 10, max_values_per_field: int = 1000, max_value_len: int = 128, keep_const_fields: bool = False, **args) -> DataFrame:
        from dataclasses import replace

        q = self.parse(query, **args)
        return Compiler(self.frame).run(replace(q, pipes=(*q.pipes, ir.Facets(limit, max_values_per_field, max_value_len, keep_const_fields)))).df

    def stats(self, query: str, **args) -> DataFrame:
        """One row per metric and labels: metric, labels (map), value (double)."""
        q = self.parse(query, **args)
        return self._series(q, Compiler(self.frame).run(q).df, [])

    def stats_range(self, query: str, step: str = "1d", offset: str = "", **args) -> DataFrame:
        """Like stats, with a row per step of time."""
        q = rewrite.range_stats(self.parse(query, **args), step, offset)
        return self._series(q, Compiler(self.frame).run(q).df, [ir.TIME])

    @staticmethod
    def _series(q: ir.Query, df: DataFrame, extra: list[str]) -> DataFrame:
        if not any(isinstance(p, ir.Stats) for p in q.pipes):
            raise QueryError("a stats pipe is needed")
        labels, metrics = rewrite.labels_and_metrics(q)
        labels = [x for x in labels if x not in extra]
        fr = LogFrame(df)
        m = F.create_map(*[x for n in labels for x in (F.lit(n), fr.text(n))]) if labels else F.create_map().cast("map<string,string>")
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), fr.number(n).alias("value")) for n in metrics]))
        rows = df.select(*[c(x) for x in extra], m.alias("labels"), each.alias("m"))
        return rows.select(F.col("m.metric"), "labels", *[c(x) for x in extra], F.col("m.value"))

    # ------------------------------------------------------------ fields and streams

    def field_names(self, query: str, **args) -> DataFrame:
        return rowset_fields(self.run(query, **args))

    def field_values(self, query: str, field: str, limit: int = 0, **args) -> DataFrame:
        return rowset.field_values(ir.FieldValues(field, limit), self.run(query, **args)).df

    def _streams(self, query: str, value: Column, name: str, limit: int, **args) -> DataFrame:
        fr = self.run(query, **args)
        df = fr.df.groupBy(value.alias(name)).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), name)
        return df.limit(limit) if limit else df

    def streams(self, query: str, limit: int = 0, **args) -> DataFrame:
        return self._streams(query, self.frame.text(ir.STREAM), "value", limit, **args)

    def stream_ids(self, query: str, limit: int = 0, **args) -> DataFrame:
        return self._streams(query, self.frame.text(ir.STREAM_ID), "value", limit, **args)

    def stream_field_names(self, query: str, **args) -> DataFrame:
        fr = self.run(query, **args)
        if self.frame.stream:
            return rowset_fields(fr.with_df(fr.df.select(*[c(s) for s in self.frame.stream])))
        hits = fr.df.groupBy(fr.text(ir.STREAM).alias("s")).agg(F.count("*").alias("n"))
        names = F.explode(F.regexp_extract_all("s", F.lit(r'(?:^\{|,)([^="]+)="(?:[^"\\]|\\.)*"'), 1))
        return hits.select(names.alias("name"), "n").groupBy("name").agg(F.sum("n").alias("hits"))

    def stream_field_values(self, query: str, field: str, limit: int = 0, **args) -> DataFrame:
        return self._streams(query, self.frame.label(field), "value", limit, **args).where("value != ''")

    def tail(self, query: str, **options):
        from siftflow.streaming.tail import tail

        return tail(self, query, **options)


def rowset_fields(fr: LogFrame) -> DataFrame:
    from siftflow.operators.project import field_names

    return field_names(ir.FieldNames(), fr).df
