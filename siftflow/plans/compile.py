"""A plan and a frame give a frame. Nothing runs here but what a static schema or an inlined subquery needs to know."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftflow.frame import LogFrame
from siftflow.lang import ir
from siftflow.lang.lexer import QueryError
from siftflow.lang.parser import values_field
from siftflow.operators import filters, project, rowset, stats, transform
from siftflow.operators.filters import condition, containing, keeping
from siftflow.plans import rewrite

OPERATORS = {
    ir.Fields: project.fields,
    ir.Delete: project.delete,
    ir.Copy: project.copy,
    ir.DropEmptyFields: project.drop_empty_fields,
    ir.FieldNames: project.field_names,
    ir.Pack: project.pack,
    ir.Extract: transform.extract,
    ir.Format: transform.format_,
    ir.Math: transform.math,
    ir.Replace: transform.replace,
    ir.CollapseNums: transform.collapse_nums,
    ir.Decolorize: transform.decolorize,
    ir.FieldFunction: transform.field_function,
    ir.Unpack: transform.unpack,
    ir.UnpackWords: transform.unpack_words,
    ir.Unroll: transform.unroll,
    ir.Sample: transform.sample,
    ir.Sort: rowset.sort,
    ir.Limit: rowset.limit,
    ir.Offset: rowset.offset,
    ir.Uniq: rowset.uniq,
    ir.Top: rowset.top,
    ir.Facets: rowset.facets,
    ir.FieldValues: rowset.field_values,
    ir.BlocksCount: rowset.blocks_count,
}


class Compiler:
    """source: the log that the query and the queries inside it read."""

    def __init__(self, source: LogFrame):
        self.source = source

    def run(self, q: ir.Query) -> LogFrame:
        q = rewrite.optimize(q)
        fr, pipes, step = self.source, list(q.pipes), rewrite.rate_step(q)
        if pipes and isinstance(pipes[0], ir.StreamContext):
            return self.pipes(rowset.stream_context(pipes[0], fr, self.inlined(q.filter)), pipes[1:], step)
        return self.pipes(self.where(q.filter, fr), pipes, step)

    def pipes(self, fr: LogFrame, pipes: list[ir.Pipe], step: float | None) -> LogFrame:
        done = False
        for p, after in zip(pipes, [*pipes[1:], None]):
            if done:  # with the pipe before
                done = False
                continue
            p = self.flagged_ifs(p)
            if isinstance(p, ir.Stats) and isinstance(after, ir.Unroll) and (each := stats.unrolled(p, after, fr)):
                fr, done = each, True
            elif isinstance(p, ir.Where):
                fr = self.where(p.filter, fr)
            elif isinstance(p, ir.Stats):
                fr = stats.stats(p, fr, step)
            elif isinstance(p, ir.Join):
                fr = rowset.join(p, fr, self.run(p.query))
            elif isinstance(p, ir.Union):
                fr = rowset.union(fr, self.run(p.query))
            elif isinstance(p, ir.BlockStats):
                fr = rowset.block_stats(fr)
            elif isinstance(p, ir.StreamContext):
                raise QueryError("stream_context must be the first pipe")
            else:
                fr = OPERATORS[type(p)](p, fr)
        return fr

    # ------------------------------------------------------------ subqueries

    def column(self, q: ir.Query) -> DataFrame:
        """The distinct values of a subquery, as text."""
        fr, f = self.run(q), values_field(q)
        return fr.df.select(fr.text(f).alias("v")).distinct()

    def few(self, q: ir.Query) -> list[str] | None:
        """The values of a subquery, for the plan; None if they are too many."""
        rows = self.column(q).limit(filters.MAX_INLINE + 1).collect()
        return sorted(r[0] for r in rows) if len(rows) <= filters.MAX_INLINE else None

    def values(self, q: ir.Query) -> list[str]:
        found = self.few(q)
        if found is None:
            raise QueryError(f"a subquery gives more than {filters.MAX_INLINE} values")
        return found

    def contents(self, f: ir.Filter, fr: LogFrame) -> ir.Filter:
        """f with the subqueries of contains_any and contains_all replaced by their values, but for those with too many."""
        if isinstance(f, (ir.And, ir.Or)):
            return type(f)(tuple(self.contents(x, fr) for x in f.of))
        if isinstance(f, ir.Not):
            return ir.Not(self.contents(f.of, fr))
        if isinstance(f, ir.Members) and f.query is not None and f.kind != "in":
            if (found := self.few(f.query)) is not None:
                return ir.Members(f.kind, f.field, tuple(found))
            if f.field == ir.ALL:
                return ir.Or(tuple(replace(f, field=x) for x in fr.columns))
        return f

    def inlined(self, f: ir.Filter) -> ir.Filter:
        """f with its subqueries replaced by their values."""
        if isinstance(f, (ir.And, ir.Or)):
            return type(f)(tuple(map(self.inlined, f.of)))
        if isinstance(f, ir.Not):
            return ir.Not(self.inlined(f.of))
        if isinstance(f, ir.Members) and f.query:
            return ir.Members(f.kind, f.field, tuple(self.values(f.query)))
        if isinstance(f, ir.StreamIds) and f.query:
            return ir.StreamIds(tuple(self.values(f.query)))
        return f

    def flagged_ifs(self, p: ir.Pipe) -> ir.Pipe:
        """The ifs of pipes take subqueries as values, as they choose within a row."""
        if getattr(p, "iff", None) is not None:
            return replace(p, iff=self.inlined(p.iff))
        if isinstance(p, ir.Stats):
            return replace(p, funcs=tuple(replace(f, iff=self.inlined(f.iff)) if f.iff is not None else f for f in p.funcs))
        return p

    def where(self, f: ir.Filter, fr: LogFrame) -> LogFrame:
        """Conjuncts that test membership in a subquery are semi or anti joins; under or and not they are joined flags."""
        f = rewrite.tidy(f)
        parts = f.of if isinstance(f, ir.And) else (f,)
        plain = [p for p in parts if rewrite.cost(p) < rewrite.QUERY]
        if plain and not (len(plain) == 1 and isinstance(plain[0], ir.Noop)):
            fr = fr.with_df(fr.df.where(keeping(ir.And(tuple(plain)) if len(plain) > 1 else plain[0], fr)))
        for p in parts:
            if rewrite.cost(p) == rewrite.QUERY:
                fr = self.where_query(p, fr)
        return fr

    def where_query(self, f: ir.Filter, fr: LogFrame) -> LogFrame:
        f = self.contents(f, fr)
        inner, how = (f.of, "left_anti") if isinstance(f, ir.Not) else (f, "left_semi")
        if self.joinable(inner):
            keys, on = self.membership(inner, fr)
            return fr.with_df(fr.df.join(keys, on, how))
        if not any(self.joinable(x) for x in walk(f)):
            return fr.with_df(fr.df.where(condition(self.inlined(f), fr)))
        flags, df, cols = {}, fr.df, fr.df.columns
        for i, x in enumerate(y for y in walk(f) if self.joinable(y)):
            keys, on = self.membership(x, fr)
            flags[id(x)] = f"__in{i}"
            df = df.join(keys.withColumn(f"__in{i}", F.lit(True)), on, "left").drop("__key")
        held = fr.with_df(df)
        rest = self.kept_inlined(f, flags)
        return fr.with_df(df.where(condition(rest, held, flags)).select(*[F.col("`" + x + "`") for x in cols]))

    def kept_inlined(self, f: ir.Filter, flags: dict[int, str]) -> ir.Filter:
        if id(f) in flags:
            return f
        if isinstance(f, (ir.And, ir.Or)):
            return type(f)(tuple(self.kept_inlined(x, flags) for x in f.of))
        if isinstance(f, ir.Not):
            return ir.Not(self.kept_inlined(f.of, flags))
        return self.inlined(f)

    @staticmethod
    def joinable(f: ir.Filter) -> bool:
        """After contents(), what has a query still."""
        return isinstance(f, (ir.StreamIds, ir.Members)) and f.query is not None

    def membership(self, f, fr: LogFrame):
        """The distinct values of f's subquery, and the join condition; native types are compared as they are. For contains_any and contains_all, the distinct texts that pass."""
        if isinstance(f, ir.Members) and f.kind != "in":
            own = fr.text(f.field)
            return containing(fr.df.select(own.alias("__key")), self.column(f.query), f.kind == "contains_all"), own.eqNullSafe(F.col("__key"))
        sub, name = self.run(f.query), values_field(f.query)
        field = f.field if isinstance(f, ir.Members) else ir.STREAM_ID
        same = sub.type(name) == fr.type(field) and fr.has(field)
        right, left = (sub.key(name), fr.key(field)) if same else (sub.text(name), fr.text(field))
        return sub.df.select(right.alias("__key")).distinct(), left.eqNullSafe(F.col("__key"))


def walk(f: ir.Filter):
    yield f
    for x in f.parts():
        yield from walk(x)
