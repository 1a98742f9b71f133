"""Rewrites of the plan before it becomes DataFrames: only what Catalyst can't do, as it doesn't know the language."""

from __future__ import annotations

from dataclasses import fields, replace

from siftflow.lang import ir

CHEAP, TEXT, REGEX, QUERY = range(4)


def cost(f: ir.Filter) -> int:
    if isinstance(f, (ir.And, ir.Or, ir.Not)):
        return max((cost(x) for x in f.parts()), default=CHEAP)
    if getattr(f, "query", None) is not None:
        return QUERY
    if isinstance(f, (ir.Regexp, ir.Seq)):
        return REGEX
    return TEXT if isinstance(f, (ir.Phrase, ir.Prefix, ir.AnyCase, ir.IPv4Range)) or isinstance(f, ir.Members) and f.kind != "in" else CHEAP


def tidy(f: ir.Filter) -> ir.Filter:
    """Flat ands and ors without noops; cheap tests come before regular expressions and subqueries."""
    if isinstance(f, ir.Not):
        x = tidy(f.of)
        return x.of if isinstance(x, ir.Not) else ir.Not(x)
    if isinstance(f, (ir.And, ir.Or)):
        kind = type(f)
        of: list[ir.Filter] = []
        for x in map(tidy, f.of):
            of += x.of if isinstance(x, kind) else (x,)
        if kind is ir.Or and any(isinstance(x, ir.Noop) for x in of):
            return ir.Noop()
        of = [x for x in of if not isinstance(x, ir.Noop)]
        of = list(dict.fromkeys(of))
        if not of:
            return ir.Noop()
        if kind is ir.And:
            of.sort(key=cost)
        return of[0] if len(of) == 1 else kind(tuple(of))
    if isinstance(f, ir.Regexp) and f.pattern in ("", ".*"):
        return ir.Noop()
    if isinstance(f, ir.Members) and f.anything:
        return ir.Noop()
    return f


def both(a: ir.Filter, b: ir.Filter) -> ir.Filter:
    return tidy(ir.And((a, b)))


def optimize(q: ir.Query) -> ir.Query:
    f, pipes = tidy(q.filter), []
    for p in q.pipes:
        if isinstance(p, ir.Where):
            p = ir.Where(tidy(p.filter))
            if isinstance(p.filter, ir.Noop):
                continue
            if not pipes:
                f = both(f, p.filter)
                continue
            if isinstance(pipes[-1], ir.Where):
                pipes[-1] = ir.Where(both(pipes[-1].filter, p.filter))
                continue
        last = pipes[-1] if pipes else None
        if isinstance(last, ir.Sort) and not last.partition and not last.rank:
            if isinstance(p, ir.Limit):
                pipes[-1] = replace(last, limit=p.n if last.limit is None else min(last.limit, p.n))
                continue
            if isinstance(p, ir.Offset):  # what was sorted, less the first n of it
                pipes[-1] = replace(last, offset=last.offset + p.n, limit=None if last.limit is None else max(0, last.limit - p.n))
                continue
        if isinstance(last, ir.Limit) and isinstance(p, ir.Limit):
            pipes[-1] = ir.Limit(min(last.n, p.n))
            continue
        if isinstance(last, ir.Uniq) and not last.hits and isinstance(p, ir.Limit):
            pipes[-1] = replace(last, limit=min(last.limit or p.n, p.n))
            continue
        pipes.append(p)
    return replace(q, filter=f, pipes=tuple(pipes))


def subqueries(node, fn):
    """A copy of a filter or pipe with fn applied to the queries inside it."""
    if isinstance(node, ir.Query):
        return fn(node)
    if isinstance(node, tuple):
        return tuple(subqueries(x, fn) for x in node)
    if isinstance(node, (ir.Filter, ir.Pipe, ir.StatsFunc)):
        new = {x.name: subqueries(v, fn) for x in fields(node) if isinstance(v := getattr(node, x.name), (ir.Query, ir.Filter, tuple))}
        return replace(node, **{k: v for k, v in new.items() if v != getattr(node, k)}) if new else node
    return node


def with_filter(q: ir.Query, extra: ir.Filter) -> ir.Query:
    """extra joins the filter of q and of all queries inside it, but for those that opt out of the global time filter."""
    if ("ignore_global_time_filter", "true") in q.options:
        return q
    go = lambda x: with_filter(x, extra)
    return replace(q, filter=both(extra, subqueries(q.filter, go)), pipes=tuple(subqueries(p, go) for p in q.pipes))


def time_bounds(f: ir.Filter) -> tuple[int, int] | None:
    """The span of time that a filter's own conjuncts leave."""
    low, high, far = -(1 << 62), 1 << 62, 1 << 61
    for x in f.of if isinstance(f, ir.And) else (f,):
        if isinstance(x, ir.TimeRange):
            low, high = max(low, x.low), min(high, x.high)
    return (low, high) if low > -far and high < far else None


def rate_step(q: ir.Query) -> float | None:
    """Seconds that rates are divided by: the length of the time filter."""
    b = time_bounds(q.filter)
    return (b[1] - b[0]) / 1e6 if b and b[1] > b[0] else None


#: What a row-by-row stream can't do.
NOT_LIVE = (ir.Stats, ir.Sort, ir.Uniq, ir.Top, ir.Facets, ir.FieldNames, ir.FieldValues, ir.Limit, ir.Offset, ir.Union, ir.StreamContext, ir.BlockStats, ir.BlocksCount)


def can_tail(q: ir.Query) -> str:
    """'' if the query may run on a live stream, else the first pipe that may not."""
    return next((str(p) for p in q.pipes if isinstance(p, NOT_LIVE)), "")


#: What may follow stats in a range query.
AFTER_STATS = (ir.Where, ir.Sort, ir.Math, ir.Fields, ir.Delete, ir.Copy, ir.Format)


def range_stats(q: ir.Query, step: str, offset: str = "") -> ir.Query:
    """q with its stats by time step, and its top-k pipes per step."""
    at = max((i for i, p in enumerate(q.pipes) if isinstance(p, ir.Stats)), default=None)
    if at is None:
        raise ValueError("a stats pipe is needed")
    pipes = []
    for i, p in enumerate(q.pipes):
        if i > at and not isinstance(p, AFTER_STATS):
            raise ValueError(f"{p} can't follow stats here")
        if isinstance(p, ir.Stats):
            p = replace(p, by=(*[k for k in p.by if k.field != ir.TIME], ir.GroupKey(ir.TIME, step, offset)))
        elif i > at and isinstance(p, ir.Sort) and p.limit is not None and ir.TIME not in p.partition:
            p = replace(p, partition=(*p.partition, ir.TIME))
        pipes.append(p)
    return replace(q, pipes=tuple(pipes))


def labels_and_metrics(q: ir.Query) -> tuple[list[str], list[str]]:
    """Which columns of a stats query's result are labels, and which are its numbers."""
    s = next(p for p in reversed(q.pipes) if isinstance(p, ir.Stats))
    labels, metrics = [k.field for k in s.by], [f.result for f in s.funcs]
    for p in q.pipes[q.pipes.index(s) + 1 :]:
        if isinstance(p, ir.Math):
            metrics += [r for _, r in p.of if r not in metrics]
        elif isinstance(p, ir.Copy):
            for a, b in p.pairs:
                for names in (labels, metrics):
                    if a in names:
                        names[:] = [b if p.move and x == a else x for x in names] + ([] if p.move else [b])
        elif isinstance(p, ir.Fields):
            labels, metrics = [x for x in labels if x in p.of], [x for x in metrics if x in p.of]
        elif isinstance(p, ir.Delete):
            labels, metrics = [x for x in labels if x not in p.of], [x for x in metrics if x not in p.of]
        elif isinstance(p, ir.Format) and p.result not in labels:
            labels.append(p.result)
    return labels, metrics
