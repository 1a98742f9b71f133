"""Operators that choose, rename and pack columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftflow.frame import LogFrame, c
from siftflow.lang import ir
from siftflow.operators.filters import any_of


def quiet(x):
    """Text as a result: '' is kept as missing."""
    return F.when(x != "", x)


def fields(p: ir.Fields, fr: LogFrame) -> LogFrame:
    names = fr.expand(p.of)
    return fr.with_df(fr.df.select(*[fr.col(n).alias(n) for n in names])) if names else fr.with_df(fr.df.select())


def delete(p: ir.Delete, fr: LogFrame) -> LogFrame:
    gone = set(fr.expand(p.of))
    return fr.with_df(fr.df.select(*[c(x) for x in fr.df.columns if x not in gone]))


def copy(p: ir.Copy, fr: LogFrame) -> LogFrame:
    """Pairs one after the other; a missing source gives an empty column; the target is overwritten."""
    for a, b in p.pairs:
        if a.endswith("*"):
            wild = [(x, b[:-1] + x[len(a) - 1 :] if b.endswith("*") else b) for x in fr.columns if x.startswith(a[:-1])]
        else:
            wild = [(a, b)]
        moved = {x for x, y in wild if x != y} if p.move else set()
        new = {y: fr.col(x).alias(y) for x, y in wild if y}  # a field without a name can't be kept
        keep = [new.pop(x) if x in new else c(x) for x in fr.df.columns if x in new or x not in moved]
        fr = fr.with_df(fr.df.select(*keep, *new.values()))
    return fr


def drop_empty_fields(p: ir.DropEmptyFields, fr: LogFrame) -> LogFrame:
    """'' becomes missing, and rows without any value go."""
    cols = [F.when(fr.filled(x), c(x)).alias(x) for x in fr.columns]
    out = fr.with_df(fr.df.select(*cols))
    return out.with_df(out.df.where(any_of([c(x).isNotNull() for x in out.columns])))


def field_names(p: ir.FieldNames, fr: LogFrame) -> LogFrame:
    """Exact hits of every field, counted in one pass."""
    names = fr.columns
    counts = fr.df.agg(*[F.count(F.when(fr.filled(n), 1)).alias(f"c{i}") for i, n in enumerate(names)])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"c{i}").alias("h")) for i, n in enumerate(names)]))
    return fr.with_df(counts.select(rows.alias("x")).where("x.h > 0").select(F.col("x.n").alias(p.result), F.col("x.h").alias("hits")))


def pack(p: ir.Pack, fr: LogFrame) -> LogFrame:
    if p.kind == "json":
        out = fr.row_json(p.of, in_order=True)
    else:
        parts = []
        for n in fr.expand(p.of):
            s = fr.text(n)
            q = F.when(s.rlike(r'[\x00-\x20"\\]'), F.regexp_replace(F.to_json(F.struct(s.alias("x"))), r'^\{"x":(.*)\}$', "$1")).otherwise(s)
            parts.append(F.when(s != "", F.concat(F.lit(n + "="), q)))
        out = F.concat_ws(" ", *parts)
    return put(fr, {p.result: out})


def put(fr: LogFrame, new: dict) -> LogFrame:
    """Columns set all at once, in place where they exist."""
    return fr.with_df(fr.df.withColumns(new))
