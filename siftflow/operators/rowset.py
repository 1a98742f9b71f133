"""Operators on sets of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftflow.frame import LogFrame, c
from siftflow.functions.values import as_str
from siftflow.lang import ir
from siftflow.operators.filters import condition
from siftflow.tables import written


def ordered(p: ir.Sort, fr: LogFrame) -> list:
    """Sort columns; the pipe's own desc turns each field's direction."""
    keys = p.by or tuple((f, False) for f in sorted(fr.columns))
    return [fr.order(f).desc() if d != p.desc else fr.order(f).asc() for f, d in keys]


def sort(p: ir.Sort, fr: LogFrame) -> LogFrame:
    order = ordered(p, fr)
    if p.partition:
        w = Window.partitionBy(*[fr.key(f) for f in p.partition]).orderBy(*order)
        df = fr.df.withColumn("__n", F.row_number().over(w)).where((F.col("__n") > p.offset) & (F.col("__n") <= p.offset + p.limit))
        # the rank is the place among the rows of the partition
        df = df.withColumn(p.rank, F.col("__n").cast("long")) if p.rank else df
        return fr.with_df(df.drop("__n"))
    df = fr.df.orderBy(*order)
    if p.limit is not None:
        df = df.limit(min(p.offset + p.limit, 2**31 - 1))  # TakeOrderedAndProject: no full sort
    if p.rank and p.limit is not None:
        # the rows are few, so numbering them in one partition is cheap
        df = df.withColumn(p.rank, F.row_number().over(Window.orderBy(*order)).cast("long"))
        df = df.where(c(p.rank) > p.offset).orderBy(p.rank) if p.offset else df.orderBy(c(p.rank))
        return fr.with_df(df)
    if p.rank:
        df = ranked_in_parallel(fr.df, order, p.rank, 0)
        return fr.with_df(df.where(c(p.rank) > p.offset) if p.offset else df)
    return fr.with_df(df.offset(p.offset) if p.offset else df)


def ranked_in_parallel(df: DataFrame, order: list, rank: str, offset: int) -> DataFrame:
    """Places in the whole order without one big partition: a place in its range partition, plus the rows of those before.

    The partitioned rows are a written table, as another run could draw other boundaries.
    """
    parts = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    placed = written(parts.withColumn("__r", own), "ranked")
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__s"))  # one row per partition
    before = sizes.withColumn("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__b")
    return placed.join(F.broadcast(before), "__p").withColumn(rank, F.col("__r") + F.col("__b") + offset).drop("__p", "__r", "__b").orderBy(c(rank))


def limit(p: ir.Limit, fr: LogFrame) -> LogFrame:
    return fr.with_df(fr.df.limit(min(p.n, 2**31 - 1)))


def offset(p: ir.Offset, fr: LogFrame) -> LogFrame:
    """All rows but the first n, in their order. Each partition is written with the places of its rows, and the rows of those before are counted, so no task gets all rows."""
    if not p.n:
        return fr
    placed = written(fr.df.withColumn("__m", F.monotonically_increasing_id()), "offset")
    part = F.shiftright("__m", 33).alias("__p")
    sizes = placed.groupBy(part).agg(F.count("*").alias("__s"))  # one row per partition
    before = F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("__p", part).join(F.broadcast(sizes.select("__p", before.alias("__b"))), "__p")
    rest = placed.where(F.col("__b") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) >= p.n)
    return fr.with_df(rest.orderBy("__m").select(*[c(x) for x in fr.df.columns]))


def by_or_all(fr: LogFrame, by) -> list[str]:
    return list(by) if by else list(fr.columns)


def uniq(p: ir.Uniq, fr: LogFrame) -> LogFrame:
    """Distinct tuples. Beyond the limit an arbitrary subset stays, and its hits are 0, as they can't be trusted."""
    by = by_or_all(fr, p.by)
    keys = [fr.key(f).alias(f) for f in by]
    if not p.hits:
        df = fr.df.select(*keys).distinct()
        return fr.with_df(df.limit(p.limit) if p.limit else df)
    df = fr.df.groupBy(*keys).agg(F.count("*").alias(p.hits))
    if p.limit:
        more = df.limit(p.limit + 1).agg(F.count("*").alias("__n"))
        df = df.limit(p.limit).withColumn("__one", F.lit(1)).join(more.withColumn("__one", F.lit(1)), "__one").withColumn(p.hits, F.when(F.col("__n") > p.limit, F.lit(0)).otherwise(c(p.hits)).cast("long")).drop("__n", "__one")
    return fr.with_df(df)


def top(p: ir.Top, fr: LogFrame) -> LogFrame:
    """Most hits first, equal hits by the keys ascending."""
    by = by_or_all(fr, p.by)
    order = [c(p.hits).desc(), *[c(f).asc() for f in by]]
    df = fr.df.groupBy(*[fr.key(f).alias(f) for f in by]).agg(F.count("*").alias(p.hits)).orderBy(*order).limit(p.n)
    if p.rank:
        df = df.withColumn(p.rank, F.row_number().over(Window.orderBy(*order)).cast("long")).orderBy(c(p.rank))
    return fr.with_df(df)


def facets(p: ir.Facets, fr: LogFrame) -> LogFrame:
    """The top values of each field, with their hits. Fields with too many or too long values go, and constant ones."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), fr.text(n).alias("field_value")) for n in fr.columns]))
    hits = fr.df.select(pairs.alias("x")).select("x.*").where("field_value != ''").groupBy("field_name", "field_value").agg(F.count("*").alias("hits"))
    stat = hits.groupBy("field_name").agg(F.count("*").alias("n"), F.max(F.octet_length("field_value")).alias("longest"), F.sum("hits").alias("filled"))
    good = stat.where((F.col("n") <= p.max_values) & (F.col("longest") <= p.max_len))
    if not p.keep_const:  # constant: one value, in every row
        total = fr.df.agg(F.count("*").alias("rows")).withColumn("one", F.lit(1))
        good = good.withColumn("one", F.lit(1)).join(total, "one").where("n > 1 OR filled < rows")
    kept = hits.join(F.broadcast(good.select("field_name")), "field_name")  # a row per field
    w = Window.partitionBy("field_name").orderBy(F.desc("hits"), "field_value")
    return fr.with_df(kept.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= p.n).drop("__r"))


def field_values(p: ir.FieldValues, fr: LogFrame) -> LogFrame:
    return uniq(ir.Uniq((p.of,), "hits", p.limit), fr)


def join(p: ir.Join, fr: LogFrame, right: LogFrame) -> LogFrame:
    """Left or inner; Spark's statistics choose how, and nothing is broadcast by hint. Missing keys are '' and match each other. The left row's own values win over the right's."""
    keys = []
    for k in p.by:
        a, b = fr.type(k), right.type(k)
        same = a == b and fr.has(k) and right.has(k)
        keys.append((fr.key(k), right.key(k)) if same else (fr.text(k), right.text(k)))
    names = [n for n in right.columns if n not in p.by]
    r = right.df.select(*[b.alias(f"__k{i}") for i, (_, b) in enumerate(keys)], *[right.col(n).alias(f"__v{i}") for i, n in enumerate(names)])
    on = [a.eqNullSafe(F.col(f"__k{i}")) for i, (a, _) in enumerate(keys)]
    df = fr.df.join(r, on, "inner" if p.inner else "left")
    new = {}
    for i, n in enumerate(names):
        to, x = p.prefix + n, F.col(f"__v{i}")
        if not fr.has(to):
            new[to] = x
        elif fr.type(to) == right.type(n):
            new[to] = F.when(fr.filled(to), fr.col(to)).otherwise(x)
        else:
            new[to] = F.when(fr.filled(to), fr.text(to)).otherwise(as_str(x, right.type(n)))
    return fr.with_df(df.withColumns(new).drop(*[f"__k{i}" for i in range(len(keys))], *[f"__v{i}" for i in range(len(names))]))


def union(fr: LogFrame, other: LogFrame) -> LogFrame:
    """All rows of both; a column that one side lacks is missing there, and columns of two types become text."""
    a, b = fr, other
    clash = [n for n in a.columns if n in b.types and a.types[n] != b.types[n]]
    if clash:
        a = a.with_df(a.df.withColumns({n: F.when(a.filled(n), a.text(n)) for n in clash}))
        b = b.with_df(b.df.withColumns({n: F.when(b.filled(n), b.text(n)) for n in clash}))
    return fr.with_df(a.df.unionByName(b.df, allowMissingColumns=True))


DELIMITER = "---"


def stream_context(p: ir.StreamContext, fr: LogFrame, f: ir.Filter) -> LogFrame:
    """Rows of the whole log that lie up to before and after rows from a matching row of their stream, within the time window.

    Overlapping stretches are one; a delimiter row follows each stretch of a stream but the last.
    """
    by = [fr.text(s) for s in fr.stream] or [fr.text(ir.STREAM)]
    t = F.unix_micros(fr.col(ir.TIME).cast("timestamp"))
    tie = [F.col(ir.MSG)] if ir.MSG in fr.types else []
    base = fr.df.withColumn("__hit", condition(f, fr)).withColumn("__t", t).withColumns({f"__s{i}": x for i, x in enumerate(by)})
    part = [F.col(f"__s{i}") for i in range(len(by))]
    w = Window.partitionBy(*part).orderBy("__t", *tie)
    df = base.withColumn("__n", F.row_number().over(w))
    hit = F.when(F.col("__hit"), F.struct("__n", "__t"))
    up = w.rowsBetween(-p.after, 0) if p.after < 2**30 else w.rowsBetween(Window.unboundedPreceding, 0)
    down = w.rowsBetween(0, p.before) if p.before < 2**30 else w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("__last", F.last(hit, ignorenulls=True).over(up)).withColumn("__next", F.first(hit, ignorenulls=True).over(down))
    near = (F.col("__t") - F.col("__last.__t") <= p.window) | (F.col("__next.__t") - F.col("__t") <= p.window)
    kept = df.where(F.coalesce(near, F.lit(False)))
    ends = kept.withColumn("__gap", F.lead("__n").over(w) - F.col("__n") > 1)
    out = ends.withColumn("__mark", F.explode(F.when(F.col("__gap"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    keep = set(fr.stream) | {ir.TIME, ir.STREAM, ir.STREAM_ID}
    cols = []
    for x in fr.df.columns:
        delimiter = F.lit(DELIMITER) if x == ir.MSG and isinstance(fr.type(x), T.StringType) else c(x) if x in keep else F.lit(None)
        cols.append(F.when(F.col("__mark"), delimiter).otherwise(c(x)).alias(x))
    return fr.with_df(out.select(*cols))


def block_stats(fr: LogFrame) -> LogFrame:
    """Per partition of the plan and field: rows, and bytes of text; physical facts, which differ from run to run."""
    d = fr.df.withColumn("block", F.spark_partition_id())
    names = fr.columns
    sums = d.groupBy("block").agg(F.count("*").alias("rows"), *[F.sum(F.octet_length(fr.text(n))).alias(f"b{i}") for i, n in enumerate(names)])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"b{i}").alias("values_bytes")) for i, n in enumerate(names)]))
    return fr.with_df(sums.select("block", "rows", rows.alias("x")).select(F.col("x.field"), F.col("block"), F.col("x.values_bytes"), F.col("rows")))


def blocks_count(p: ir.BlocksCount, fr: LogFrame) -> LogFrame:
    return fr.with_df(fr.df.select(F.spark_partition_id().alias("__p")).agg(F.count_distinct("__p").alias(p.result)))
