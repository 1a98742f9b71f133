"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftflow.tables import forget, written  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` words once A-Z are lower-cased.
GAPS = "".join(c for c in map(chr, range(128)) if not c.isalnum())

#: Input bytes per bucket at most, where a bucket's rows must fit in a task's memory.
BUCKET_BYTES = 16 << 20


def bucket_count(docs: DataFrame) -> int:
    """spark.sql.shuffle.partitions, or more if the input is known to be larger than BUCKET_BYTES times that."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = 0 < size < 1 << 58  # a plan without statistics claims to be huge
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES) if known else 1)


def word_array(text: Column) -> Column:
    """Words with A-Z lower-cased and nothing else; null gives none. Characters are mapped one by one, as regular expressions take several times as long."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER + GAPS, LOWER + " " * len(GAPS)), " "), "")


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as literals of the plan; createDataFrame would start Python workers for it."""
    names = [(x.split()[0], x.split()[1]) for x in schema.split(", ")]
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, names)]) for r in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def shuffles(df: DataFrame) -> bool:
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def steady(docs: DataFrame) -> DataFrame:
    """docs as it is if it only scans files, whose rows come in one order; else a table of it, as rows of a shuffle may come in another order when they are read again."""
    return written(docs, "steady") if shuffles(docs) else docs


def spread(docs: DataFrame) -> DataFrame:
    """A small table in fewer pieces than there are cores, such as one file, is rewritten in as many; others stay as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if shuffles(docs) or docs._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return docs
    return written(docs.repartition(cores), "spread")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text), row being a number of the row's own, so that rows with a null or repeated id are told apart.

    It tells the row's place in the scan. What isn't a scan is written first, so a row has the same number each time it is read.
    """
    rows = steady(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")


#: Rows of the broadcast filter of parted() at most; each holds 64 bits.
FILTER_ROWS = 1 << 20


def parted(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows whose key may be in keys, a written table, and rows whose key surely is not.

    Each key sets one bit, and the bits are broadcast: at most FILTER_ROWS rows of two numbers, however many keys there are. So
    wide rows without a match needn't move to a join. More keys than the filter has room for let more rows pass than need be;
    what is done with those must not depend on it.
    """
    slots = min(FILTER_ROWS, 1 << (keys.count() // 8 + 1).bit_length())
    slot, bit = f"xxhash64({key}) & {slots - 1}L", f"cast(shiftrightunsigned(xxhash64({key}), 58) AS int)"
    bits = keys.selectExpr(f"{slot} AS __slot", f"shiftleft(1L, {bit}) AS __bit").groupBy("__slot").agg(F.bit_or("__bit").alias("__bits"))
    marked = rows.withColumn("__slot", F.expr(slot)).join(F.broadcast(bits), "__slot", "left")
    may = F.expr(f"coalesce(shiftrightunsigned(__bits, {bit}) & 1L, 0L) = 1L")
    return marked.where(may).select(rows.columns), marked.where(~may).select(rows.columns)


#: A group is heavy if it holds more than one in HEAVY rows; there can't be more than HEAVY such groups, so they may be broadcast.
HEAVY = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined with the one row of groups that has their key, where groups holds every key and its number of rows as `size`.

    The heavy groups are broadcast (at most HEAVY rows), so their rows stay where they are; the others are shuffled by key.
    """
    total = rows.count()
    heavy = F.broadcast(groups.where(F.col(size) * HEAVY > total))
    hot = rows.join(heavy, key)
    rest = rows.join(heavy.select(key), key, "left_anti").join(groups.where(F.col(size) * HEAVY <= total), key)
    return hot.unionByName(rest.select(hot.columns))
