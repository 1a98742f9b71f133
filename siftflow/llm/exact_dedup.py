"""Exact dedup by progressive refinement: length, then hash of a prefix, then hash of the whole text.

Two texts are equal if they are identical without ASCII white space. One scan writes each row's length and prefix hash, a few
bytes a document. Lengths that occur once, then (length, prefix hash) pairs that occur once, drop out of that narrow table by
counts alone. The texts are then read again for the rows that are left, which a bit filter of bounded size finds by row number
(see common.parted): only what passes it is stripped and hashed in full, where it lies, and only the hashes travel.

A null text counts as an empty one. Of equal texts the row with the most code points before the deletion stays, then the
smallest doc_id, a null doc_id last; rows that repeat the staying row's doc_id share its verdict. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftflow.llm.common import join_groups, numbered, parted, written

SPACE = r"[\x20\x09-\x0D]+"
PREFIX = 64


def lengths(rows: DataFrame) -> DataFrame:
    """(row, doc_id, n_cp, n_norm, prefix) of (row, doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    d = rows.select("row", "doc_id", F.length(text).alias("n_cp"), F.regexp_replace(text, SPACE, "").alias("norm"))
    return d.select("row", "doc_id", "n_cp", F.octet_length("norm").alias("n_norm"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix"))


def hashed(rows: DataFrame) -> DataFrame:
    """(row, doc_id, n_cp, full_hash) of (row, doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    return rows.select("row", "doc_id", F.length(text).alias("n_cp"), F.sha2(F.regexp_replace(text, SPACE, ""), 256).alias("full_hash"))


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False, row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, full_hash (sha256 of the text without white space), row.

    full_hash is null for rows that the refinement found unique before their text was hashed, unless hash_all asks for it.
    row is row_col, which must number the rows and be the same at each reading, or else a number given here.
    """
    rows = docs.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) if row_col else numbered(docs, id_col, text_col)
    short = written(lengths(rows), "lengths")
    often = short.groupBy("n_norm").count().where("count > 1").select("n_norm")
    pairs = short.join(often, "n_norm", "left_semi").groupBy("n_norm", "prefix").count().where("count > 1").select("n_norm", "prefix")
    alive = written(short.join(pairs, ["n_norm", "prefix"], "left_semi").select("row"), "survivors")
    # a unique row that passes the filter is a group of its own, as its hash is unique too
    survivors = written(hashed(parted(rows, alive, "row")[0]), "hashed")
    best = F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    groups = survivors.groupBy("full_hash").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
    found = join_groups(survivors, groups, "full_hash", "group_size").select("doc_id", F.col("best.id").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("best.id")).alias("kept"), "full_hash", "row")
    alone = hashed(parted(rows, alive, "row")[1]) if hash_all else parted(short, alive, "row")[1].withColumn("full_hash", F.lit(None).cast("string"))
    return found.unionByName(alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "full_hash", "row"))
