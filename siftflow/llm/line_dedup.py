"""Line dedup by overlapping three-line windows.

A window is three consecutive lines of one text, split at line feeds. Windows are hashed with 128 bits; of equal windows the
one at the smallest (doc_id, line) stays, and the lines that the others cover are removed, overlapping ones merged.

Native: DataFrame functions only. The first place of each repeated window is found with partial minima; windows that more
than one in HEAVY rows hold are joined back by a broadcast (see join_groups), the others by a shuffle.

A null text has no lines and an empty one has one. Texts of fewer than three lines lose nothing. A null doc_id is returned with
its text as it is and counts for no other document. Of rows that repeat a doc_id neither comes first, so they lose nothing to
each other; the lines found for an id are removed from all its rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftflow.llm.common import join_groups, written

WINDOW = 3


def line_windows(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(doc_id, pos, h) of every window."""
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.split(F.col(text_col), "\n").alias("l"))
    hashed = F.expr(f"transform(sequence(0, size(l) - {window}), i -> unhex(md5(array_join(slice(l, i + 1, {window}), '\n'))))")
    return lines.where(F.size("l") >= window).select("doc_id", F.posexplode(hashed).alias("pos", "h"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, kept (the remaining lines joined by line feeds), n_lines, n_removed."""
    places = line_windows(docs, id_col, text_col, window)
    often = places.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    often = written(often, "repeated_windows")
    rows = written(places.join(often.select("h"), "h", "left_semi"), "window_places")
    later = join_groups(rows, often, "h", "n").where(F.struct("doc_id", "pos") > F.col("first"))
    starts = later.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("s"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    joined = texts.join(starts.hint("shuffle_hash"), "doc_id", "left").withColumn("l", F.coalesce(F.split("text", "\n"), F.array().cast("array<string>")))
    # the first and the last window of each stretch of windows that overlap or touch, then the lines between the stretches
    spans = joined.withColumn("a", F.expr(f"filter(s, (x, i) -> i = 0 or x - s[greatest(i - 1, 0)] > {window})"))
    spans = spans.withColumn("b", F.expr(f"transform(filter(s, (x, i) -> i = size(s) - 1 or s[least(i + 1, size(s) - 1)] - x > {window}), x -> x + {window})"))
    gaps = "zip_with(concat(array(0), b), concat(a, array(size(l))), (f, t) -> slice(l, f + 1, t - f))"
    kept = spans.withColumn("k", F.when(F.col("s").isNull(), F.col("l")).otherwise(F.expr(f"flatten({gaps})")))
    return kept.select("doc_id", F.array_join("k", "\n").alias("kept"), F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size("k")).cast("long").alias("n_removed"))
