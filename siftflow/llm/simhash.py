"""SimHash near-dedup by covering locality-sensitive hashing.

Each of the 64 bits gets a nonzero vector of F_2^3. For each of the seven nonzero v the mask of v keeps the bits whose vector
isn't orthogonal to v. Two differing bits have vectors of rank two at most, so some v is orthogonal to both: every pair of
fingerprints within two bits agrees on some mask, in all its 36 or 37 bits.

Equal fingerprints are one node, whatever their number. A mask value that two or more nodes share is a bucket. Within a
bucket nodes are not compared pair by pair: each gives itself and its neighbours at one bit outside the mask as keys. Nodes
within two bits share a key, and nodes that share a key are within two bits, as each is within one of it; a key has 65 nodes
at most. Their links go to the smallest of them, and components are found by alternating large and small stars.

A null text has no words. Rows without words have fingerprint zero and link like any other. Rows with a null doc_id get their
fingerprint and the component of that fingerprint, null if no id is in it. Repeated ids are one document. Other columns of the
input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftflow.llm.common import forget, join_groups, written

SEED, SHINGLE, BITS, RADIUS = 42, 3, 64, 2
AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-k]])
    cuts = list(zip(starts.tolist(), (ends[k - 1 :] - 1).tolist()))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(cuts), AT_ONCE):
        h = np.array([digest(joined[a:b], SEED) for a, b in cuts[at : at + AT_ONCE]], np.uint64)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(cuts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py()) if t.is_valid else 0 for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks() -> list[int]:
    """Seven masks, one for each nonzero v of F_2^3; bit i has vector 1 + i mod 7."""
    return [sum(1 << i for i in range(BITS) if ((1 + i % 7) & v).bit_count() % 2) for v in range(1, 8)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame) -> DataFrame:
    """(a, b), a > b: links between nodes (fp, node), fp distinct, that connect all pairs within two bits."""
    at = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for i, m in enumerate(masks())]
    rows = nodes.withColumn("m", F.explode(F.array(*at))).select("fp", "node", "m.i", "m.value")
    shared = rows.groupBy("i", "value").count().where("count > 1").select("i", "value")
    near = F.array(*(F.array(F.lit(0), *(F.lit(signed(1 << b)) for b in range(BITS) if not m >> b & 1)) for m in masks()))
    keys = rows.join(shared, ["i", "value"], "left_semi").select("fp", "node", F.explode(F.element_at(near, F.col("i") + 1)).alias("flip"))
    keys = keys.select(F.col("fp").bitwiseXOR(F.col("flip")).alias("key"), "node").distinct()
    stars = keys.groupBy("key").agg(F.min("node").alias("b"), F.collect_list("node").alias("all")).where(F.size("all") > 1)
    return stars.select(F.explode("all").alias("a"), "b").where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is reachable, for nodes that have links. Each round is a written table; the last one changes nothing."""
    edges, before = written(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(least, "a")
        small = written(down.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(edges)
        edges = small
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, component_id."""
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "nodes")
    found = components(links(groups.where("node IS NOT NULL").select("fp", "node")))
    groups = groups.join(found, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id"))
    return join_groups(prints, groups, "fp", "n").select("doc_id", "fp", "component_id")
