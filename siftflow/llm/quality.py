"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

The terms of a text are its byte trigrams, its trigrams of character classes (a letter of either case, a digit, a mark, a
gap), and its words that repeat the one before; the first two kinds are hashed to a fixed number of columns. A term weighs the
root of its share of the text times its inverse document frequency, which is counted over all documents. A truncated singular
value decomposition, fitted on a bounded sample of labelled texts, gives each text a unit vector. The sample's vectors and
labels are broadcast; every document takes its exact cosine with each of them, block by block, and its NEIGHBOURS nearest vote
with their labels, weighted by similarity.

FIT_ROWS bounds what is fitted and broadcast: the labelled rows of smallest hash, at most half of it from either label.
Everything else covers all documents. A null text counts as an empty one, whose vector is zero; its score is the share of label
1 among the labelled rows fitted on. Null ids are scored, never fitted on. Repeated ids are scored each for themselves, and of their texts the smallest is fitted on; a label
repeated for an id counts once, the larger if they differ. Null labels are ignored. Without any label every score is 0.5.
Columns other than id and text are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftflow.llm.common import written

#: Labelled rows that are fitted on at most; columns of either hashed kind of term; dimensions; voters; exponent of their similarity.
FIT_ROWS, HASHED, DIMS, NEIGHBOURS, POWER = 4000, 1024, 64, 25, 8
COLUMNS = 2 * HASHED + 1
THRESHOLD = 0.3
BLOCK = 512
PIECE = 1 << 20

_CLASS = np.full(256, 31, np.uint32)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[128:] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
for _i, _c in enumerate(b".,;:!?'\"()[]{}<>|*#&$%@/\\-_="):
    _CLASS[_c] = 5 + _i % 26
_R = np.random.default_rng(7)
_SHAPE = _R.integers(0, HASHED, 32 * 32 * 32).astype(np.int64)


def term_counts(raw: bytes) -> np.ndarray:
    """Counts of a text's terms by column; a text of any length is counted in pieces."""
    out = np.zeros(COLUMNS, np.float64)
    for at in range(0, max(len(raw) - 2, 0), PIECE):
        b = np.frombuffer(raw, np.uint8, count=min(PIECE + 2, len(raw) - at), offset=at)
        c = _CLASS[b]
        out[:HASHED] += np.bincount(_SHAPE[(c[:-2] << np.uint32(10)) | (c[1:-1] << np.uint32(5)) | c[2:]], minlength=HASHED)
        u = b.astype(np.uint32)
        h = ((u[:-2] << np.uint32(16)) | (u[1:-1] << np.uint32(8)) | u[2:]) * np.uint32(2654435761) >> np.uint32(22)
        out[HASHED : 2 * HASHED] += np.bincount(h.astype(np.int64), minlength=HASHED)
    words = raw.split()
    out[-1] = sum(map(bytes.__eq__, words, words[1:]))
    return out


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts to rows of weights: each kind of term by its share within its kind."""
    x = np.empty(counts.shape, np.float32)
    total = np.maximum(counts[:, :HASHED].sum(1, keepdims=True), 1)
    x[:, :HASHED] = np.sqrt(counts[:, :HASHED] / total)
    x[:, HASHED : 2 * HASHED] = 0.5 * np.sqrt(counts[:, HASHED : 2 * HASHED] / total)
    x[:, -1:] = 2 * np.sqrt(np.minimum(counts[:, -1:] * 6 / total, 1))
    return x * idf


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """idf, the map to latent dimensions, and the labelled vectors; at most FIT_ROWS x DIMS numbers and a fixed matrix."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, idf: np.ndarray, dims: int = DIMS, neighbours: int = NEIGHBOURS, power: float = POWER):
        x = weighed(counts, idf)
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.idf, self.map = idf, np.ascontiguousarray(vectors[:, ::-1][:, :dims].astype(np.float32))
        self.vectors, self.labels = unit(x @ self.map), labels.astype(np.float32)
        self.base, self.k, self.power = float(labels.mean()) if len(labels) else 0.5, min(neighbours, len(labels)), power

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not self.k:
            return np.full(len(counts), 0.5)
        v = unit(weighed(counts, self.idf) @ self.map)
        out = np.empty(len(v))
        for at in range(0, len(v), BLOCK):
            s = v[at : at + BLOCK] @ self.vectors.T
            near = np.argpartition(-s, self.k - 1, axis=1)[:, : self.k]
            w = np.maximum(np.take_along_axis(s, near, 1), 0).astype(np.float64) ** self.power
            total = w.sum(1)
            out[at : at + BLOCK] = np.where(total > 0, (w * self.labels[near]).sum(1) / np.maximum(total, 1e-300), self.base)
        return out


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """How many documents hold each term, and how many there are; sums are made per task, then per column."""

    def run(batches):
        df, n = np.zeros(COLUMNS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                df += term_counts(t.as_py() if t.is_valid else b"") > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(COLUMNS + 1, dtype=np.int32)), pa.array(np.append(df, n))], ["col", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "col int, n long").groupBy("col").agg(F.sum("n").alias("n")).collect()  # COLUMNS + 1 rows
    out = np.zeros(COLUMNS + 1, np.int64)
    for r in rows:
        out[r.col] = r.n
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, **how) -> Model:
    """labels (id_col, label_col 0 or 1) must hold only rows that may be learnt from."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).alias("label"))
    some = None
    for y in (0, 1):
        part = known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows // 2)
        some = part if some is None else some.unionByName(part)
    some = written(some, "fitted_on")  # at most fit_rows rows of two numbers

    def run(batches):
        for batch in batches:
            counts = [term_counts(t.as_py() if t.is_valid else b"").astype(np.float32).tobytes() for t in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.binary()), batch.column(1)], ["counts", "label"])

    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = held.select("text", F.col("label").cast("int")).mapInArrow(run, "counts binary, label int").collect()
    df, n = document_frequencies(docs, text_col)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    counts = np.frombuffer(b"".join(bytes(r.counts) for r in rows), np.float32).reshape(-1, COLUMNS)
    return Model(counts, np.array([r.label for r in rows]), idf, **how)


def score_of(model: Model, spark: SparkSession, text: Column) -> Column:
    """The score of a text as a column; the model travels once to each executor."""
    shared = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        texts, scores = texts.cast(pa.binary()), []
        for at in range(0, len(texts), BLOCK):
            scores.append(shared.value.score(np.stack([term_counts(t.as_py() if t.is_valid else b"") for t in texts[at : at + BLOCK]])))
        return pa.array(np.concatenate(scores) if scores else np.zeros(0))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(text)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 if score is at least the threshold)."""
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), score_of(model, docs.sparkSession, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
