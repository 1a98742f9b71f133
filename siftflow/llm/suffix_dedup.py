"""Suffix-array dedup of bytes: removes what a string of `width` bytes covers that also starts earlier.

A full suffix array holds a suffix per byte. This one is sparse: it holds one suffix per super-k-mer (see anchors), the one
that starts at the run's minimiser, and only for runs that can hold a window of another, different run; equal runs are merged
before. Sampled splitters range-partition the suffixes by their leading k bytes, so suffixes that can share a window are in
one bucket and none straddles a boundary. A bucket sorts them by multikey quicksort on eight-byte symbols and takes the common
prefix of neighbours; the same is done to the bytes before the anchors, read backwards. Two windows with o bytes before the
anchor are equal exactly if their left parts share o bytes and their right parts share width - o, so for each o equal windows
are equal pairs of classes, and the first of each class pair in (doc_id, start) order stays.

Where one minimiser has very many different runs, its windows become suffixes of their own, are grouped by content with
partial minima and joined back, so no bucket is unbounded.

Null and empty texts have no bytes; texts shorter than a window lose nothing. A null doc_id is returned whole and counts for no
other document. Of rows that repeat a doc_id neither starts earlier, so they lose nothing to each other. Other columns of the
input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftflow.llm.anchors import HOT, LOW, REPEATED, gram_hashes, judged_runs, merged_spans, mixed
from siftflow.llm.common import bucket_count, parted, written

#: Bytes of a window, of the k-gram that is hashed for minimisers, and different runs of one minimiser from which on their windows travel singly.
WIDTH, GRAM, HOT_RUNS = 100, 24, 50_000
TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
SUFFIX = "lead binary, content binary, anchor int, doc_id long, start int, nwin int, hot boolean"
SPAN = "doc_id long, start int, stop int"
SORTED_AT_ONCE = 50_000


def byte_symbols(texts: pa.Array) -> Iterator[np.ndarray]:
    for t in texts.cast(pa.binary()):
        yield TABLE[np.frombuffer(t.as_py(), np.uint8)] if t.is_valid else TABLE[:0]


def _suffixes(width: int, k: int):
    """From (doc_id, text, runs) to suffixes. The anchor of a run is found again as the place its first and last window share."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, text, runs in zip(batch.column(0), batch.column(1), batch.column(2)):
                if not runs.is_valid or not text.is_valid:
                    continue
                raw, doc = text.as_py().encode(), doc.as_py()
                for r in runs.as_py():
                    a, n = r["start"], r["nwin"]
                    content = raw[a : a + n + width - 1]
                    if r["role"] == HOT:
                        rows = [(content[j : j + width], content[j : j + width], 0, doc, a + j, 1, True) for j in range(n)]
                    else:
                        grams = gram_hashes(TABLE[np.frombuffer(content, np.uint8)], k)[n - 1 : width - k + 1]
                        o = int(np.argmin(grams & ~LOW)) + n - 1
                        rows = [(content[o : o + k], content, o, doc, a, n, False)]
                    for row in rows:
                        for c, v in zip(cols, row):
                            c.append(v)
            kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["lead", "content", "anchor", "doc_id", "start", "nwin", "hot"])

    return run


def multikey_order(symbols: np.ndarray) -> np.ndarray:
    """Order of the rows of symbols by their columns, by quicksort on one column at a time, of ties on the columns before only."""
    order = np.argsort(symbols[:, 0], kind="stable")
    tied = np.zeros(len(order), bool)
    same = symbols[order[1:], 0] == symbols[order[:-1], 0]
    for c in range(1, symbols.shape[1]):
        tied[:] = False
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not at.size:
            break
        group = np.cumsum(np.concatenate([[True], ~same]))[at]
        sub = order[at]
        sub = sub[np.lexsort((symbols[sub, c], group))]
        order[at] = sub
        same &= symbols[order[1:], c] == symbols[order[:-1], c]
    return order


def _sorted_prefixes(parts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the parts, cut or padded to size bytes, and how many bytes each shares with the one before it."""
    room = -(-size // 8) * 8
    flat = np.frombuffer(b"".join(p[:size].ljust(room, b"\0") for p in parts), np.uint8).reshape(len(parts), room)
    order = multikey_order(flat.view(">u8").astype(np.uint64))
    differ = flat[order[1:]] != flat[order[:-1]]
    shared = np.where(differ.any(1), differ.argmax(1), room)
    return order, np.concatenate([[0], shared])


def later_windows(rows: list[tuple[bytes, int, int, int, int]], width: int, k: int) -> np.ndarray:
    """For rows (content, anchor, doc_id, start, windows): which windows also start earlier, as a matrix by row and offset of the anchor in the window."""
    content, anchor, doc, start, nwin = zip(*rows)
    anchor, doc, start, nwin = (np.array(c, np.int64) for c in (anchor, doc, start, nwin))
    n, out = len(rows), np.zeros((len(rows), width - k + 1), bool)
    right, share_r = _sorted_prefixes([c[o:] for c, o in zip(content, anchor.tolist())], width)
    left, share_l = _sorted_prefixes([c[:o][::-1] for c, o in zip(content, anchor.tolist())], width - k)
    early = np.lexsort((start + anchor, doc))
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(width - k + 1):
        rows_o = early[((anchor - nwin + 1 <= o) & (o <= anchor))[early]]
        if len(rows_o) < 2:
            continue
        class_r[right] = np.cumsum(share_r < width - o)
        class_l[left] = np.cumsum(share_l < o)
        pair = class_r[rows_o] * (n + 1) + class_l[rows_o]
        by = np.argsort(pair, kind="stable")
        again = rows_o[by[1:]], rows_o[by[:-1]]
        first = np.concatenate([[True], pair[by[1:]] != pair[by[:-1]]])
        head = rows_o[by][np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))][1:]
        later = ~first[1:] & ((doc[again[0]] != doc[head]) | (start[again[0]] + anchor[again[0]] != start[head] + anchor[head]))
        out[again[0][later], o] = True
    return out


def _bucket(width: int, k: int):
    """Rows come sorted by lead; whole leads are taken together, about SORTED_AT_ONCE suffixes at a time."""

    def judged(rows):
        found = later_windows(rows, width, k)
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, a = np.nonzero(edge == 1)
        b = np.nonzero(edge == -1)[1]  # offsets from a up to but without b
        at = np.array([r[3] + r[1] for r in rows], np.int64)[i]
        doc = np.array([r[2] for r in rows], np.int64)[i]
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array((at - b + 1).astype(np.int32)), pa.array((at - a + width).astype(np.int32))], ["doc_id", "start", "stop"])

    def run(batches):
        rows, lead, last = [], None, 0
        for batch in batches:
            for now, content, anchor, doc, start, nwin in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if now != lead:
                    if len(rows) - last == 1:
                        rows.pop()  # alone with its lead: it shares no window
                    if len(rows) >= SORTED_AT_ONCE:
                        yield judged(rows)
                        rows = []
                    lead, last = now, len(rows)
                rows.append((content, anchor, doc, start, nwin))
        if rows:
            yield judged(rows)

    return run


def later_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, start, stop) in bytes, from start up to but without stop: covered by strings that also start earlier; spans may overlap."""
    gram = min(gram, width)
    n = bucket_count(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    runs = judged_runs(docs, width, gram, byte_symbols, True, hot_runs, n, "strings")
    whole = runs.where(F.col("role") == REPEATED).select("doc_id", "start", (F.col("start") + F.col("nwin") + width - 1).cast("int").alias("stop"))
    asked = written(runs.where(F.col("role") != REPEATED).groupBy("doc_id").agg(F.collect_list(F.struct("start", "nwin", "key", "role")).alias("runs")), "asked")
    # written, as sampling the splitters reads them once and sorting once more
    suffixes = written(parted(docs, asked, "doc_id")[0].join(asked.hint("shuffle_hash"), "doc_id").mapInArrow(_suffixes(width, gram), SUFFIX), "suffixes")
    cold = suffixes.where(~F.col("hot")).drop("hot").repartitionByRange(n, "lead").sortWithinPartitions("lead")
    found = whole.unionByName(cold.mapInArrow(_bucket(width, gram), SPAN))
    if runs.where(F.col("role") == HOT).limit(1).count():
        single = suffixes.where("hot").select("content", "doc_id", "start")
        first = single.groupBy("content").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        later = single.join(first, "content").where(F.struct("doc_id", "start") > F.col("first"))
        found = found.unionByName(later.select("doc_id", "start", (F.col("start") + width).cast("int").alias("stop")))
    return found


def _cut():
    def run(batches):
        for batch in batches:
            kept, n_bytes, n_removed, n_spans = [], [], [], []
            for text, starts, stops in zip(*(batch.column(i) for i in (1, 2, 3))):
                raw = text.as_py().encode() if text.is_valid else b""
                spans = np.zeros((0, 2), np.int64)
                left = raw
                if starts.is_valid:
                    spans = np.minimum(merged_spans(np.stack([np.array(starts.as_py(), np.int64), np.array(stops.as_py(), np.int64)], 1)), len(raw))
                    cuts = [0, *spans.ravel().tolist(), len(raw)]
                    left = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                kept.append(left)
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(left))
                n_spans.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans))], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return run


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, kept (the remaining bytes; a cut may split a character), n_bytes, n_removed, n_spans."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spans = written(later_spans(docs, id_col, text_col, **how).groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")), "spans")
    some, others = parted(texts, spans, "doc_id")
    joined = some.join(spans.hint("shuffle_hash"), "doc_id", "left").unionByName(others, allowMissingColumns=True)
    return joined.select("doc_id", "text", "starts", "stops").mapInArrow(_cut(), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
