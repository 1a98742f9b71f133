"""Substring dedup by super-k-mers of words.

Windows of `width` consecutive words that share a minimiser form a run (see anchors). A window whose minimiser is unique in the
corpus is unique, which a first pass settles with hashes of minimisers alone. Every other run travels as one packed string of
its words: equal strings are merged in each task, with their number and places, then over all tasks, and one copy of each goes
to the bucket of its minimiser, where the windows of all strings are sorted and those beside an equal one, or of a string that
occurs more than once, repeat. The verdict on a string returns to its places, which never left the table they were written to.

Strings are told apart by 128 bits of their content when they are merged; windows are compared as content. Minimisers with more
than `hot_runs` different strings give their windows singly to partial counts instead, so no bucket is unbounded.

Null and empty texts have no words. Rows are judged each for themselves, whatever their doc_id, which may be null or repeated. A
text may be of any length: it is hashed in pieces. Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftflow.llm.anchors import merged_spans, shared_runs
from siftflow.llm.common import bucket_count, join_groups, numbered, parted, written

#: Words of a window, of the k-gram that is hashed for minimisers, and different runs of one minimiser from which on their windows travel singly.
WIDTH, GRAM, HOT_RUNS = 35, 8, 20_000
KNOWN_WORDS = 1_000_000
#: Bytes of packed strings that a task merges before it gives them on.
MERGED_BYTES = 32 << 20
PACKED = "key long, id binary, packed binary, n long, at array<struct<row:long,start:int>>"
VERDICT = "id binary, m long, spans array<struct<a:int,b:int>>"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_symbols(texts: pa.Array) -> Iterator[np.ndarray]:
    """bytes.split() splits at exactly the six ASCII white-space characters."""
    known = _WordHashes()
    for t in texts.cast(pa.binary()):
        words = t.as_py().split() if t.is_valid else []
        yield np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _packer(width: int):
    """From (row, text, runs) to packed strings, equal ones merged."""

    def run(batches):
        held: dict[tuple[int, bytes], tuple[bytes, list]] = {}
        size = 0

        def flush():
            items = list(held.items())
            held.clear()
            keys, ids = zip(*(k for k, _ in items))
            at = pa.array([[{"row": r, "start": a} for r, a in places] for _, (_, places) in items], pa.list_(pa.struct([("row", pa.int64()), ("start", pa.int32())])))
            cols = [pa.array(keys, pa.int64()), pa.array(ids, pa.binary()), pa.array([p for _, (p, _) in items], pa.binary()), pa.array([len(places) for _, (_, places) in items], pa.int64()), at]
            return pa.RecordBatch.from_arrays(cols, ["key", "id", "packed", "n", "at"])

        for batch in batches:
            for row, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = text.as_py().encode().split()
                for r in runs:
                    a = r["start"]
                    packed = b" ".join(words[a : a + r["nwin"] + width - 1])
                    k = r["key"], xxhash.xxh3_128_digest(packed)
                    if k not in held:
                        held[k] = packed, []
                        size += len(packed) + 200
                    held[k][1].append((row, a))
                    size += 16
                if size >= MERGED_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _windows(packed: bytes, width: int) -> list[bytes]:
    cut = [-1, *(i for i, c in enumerate(packed) if c == 32), len(packed)]
    return [packed[cut[j] + 1 : cut[j + width]] for j in range(len(cut) - width)]


def _verdicts(found: list[tuple[bytes, int, list[tuple[int, int]]]]) -> pa.RecordBatch:
    ids, m, spans = zip(*found) if found else ((), (), ())
    spans = pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(m, pa.int64()), spans], ["id", "m", "spans"])


def _counter(width: int):
    """Rows come sorted by key, each string once: a key's windows are sorted, and those beside an equal one repeat, as do all of a string that has more than one place."""

    def judged(group):
        if len(group) == 1:
            packed, i, n, m = group[0]
            return [(i, m, [(0, packed.count(b" ") + 1)])] if n > 1 else []
        again: dict[int, list] = {}
        windows = sorted((w, g, j) for g, (packed, *_) in enumerate(group) for j, w in enumerate(_windows(packed, width)))
        for x, (w, g, j) in enumerate(windows):
            if group[g][2] > 1 or x and windows[x - 1][0] == w or x + 1 < len(windows) and windows[x + 1][0] == w:
                again.setdefault(g, []).append((j, j + width))
        return [(group[g][1], group[g][3], merged_spans(np.array(s, np.int64)).tolist()) for g, s in again.items()]

    def run(batches):
        key, group = None, []
        for batch in batches:
            found = []
            for k, i, packed, n, m in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if k != key:
                    found += judged(group) if group else []
                    key, group = k, []
                group.append((packed, i, n, m))
            yield _verdicts(found)
        yield _verdicts(judged(group) if group else [])

    return run


def _singly(width: int):
    def run(batches):
        for batch in batches:
            rows = [(w, i, j, n, m) for i, packed, n, m in zip(*(batch.column(c).to_pylist() for c in range(4))) for j, w in enumerate(_windows(packed, width))]
            cols = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64()))], ["window", "id", "j", "n", "m"])

    return run


def repeated_spans(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(row, spans) of (row, text): a written table of the stretches a up to but without b, in words, that windows cover which occur more than once; a row's stretches may overlap."""
    n = bucket_count(rows)
    runs = shared_runs(rows.select("row", "text"), width, min(gram, width), word_symbols, n, "runs")
    asked = written(runs.groupBy(F.col("doc_id").alias("row")).agg(F.collect_list(F.struct("start", "nwin", "key")).alias("runs")), "asked")
    texts = parted(rows.select("row", "text"), asked, "row")[0].join(asked.hint("shuffle_hash"), "row").select("row", "text", "runs")
    packed = written(texts.mapInArrow(_packer(width), PACKED), "packed")
    kinds = written(packed.groupBy("key", "id").agg(F.first("packed").alias("packed"), F.sum("n").alias("n"), F.count("*").alias("m")), "kinds")
    crowded = kinds.groupBy("key").count().where(F.col("count") > hot_runs).select("key")
    cold = kinds.join(crowded, "key", "left_anti").select("key", "id", "packed", "n", "m").repartition(n, "key").sortWithinPartitions("key")
    verdict = cold.mapInArrow(_counter(width), VERDICT)
    if crowded.limit(1).count():
        single = kinds.join(crowded, "key", "left_semi").select("id", "packed", "n", "m").mapInArrow(_singly(width), "window binary, id binary, j int, n long, m long")
        often = single.groupBy("window").agg(F.sum("n").alias("of")).where("of > 1").select("window")
        again = single.join(often, "window").groupBy("id", "m").agg(F.collect_list(F.struct(F.col("j").alias("a"), (F.col("j") + width).alias("b"))).alias("spans"))
        verdict = verdict.unionByName(again)
    verdict = written(verdict, "verdicts")
    places = join_groups(packed.select("id", "at"), verdict, "id", "m").select(F.explode("at").alias("p"), "spans")
    moved = F.transform("spans", lambda s: F.struct((F.col("p.start") + s["a"]).alias("a"), (F.col("p.start") + s["b"]).alias("b")))
    return written(places.select("p.row", moved.alias("spans")).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")


def _cut():
    def run(batches):
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                words = text.as_py().encode().split() if text.is_valid else []
                n_words.append(len(words))
                if spans:
                    out, at = [], 0
                    for a, b in merged_spans(np.array([(s["a"], s["b"]) for s in spans], np.int64)).tolist():
                        out += words[at:a]
                        at = b
                    words = out + words[at:]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["doc_id", "kept", "n_words", "n_removed"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, kept (the remaining words, joined by one space), n_words, n_removed."""
    rows = numbered(docs, id_col, text_col)
    spans = repeated_spans(rows, **how)
    some, others = parted(rows, spans, "row")
    joined = some.join(spans.hint("shuffle_hash"), "row", "left").unionByName(others, allowMissingColumns=True)
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut(), "doc_id long, kept string, n_words long, n_removed long")
