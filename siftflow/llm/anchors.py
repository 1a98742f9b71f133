"""Super-k-mers: maximal runs of windows that share the position of their minimiser.

A symbol is a byte or a word, a window is `width` consecutive symbols of one document. The minimiser of a window is its
k-gram of smallest hash, the leftmost of equal ones. It depends on the window's content alone, so equal windows have equal
minimisers: windows whose minimiser is unique in the corpus are unique, and only the others need to be compared. Windows of
one run differ from each other, as they hold their common minimiser at different offsets.

Runs travel first as records of hashes (of the minimiser, and two of the whole run) and their place. Those records are packed
into one compressed block per bucket and batch, after equal runs of the batch were merged, so a run that a third of all
documents share crosses the network once per batch. Only runs whose minimiser also occurs in another, different run go on to
a comparison of their real content.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftflow.llm.common import written

#: Symbols that are hashed in one go, and runs that are merged before they are sent.
CHUNK, FLUSH = 1 << 18, 1 << 20
POS_BITS = np.uint64(24)
LOW = np.uint64((1 << 24) - 1)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE, BASE2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
BLOCK = "bucket int, kind int, payload binary"
RUN = "doc_id long, start int, nwin int, key long, role int"
#: role of a run: REPEATED needs no comparison, COMPARE holds windows that may occur in other runs, HOT is COMPARE for a minimiser with very many different runs.
REPEATED, COMPARE, HOT = 0, 1, 2


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        _POWERS[base] = powers(base, n), powers(pow(base, -1, 1 << 64), n)
    return _POWERS[base]


def gram_hashes(sym: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols from each place on; the last k - 1 places have none."""
    parts, size, h, at = [], 1, sym, 0
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            parts.append((at, size, h))
            at += size
        if k >> (bit + 1):
            c = np.uint64(pow(BASE, size, 1 << 64))
            h = h[:-size] * c + h[size:] if len(h) > size else h[:0]
            size *= 2
    n = len(sym) - k + 1
    out = np.zeros(n, np.uint64)
    for at, size, h in parts:
        out *= np.uint64(pow(BASE, size, 1 << 64))
        out += h[at : at + n]
    return mixed(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    if size < w:
        x = np.minimum(x[: -(w - size)], x[w - size :])
    return x


def runs_of(sym: np.ndarray, lens: np.ndarray, width: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of the documents whose symbols lie one after the other in sym: piece, start in it, windows, hash of the minimiser, two hashes of the run that are independent of it and of each other."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    if len(sym) < width:
        return none
    ends = np.cumsum(lens)
    full = lens >= width
    count = np.where(full, lens - width + 1, 0)
    total = int(count.sum())
    if not total:
        return none
    first = np.cumsum(count) - count
    idx = np.arange(total) + np.repeat(ends - lens - first, count)
    grams = gram_hashes(sym, k)
    marked = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(marked, width - k + 1)[idx] & LOW).astype(np.int64)
    new = np.empty(total, bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    new[1:] |= idx[1:] != idx[:-1] + 1
    s = np.flatnonzero(new)
    a, nwin = idx[s], np.diff(np.append(s, total))
    e, wholes = a + nwin + width - 1, []
    for base, shift in ((BASE, M2), (BASE2, M1)):
        up, down = _tables(base, max(len(sym) + 1, CHUNK * 2 + 4096))
        total_hash = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(sym + shift) * up[: len(sym)])])
        wholes.append(mixed(((total_hash[e] - total_hash[a]) * down[a]) ^ (nwin.astype(np.uint64) * M1)))
    piece = np.searchsorted(ends, a, side="right")
    return piece, a - (ends - lens)[piece], nwin, grams[at[s]], *wholes


def pack(cols: list[np.ndarray], z: zstandard.ZstdCompressor) -> bytes:
    return len(cols[0]).to_bytes(4, "little") + z.compress(b"".join(c.tobytes() for c in cols))


def unpack(blob: bytes, kinds: list[str], z: zstandard.ZstdDecompressor) -> list[np.ndarray]:
    n, raw, out, at = int.from_bytes(blob[:4], "little"), z.decompress(blob[4:]), [], 0
    for t in kinds:
        size = n * np.dtype(t).itemsize
        out.append(np.frombuffer(raw[at : at + size], t))
        at += size
    return out


LEAD, REST = ["i8", "u4", "u4", "u8", "u8", "u8", "u1"], ["i8", "u4", "u4", "u8"]


def record_blocks(width: int, k: int, buckets: int, symbols: Callable[[pa.Array], Iterator[np.ndarray]], once: bool):
    """A mapInArrow function from (doc_id, text) to blocks of records. once: equal places of a run count once."""

    def run(batches):
        # the blocks of repeats go round the buckets, from another one in each task
        z, held, n_held, turn = zstandard.ZstdCompressor(1), [], 0, zlib.crc32(b"%d" % TaskContext.get().partitionId())

        def flush():
            nonlocal turn
            doc, start, nwin, key, whole, other = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((start, doc, other, whole, key))
            doc, start, nwin, key, whole, other = (c[order] for c in (doc, start, nwin, key, whole, other))
            lead = np.empty(len(key), bool)
            lead[0] = True
            lead[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1]) | (other[1:] != other[:-1])
            at = np.flatnonzero(lead)
            many = np.diff(np.append(at, len(key))) > 1
            rest = ~lead
            if once:
                rest[1:] &= (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])
            b, kinds, blobs = [], [], []
            bucket = (key[at] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for i in range(buckets):
                if (rows := at[by[cuts[i] : cuts[i + 1]]]).size:
                    b.append(i)
                    kinds.append(0)
                    blobs.append(pack([doc[rows], start[rows].astype("u4"), nwin[rows].astype("u4"), key[rows], whole[rows], other[rows], many[by[cuts[i] : cuts[i + 1]]].astype("u1")], z))
            if rest.any():
                b.append(turn % buckets)
                kinds.append(1)
                blobs.append(pack([doc[rest], start[rest].astype("u4"), nwin[rest].astype("u4"), key[rest]], z))
                turn += 7
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "payload"])

        def hashed(syms, docs, bases):
            nonlocal n_held
            lens = np.array([len(s) for s in syms], np.int64)
            piece, start, nwin, key, whole, other = runs_of(np.concatenate(syms), lens, width, k)
            if piece.size:
                held.append((np.array(docs, np.int64)[piece], start + np.array(bases, np.int64)[piece], nwin, key, whole, other))
                n_held += piece.size

        for batch in batches:
            ids = batch.column(0).to_pylist()
            syms, docs, bases, size = [], [], [], 0
            for doc, sym in zip(ids, symbols(batch.column(1))):
                if doc is None or len(sym) < width:
                    continue
                for base in range(0, len(sym) - width + 1, CHUNK):
                    part = sym[base : base + CHUNK + width - 1]
                    syms.append(part)
                    docs.append(doc)
                    bases.append(base)
                    size += len(part)
                    if size >= CHUNK:
                        hashed(syms, docs, bases)
                        syms, docs, bases, size = [], [], [], 0
                        if n_held >= FLUSH:
                            yield flush()
                            n_held = 0
            if syms:
                hashed(syms, docs, bases)
        if held:
            yield flush()

    return run


def judge_blocks(once: bool, hot: int, settle: bool = True):
    """A mapInArrow function from the blocks of one bucket to runs that repeat or need a comparison.

    settle: equal runs are REPEATED by their hashes. Otherwise every place of a run whose minimiser isn't unique is to COMPARE.
    """

    def out(doc, start, nwin, key, role):
        return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(nwin.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(role.astype(np.int32))], ["doc_id", "start", "nwin", "key", "role"])

    def run(batches):
        z, leads = zstandard.ZstdDecompressor(), []
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2)):
                if kind:
                    doc, start, nwin, key = unpack(blob.as_py(), REST, z)
                    yield out(doc, start, nwin, key, np.full(len(doc), REPEATED if settle else COMPARE))
                else:
                    leads.append(unpack(blob.as_py(), LEAD, z))
        if not leads:
            return
        cols = [np.concatenate(c) for c in zip(*leads)]
        leads.clear()
        order = np.lexsort((cols[1], cols[0], cols[5], cols[4], cols[3]))
        doc, start, nwin, key, whole, other, many = (c[order] for c in cols)
        n = len(key)
        new_key, new_run = np.ones(n, bool), np.ones(n, bool)
        new_key[1:] = key[1:] != key[:-1]
        new_run[1:] = new_key[1:] | (whole[1:] != whole[:-1]) | (other[1:] != other[:-1])
        run_id, key_id = np.cumsum(new_run) - 1, np.cumsum(new_key) - 1
        size = np.bincount(run_id, weights=1 + many)  # a run that was merged before it was sent counts as two at least
        different = np.bincount(key_id[new_run])
        if not settle:
            shared = (different[key_id] > 1) | (size[run_id] > 1)
            yield out(doc[shared], start[shared], nwin[shared], key[shared], np.full(int(shared.sum()), COMPARE))
            return
        if once:
            repeated = ~new_run
            repeated[1:] &= (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])
        else:
            repeated = size[run_id] > 1
        compare = new_run & (different[key_id] > 1)
        yield out(doc[repeated], start[repeated], nwin[repeated], key[repeated], np.full(int(repeated.sum()), REPEATED))
        yield out(doc[compare], start[compare], nwin[compare], key[compare], np.where(different[key_id[compare]] > hot, HOT, COMPARE))

    return run


def shared_runs(rows: DataFrame, width: int, k: int, symbols, buckets: int, name: str) -> DataFrame:
    """A written table of RUN rows: every place of every run whose minimiser isn't unique."""
    blocks = rows.mapInArrow(record_blocks(width, k, buckets, symbols, False), BLOCK)
    return written(blocks.repartitionById(buckets, F.col("bucket")).mapInArrow(judge_blocks(False, 0, settle=False), RUN), name)


def judged_runs(docs: DataFrame, width: int, k: int, symbols, once: bool, hot: int, buckets: int, name: str) -> DataFrame:
    """A written table of RUN rows: runs known to be repeated, and one place of each run that must be compared with others.

    once: of equal runs, the one at the smallest (doc_id, start) isn't REPEATED; otherwise all are.
    """
    blocks = docs.mapInArrow(record_blocks(width, k, buckets, symbols, once), BLOCK)
    return written(blocks.repartitionById(buckets, F.col("bucket")).mapInArrow(judge_blocks(once, hot), RUN), name)


def merged_spans(spans: np.ndarray) -> np.ndarray:
    """Disjoint sorted [from, to) spans that cover the same places; touching ones are joined."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > top[:-1]
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], top[np.append(at[1:], len(spans)) - 1]], 1)
